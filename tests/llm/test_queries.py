def test_every_problem_has_its_query(spark):
    from factloom.llm.queries import queries
    from factloom.llm.sql import oracle_sql

    names = queries()
    assert all(any(n.startswith(f"p{i}_") for n in names) for i in range(1, 9))
    assert set(oracle_sql()) <= set(names)
