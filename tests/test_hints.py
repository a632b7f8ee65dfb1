import json

from pyspark.sql import functions as F

from factloom.operators import hints, report, vectors


def test_hints(spark, tmp_path):
    df = spark.createDataFrame([("Yesterday Ana met the Baker. The baker and Ana left.", "Is Ana here?", "(: a (Likes x y) (STV 1 1))"), (None, None, None), ("", "", "")], "t string, q string, c string")
    got = df.select(hints.proper_names(F.col("t")).alias("n"), hints.question_hints(F.col("q"), F.col("c")).alias("h")).collect()
    assert got[0].n == ["ana"] and got[0].h[0].startswith("; intent: yes-no") and got[0].h[1] == "; predicates to use first: Likes, STV" and len(got[0].h) == 3
    assert got[1].n is None and got[2].n == [] and got[2].h == []
    full = spark.createDataFrame([("Does someone never sleep", "(: a (P x) (STV 1 1))")], "q string, c string").select(hints.question_hints(F.col("q"), F.col("c"), full=True).alias("h"), hints.batch_hints(F.col("q"), F.col("c")).alias("b")).first()
    assert len(full.h) == 4 and full.b[-2:] == ["; concepts: someone, never, sleep", "; preferred predicates: P, STV"]
    rule = "(: r (Implication (Premises (Eats $ana fish) (IsA $p human)) (Conclusions (Smart $ana))) (STV 1 1))"
    facts = spark.createDataFrame([("Ana eats.", rule), ("Smart if she eats, Ana.", rule), ("Ana", "(: a (P x) (STV 1 1))")], "t string, s string").select(hints.grounded_premises(F.col("t"), F.col("s")).alias("f"))
    assert [r.f for r in facts.collect()] == [["(: materialized_eat_fact (Eats ana fish) (STV 1.0 1.0))"], [], None]
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"examples": [{"text": "x"}]}))
    assert hints.prompt_examples(str(p)) == ('{"text": "x"}',)


def test_source_lookup_and_dimension(spark):
    embed = vectors.hashing_embedder(64)
    points = spark.createDataFrame([(1, "cat is a pet"), (2, "sun is hot")], "vec_id long, nl string").withColumn("embedding", embed(F.col("nl")))
    proofs = spark.createDataFrame([(7, "((cat is a pet) (STV 1 1))"), (8, "(zz yy xx ww)"), (9, None)], "proof_id long, proof string")
    assert [tuple(r) for r in vectors.source_lookup(proofs, points, embed).collect()] == [(7, "cat is a pet")]
    assert vectors.checked_dimension(points) == 64 and vectors.checked_dimension(points.limit(0)) is None


def test_reports(spark):
    df = spark.createDataFrame([("b", 1.5), ("a", None)], "parser string, seconds double")
    assert report.markdown(df).splitlines()[2:] == ["| parser | seconds |", "| --- | --- |", "| a |  |", "| b | 1.5 |"]
    assert report.text_table(df).splitlines()[0] == "parser  seconds"
    assert report.answer("[]", "well_aligned") == report.NONE and report.answer("p", "weakly_aligned") == "Proved by p" and report.answer(None, "weakly_aligned") == report.WEAK
