import pytest
from pyspark.sql import functions as F

from factloom.operators import atoms, kb

RULE = "(: r (Implication (Premises (IsA $p human) (Eats $p fish)) (Conclusions (Smart $p))) (STV 0.9 0.8))"


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "statement,reason",
    [
        ("(: a (IsA x y) (STV 1.0 1.0))", None),
        ("a (IsA x y) (STV 1.0 1.0)", "missing_prefix"),
        ("(: a (IsA x y))", "missing_weight"),
        ("(: a (IsA x y (STV 1.0 1.0))", "unbalanced_parens"),
        ("(: (IsA x y) (STV 1.0 1.0))", "bad_toplevel"),
        ("(: $a (IsA x y) (STV 1.0 1.0))", "variable_name"),
        ("(: a (Implication (IsA $x y)) (STV 1.0 1.0))", "bad_implication_shape"),
        ("(: h (HeightDist bob) (ParticleFromNormal 170.0 2.0))", None),
        (RULE, None),
        (None, "missing_prefix"),
        ("", "missing_prefix"),
        ("(: a )( (STV 1 1)", "unbalanced_parens"),
    ],
)
def test_validator(spark, statement, reason):
    assert column(spark, [statement], atoms.invalid_reason) == [reason]


def test_parsing(spark):
    got = column(spark, ["(P a $b ?c)", "(P)", "(P (Q a))", "P a", None, " (P  a) "], atoms.parse_flat)
    assert [g and (g.head, list(g.args), g.arity, list(g.variables)) for g in got] == [("P", ["a", "$b", "?c"], 3, ["$b", "?c"]), ("P", [], 0, []), None, None, None, ("P", ["a"], 1, [])]
    assert column(spark, ["(: n (P a b) (STV 1.0 0.5))", "(: n (P a) (PointMass 3))", RULE], atoms.body_of) == ["(P a b)", None, RULE[5:-15]]
    assert column(spark, ["(: $prf (P a b) $tv)", "(: $prf (P $x b) $tv)", "(: n (P a) $tv)", "(: ?p (P a) ?t)"], atoms.ground_goal) == ["(P a b)", None, None, "(P a)"]
    tv = column(spark, ["(: n (P a) (STV 0.5 0.25))", "(: n (P a) (PointMass 1))"], atoms.truth_of)
    assert (tv[0].s, tv[0].c, tv[1]) == (0.5, 0.25, None)


def test_rewrites(spark):
    assert column(spark, [RULE, "(: a (IsA x y) (STV 1 1))"], atoms.prune_sortal_premises) == [RULE.replace("(IsA $p human) ", ""), "(: a (IsA x y) (STV 1 1))"]
    only = "(: r (Implication (Premises (IsA $p a) (IsA $p b)) (Conclusions (C $p))) (STV 1 1))"
    assert column(spark, [only], atoms.prune_sortal_premises) == [only]
    assert column(spark, ["(is_a RedDogs Animals)", "(UsedFor $Xy big-cats)", "x"], atoms.canonical_atom) == ["(IsA red_dog animal)", "(UsedFor $xy big_cat)", None]
    assert column(spark, ["(IsA rex Dogs)", "(P a)"], atoms.normalize_isa) == ["(IsA rex dog)", "(P a)"]
    assert column(spark, ["(: a (IsA $x y) (STV 1 1))", RULE, "(: a (Implication (P)) (STV 1 1))", "(: a (P ?x) (STV 1 1))"], atoms.keep_statement) == [False, True, False, True]
    assert column(spark, ["(: $prf (P $who a) $tv)", "(: $q (P a) $tv)"], atoms.goal_variables) == [["$who"], ["$q"]]
    assert column(spark, [RULE], atoms.conclusion_atoms) == [["(Smart $p)"]]
    assert column(spark, ["(: a (P x) (STV 1 1)) (: b (Q y) (PointMass 2))"], atoms.fact_atoms) == [["(P x)", "(Q y)"]]
    assert column(spark, ["the_fall_of_the_empire", "short", "a_b_c_d_e_f", None], atoms.overliteral) == [True, False, True, None]


def test_lookup_and_append(spark, tmp_path):
    lines = ["(: a (IsA rex dog) (STV 1 1))", "(: b (IsA Rex Dogs) (STV 1 1))", "bad", " ", "(: c (IsA rex dog) (STV 0.5 0.5))"]
    df = spark.createDataFrame([(s,) for s in lines], "stmt string")
    bad = kb.append(df, str(tmp_path / "kb"))
    assert [tuple(r) for r in bad.collect()] == [("bad", "missing_prefix")]
    facts = spark.read.parquet(str(tmp_path / "kb")).withColumn("seq", F.ascii(F.col("name")))
    goals = spark.createDataFrame([(1, "(: $prf (IsA rex dog) $tv)"), (2, "(: $prf (IsA rexs Dog) $tv)"), (3, "(: $prf (IsA tom cat) $tv)"), (4, "(: $prf (IsA $x dog) $tv)")], "goal_id int, goal string")
    exact = {r.goal_id: r.proof for r in kb.lookup_exact(goals, facts).collect()}
    assert exact == {1: lines[0], 2: None, 3: None, 4: None}
    assert {r.goal_id: r.proof for r in kb.lookup(goals, facts).collect()} == {1: lines[0], 2: lines[0], 3: None, 4: None}
    kept = kb.delete_by_source(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, source string"), "a")
    assert sorted(r.i for r in kept.collect()) == [2, 3]
