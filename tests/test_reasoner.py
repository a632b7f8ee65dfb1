import inspect
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import reasoner as R


def facts(spark, rows):
    return spark.createDataFrame([(h, list(a), 1.0, c) for h, a, c in rows], R.FACTS)


def closed(df):
    return {(r.head, tuple(r.args)) for r in df.collect()}


def test_smoke_cases(spark):
    base = facts(spark, [("IsA", ("socrates", "human"), 1.0), ("Eats", ("kebede", "fish"), 1.0)])
    rules = [
        *R.parse_rule("(: m (Implication (Premises (IsA $p human)) (Conclusions (Mortal $p))) (STV 1.0 0.9))"),
        *R.parse_rule("(: s (Implication (Premises (Eats $p fish)) (Conclusions (Smart $p))) (STV 1.0 1.0))"),
    ]
    out = R.fixpoint(base, rules)
    assert R.answers(out, "(: $prf (Mortal socrates) $tv)").count() == 1
    assert [r["$who"] for r in R.answers(out, "(: $prf (Smart $who) $tv)").collect()] == ["kebede"]
    assert [r["$food"] for r in R.answers(out, "(: $prf (Eats kebede $food) $tv)").collect()] == ["fish"]
    assert R.answers(out, "(: $prf (IsA fido animal) $tv)").count() == 0
    assert [r.c for r in R.answers(out, "(: $prf (Mortal socrates) $tv)").collect()] == [0.9]
    assert [r.name for r in R.relevant(rules, "Smart")] == ["s"]


def test_fixpoint_against_closure_with_cycles(spark):
    rnd = random.Random(1)
    edges = {(rnd.randrange(9), rnd.randrange(9)) for _ in range(14)} | {(1, 1)}
    rule = R.parse_rule("(: t (Implication (Premises (E $x $y) (E $y $z)) (Conclusions (E $x $z))) (STV 1.0 1.0))")
    got = closed(R.fixpoint(facts(spark, [("E", (str(a), str(b)), 1.0) for a, b in edges]), rule))
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert got == {("E", (str(a), str(b))) for a, b in want}


def test_negation_disjunction_and_errors(spark):
    base = facts(spark, [("A", ("x",), 1.0), ("A", ("y",), 0.5), ("B", ("y",), 1.0), ("Not:B", ("x",), 0.7), ("A", ("y",), 0.9)])
    neg = R.parse_rule("(: n (Implication (Premises (A $p) (Not (B $p))) (Conclusions (C $p))) (STV 1 1))")
    assert closed(R.apply_rules(base, neg, closed_world=True)) == {("C", ("x",))}
    assert closed(R.apply_rules(base, neg)) == {("C", ("x",))}
    either = R.parse_rule("(: o (Implication (Premises (Or (A $p) (B $p))) (Conclusions (D $p))) (STV 1 1))")
    assert {(r.args[0], r.c) for r in R.apply_rules(base, either).collect()} == {("x", 1.0), ("y", 1.0)}
    with pytest.raises(ValueError):
        R.fixpoint(base, R.parse_rule("(: n (Implication (Premises (A $p) (Not (C $p))) (Conclusions (C $p))) (STV 1 1))"), closed_world=True)
    with pytest.raises(ValueError):
        R.conjunction([(R.Atom("A", ("$p",)), base), (R.Atom("B", ("$q",)), base)])
    assert closed(R.fixpoint(base.limit(0), either)) == set()
    same = R.match(facts(spark, [("P", ("a", "a"), 1.0), ("P", ("a", "b"), 1.0)]), R.Atom("P", ("$x", "$x")))
    assert [r["$x"] for r in same.collect()] == ["a"]


def test_fixpoint_never_stops_short(spark):
    rule = R.parse_rule("(: l (Implication (Premises (Edge $x $y) (Reaches $y $z)) (Conclusions (Reaches $x $z))) (STV 1.0 1.0))")
    base = facts(spark, [("Edge", (str(i), str(i + 1)), 1.0) for i in range(4)] + [("Reaches", ("4", "5"), 1.0)])
    assert len(closed(R.fixpoint(base, rule, max_rounds=4))) == 9
    with pytest.raises(RuntimeError):
        R.fixpoint(base, rule, max_rounds=3)
    assert inspect.signature(R.fixpoint).parameters["max_rounds"].default is None


def test_better_derivations_replace_worse_ones(spark):
    rows = [("R", ("a", "b"), 0.5), ("R", ("b", "c"), 0.5), ("R", ("a", "x"), 0.95), ("R", ("x", "y"), 0.95), ("R", ("y", "c"), 0.95), ("R", ("c", "a"), 0.9)]
    rule = R.parse_rule("(: t (Implication (Premises (R $x $y) (R $y $z)) (Conclusions (R $x $z))) (STV 1.0 1.0))")
    got = {tuple(r.args): round(r.c, 6) for r in R.fixpoint(facts(spark, rows), rule).collect()}
    want = {}
    for k in range(6):  # the best product over all paths
        for (a, b), c in [*want.items(), *((a, c) for _, a, c in rows)]:
            for _, (d, e), f in rows:
                want[a, b] = max(want.get((a, b), 0), c)
                if b == d:
                    want[a, e] = max(want.get((a, e), 0), c * f)
    assert got == {k: round(v, 6) for k, v in want.items()} and got["a", "c"] == 0.857375
    assert R.fixpoint(facts(spark, rows), rule).count() == len(got)


def test_premise_order_ground_premises_and_nested_alternatives(spark):
    base = facts(spark, [("P", ("a",), 1.0), ("Q", ("b",), 1.0), ("R", ("a", "b"), 0.5), ("On", ("switch",), 0.8), ("S", ("a",), 1.0)])
    run = lambda premises, head="T $x": closed(R.apply_rules(base, R.parse_rule(f"(: r (Implication (Premises {premises}) (Conclusions ({head}))) (STV 1 1))")))
    assert run("(P $x) (Q $y) (R $x $y)", "T $x $y") == {("T", ("a", "b"))}
    assert run("(P $x) (On switch)") == {("T", ("a",))} and run("(P $x) (On lamp)") == set()
    assert run("(On switch)", "T done") == {("T", ("done",))}
    assert run("(Or (And (P $x) (S $x)) (Q $x))") == {("T", ("a",)), ("T", ("b",))}
    with pytest.raises(ValueError):
        run("(P $x) (Q $y)", "T $x $y")
    for bad in ("(: f (IsA a b) (STV 1 1))", "(: r (Implication (Premises (P (Q $x))) (Conclusions (T $x))) (STV 1 1))", "(: r (Implication (Premises) (Conclusions (T $x))) (STV 1 1))", "nothing", "(: r"):
        with pytest.raises(ValueError):
            R.parse_rule(bad)


def test_distributions_in_rules(spark):
    from factloom.operators import kb

    stmts = [
        "(: g (Group g1) (STV 1.0 1.0))", "(: h1 (HeightDist g1 alice) (PointMass 160.0))", "(: h2 (HeightDist g1 bob) (ParticleFromPairs ((170.0 1) (180.0 3))))",
        "(: r (Rectangle box) (STV 1.0 0.9))", "(: l (LengthDist box) (PointMass 3.0))", "(: w (WidthDist box) (ParticleFromPairs ((2.0 1.0) (4.0 1.0))))",
        "(: s1 (Sold ann 5) (STV 1 1))", "(: s2 (Sold ann 7) (STV 1 1))", "(: s3 (Sold bo 1) (STV 1 1))", "(: p1 (Seller ann) (STV 1 1))", "(: p2 (Seller bo) (STV 1 1))",
    ]
    parsed = kb.parse_statements(spark.createDataFrame([(x,) for x in stmts], "stmt string"))
    base = parsed.select("head", "args", F.coalesce("tv.s", F.lit(1.0)).alias("s"), F.coalesce("tv.c", F.lit(1.0)).alias("c"), "dist")
    rules = [
        "(: avg (Implication (Premises (Group $g) (AverageDist (HeightDist $g $p) -> $d)) (Conclusions (AvgHeightDist $g))) (STV 1.0 1.0))",
        "(: area (Implication (Premises (Rectangle $r) (Map2Dist * (LengthDist $r) (WidthDist $r) -> $a)) (Conclusions (AreaDist $r))) (STV 1.0 1.0))",
        "(: big (Implication (Premises (Rectangle $r) (GreaterThan (AreaDist $r) 7)) (Conclusions (Big $r))) (STV 1.0 1.0))",
        "(: fold (Implication (Premises (Seller $p) (FoldAll (Sold $p $n) $n 0 + -> $t) (Compute * ($t 2) -> $d)) (Conclusions (Doubled $p $d))) (STV 1.0 1.0))",
        "(: next (Implication (Premises (Big $r)) (Conclusions (Noted $r))) (STV 1.0 1.0))",
    ]
    out = R.fixpoint(base, [r for x in rules for r in R.parse_rule(x)])
    mean = lambda goal: out.where(F.col("head") == goal).select(F.aggregate("dist", F.lit(0.0), lambda a, p: a + p["x"] * p["w"]).alias("m")).first().m
    assert abs(mean("AvgHeightDist") - (160 + 177.5) / 2) < 1e-9 and abs(mean("AreaDist") - 9.0) < 1e-9
    big = R.answers(out, "(: $prf (Big $r) $tv)").first()
    assert (big["$r"], big.s, round(big.c, 6)) == ("box", 0.5, 0.81)
    assert {tuple(r.args) for r in out.where("head = 'Doubled'").collect()} == {("ann", "24.0"), ("bo", "2.0")}
    assert R.answers(out, "(: $prf (Noted $r) $tv)").count() == 1


def test_explicit_negation_of_stored_statements(spark):
    from factloom.operators import kb

    parsed = kb.parse_statements(spark.createDataFrame([("(: n (Not (Solvent ann)) (STV 1.0 0.8))",), ("(: d (IsA ann dealer) (STV 1 1))",)], "stmt string"))
    base = parsed.select("head", "args", "tv.s", "tv.c")
    out = R.fixpoint(base, R.parse_rule("(: r (Implication (Premises (IsA $p dealer) (Not (Solvent $p))) (Conclusions (Risky $p))) (STV 1.0 1.0))"))
    assert [(r["$p"], r.c) for r in R.answers(out, "(: $prf (Not (Solvent $p)) $tv)").collect()] == [("ann", 0.8)]
    assert [r["$p"] for r in R.answers(out, "(: $prf (Risky $p) $tv)").collect()] == ["ann"]


def test_closure_of_the_triples(spark, tmp_path):
    from factloom.plans import catalog

    rnd = random.Random(4)
    edges = {(p, rnd.choice("abcdefgh"), rnd.choice("abcdefgh")) for p in ("IsA", "PartOf") for _ in range(8)} | {("IsA", "x", "y"), ("IsA", "y", "x")}
    rows = [(f"/r/{p}", f"/c/en/{a * 3}", f"/c/en/{b * 3}", '{"weight": 2.0}') for p, a, b in edges] + [("/r/IsA", "/c/en/yyy", "/c/en/weak", '{"weight": 1.0}')]
    spark.createDataFrame(rows, "relation string, start_uri string, end_uri string, metadata_json string").write.parquet(str(tmp_path / "conceptnet_assertions.parquet"))
    want, more = set(edges), True
    while more:
        new = {(p, a, d) for p, a, b in want for q, c, d in edges if (p, b) == (q, c)} - want
        want, more = want | new, bool(new)
    got = [tuple(r) for r in catalog.queries()["rule_transitive_closure_triples"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == {(p, a * 3, b * 3) for p, a, b in want}
