import random
from pathlib import Path

import pytest

from factloom import session
from factloom.operators import closure as C

COLUMNS = "predicate string, a string, b string"


def reached(edges):
    want, more = set(edges), True
    while more:
        new = {(p, a, d) for p, a, b in want for q, c, d in edges if (p, b) == (q, c)} - want
        want, more = want | new, bool(new)
    return want


@pytest.mark.parametrize("seed, phases", [(1, 16), (3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, phases):
    monkeypatch.setattr(C, "PATHS", 0)
    monkeypatch.setattr(C, "PHASES", phases)
    monkeypatch.setattr(C, "BLOCK", 3)
    rnd = random.Random(seed)
    # two cycles, one behind the other, a chain through single nodes, loops, and what hangs on them
    edges = {("P", f"s{i}", f"s{(i + 1) % 5}") for i in range(5)} | {("P", f"t{i}", f"t{(i + 1) % 4}") for i in range(4)} | {("P", "s0", "m"), ("P", "m", "t0")}
    edges |= {("Q", x, "hub") for x in "abcd"} | {("Q", "hub", x) for x in "efg"} | {("Q", "e", "h"), ("Q", "h", "h"), ("Q", "a", "e")}
    edges |= {(rnd.choice("PQ"), f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(24)}
    got = [tuple(r) for r in C.closure(spark.createDataFrame([*edges, *edges], COLUMNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == reached(edges)


def test_nothing_to_close(spark):
    assert C.closure(spark.createDataFrame([], COLUMNS)).collect() == []


def test_pairs_of_a_cycle_are_not_derived_one_by_one(spark, tmp_path):
    from factloom.plans import catalog

    rnd, n = random.Random(5), 120
    edges = {(i, (i + 1) % n) for i in range(n)} | {(rnd.randrange(n), rnd.randrange(n)) for _ in range(5 * n)}
    rows = [("/r/IsA", f"/c/en/x{a}x", f"/c/en/x{b}x", '{"weight": 2.0}') for a, b in edges]
    spark.createDataFrame(rows, "relation string, start_uri string, end_uri string, metadata_json string").write.parquet(str(tmp_path / "conceptnet_assertions.parquet"))
    scratch = Path(session.shared_dir(spark).removeprefix("file://")) / session._RUN
    before = set(scratch.glob("*"))
    out = catalog.queries()["rule_transitive_closure_triples"](spark, str(tmp_path))
    assert out.distinct().count() == out.count() == n * n
    written = sum(spark.read.parquet(str(p)).count() for p in set(scratch.glob("*")) - before)
    assert written < n * n / 2
