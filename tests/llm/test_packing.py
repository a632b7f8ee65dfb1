import random

import pytest

from factloom.llm import packing


def offline(sizes, cap):
    """Containers that best fit by falling size needs, with all items and containers at hand."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(cap - n)
    return len(rooms)


@pytest.mark.parametrize("parts", [1, 6])
def test_whole_bounded_and_full(spark, monkeypatch, parts):
    monkeypatch.setattr(packing, "MERGE", 2)
    rnd = random.Random(parts)
    sizes = {i: rnd.choice([0, 1, 5, 100, 101, 250, rnd.randint(1, 60)]) for i in range(900)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long").repartition(parts)
    budgets = spark.createDataFrame([(1, 100), (2, 300), (3, None), (4, 0)], "budget_id int, capacity_tokens int")
    rows = packing.pack(df, budgets).collect()
    for budget, cap in ((1, 100), (2, 300)):
        mine = [r for r in rows if r.budget_id == budget]
        held, pieces = {}, {}
        for r in mine:
            held[r.bin] = held.get(r.bin, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.tokens))
        assert max(held.values()) <= cap
        assert {d: sum(t for _, t in p) for d, p in pieces.items()} == {d: n for d, n in sizes.items() if n}
        for d, p in pieces.items():
            assert sorted(i for i, _ in p) == list(range(len(p))) and (len(p) == 1) == (sizes[d] <= cap)
        assert len(held) <= 1.1 * offline([r.tokens for r in mine], cap) + 1
    assert {r.budget_id for r in rows} == {1, 2}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, tokens long")
    budgets = spark.createDataFrame([(1, 100)], "budget_id int, capacity_tokens int")
    assert packing.pack(empty, budgets).count() == 0
    one = spark.createDataFrame([(1, 7), (1, 7)], "doc_id long, tokens long")
    assert [r.tokens for r in packing.pack(one, budgets).collect()] == [7, 7]
    assert packing.pack(one, budgets.limit(0)).count() == 0


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_sizes(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000
