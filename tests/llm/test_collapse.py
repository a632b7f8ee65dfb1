from collections import Counter

import pytest

from factloom.llm import collapse


def test_layouts_have_one_key(spark):
    a = ["(: n (IsA x y) (STV 1.0 0.9))", "(: m (P q) (STV 1 1))"]
    b = ["[: M [p Q] [stv 1 1]]", None, " (:\xa0n\xa0(IsA, x, y)\n (STV 1.0 0.9)) "]
    rows = [(1, a), (2, b), (3, a[:1]), (4, []), (5, None), (6, [None]), (7, a + a[:1])]
    df = spark.createDataFrame(rows, "item_id long, atoms array<string>")
    keys = {r.id: r.key for r in collapse.item_keys(df).collect()}
    assert keys[1] == keys[2] and len({bytes(keys[i]) for i in (1, 3, 7)}) == 3
    assert keys[4] is keys[5] is keys[6] is None


def test_lines(spark):
    good = '{"nl": "Caf\\u00e9 x", "pln": ["(a b)"], "source": "s", "background": true, "relation": null}'
    lines = [good, '{"pln":["[A, B]"],"nl":"café X","background":true , "source":"s"}', good.replace('"s"', '"t"'), good[:-5], "", "  ", None, "# no", "[1]", '{"nl": null, "pln": ["a"]}', '{"nl": "x"}', "{'nl': 'x', 'pln': ['a']}", '{"nl": "x", "pln": []}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    keys = {r.id: r.key for r in collapse.line_keys(df).collect()}
    assert set(keys) == {0, 1, 2, 12} and keys[0] == keys[1] != keys[2] and keys[12] is None


@pytest.mark.parametrize("n", [0, 40, 6000])
def test_hot_and_cold_against_brute_force(spark, n):
    rows = [(bytes([i % 7]) if i % 3 else b"hot", i) for i in range(n)] + [(str(i).encode(), 10_000 + i) for i in range(n // 2)] + [(None, 1)] * (n > 0)
    df = spark.createDataFrame(rows, "key binary, id long").repartition(5)
    first, count = {}, Counter(k for k, _ in rows if k is not None)
    for k, i in rows:
        if k is not None:
            first[k] = min(first.get(k, i), i)
    got = {(bytes(r.key), r.id, r.first_id, r.copies) for r in collapse.members(df).collect()}
    assert got == {(k, i, first[k], count[k]) for k, i in rows if k is not None}
    assert {(bytes(r.key), r.first_id, r.copies) for r in collapse.collapse(df).collect()} == {(k, first[k], count[k]) for k in count}
    if n == 6000:
        assert {bytes(r.key) for r in collapse.hot_keys(df.where("key is not null")).collect()} == {b"hot"}


def test_frequent_items_keep_every_hot_key():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([b"hot"] * 40 + [f"{b}-{i}".encode() for i in range(9000)])], names=["key"]) for b in range(6)]
    kept = [k for out in collapse._frequent(iter(batches)) for k in out.column(0).to_pylist()]
    assert b"hot" in kept and len(kept) < 20_000


def test_content_class(spark):
    df = spark.createDataFrame([("कि की", "a + b"), ("ki", " A-B ")], "x string, y string")
    row = df.select(*[collapse.canonical(c) for c in ("x", "y")], collapse.canonical(df.y, collapse.LETTERS_AND_DIGITS)).collect()
    assert [tuple(r) for r in row] == [("किकी", "a+b", "ab"), ("ki", "ab", "ab")]
