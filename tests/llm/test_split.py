import pytest
from pyspark.sql import functions as F

from factloom.llm.split import oversized_requests, pieces, trimmed


def cut(spark, text, size, over):
    df = spark.createDataFrame([(text, size, over)], "t string, s int, o int")
    return df.select(pieces(F.col("t"), F.col("s"), F.col("o"))).first()[0]


def rebuilt(parts, size, over):
    """The text that the pieces come from, if they overlap as asked."""
    whole = parts[0]
    for p in parts[1:]:
        back = min(over, len(whole))
        assert p[:back] == whole[len(whole) - back :]
        whole += p[back:]
    return whole


TEXTS = [
    "One sentence here. " * 60,
    "Para one is short.\n\nPara two, which has: clauses; and more.\n\n" * 20,
    "x" * 1000,
    "这是一个句子。" * 200,
    "ก็" * 300 + " " + "नमस्ते " * 90,
    "😀" * 333,
    "word " * 5000,
]


@pytest.mark.parametrize("size,over", [(50, 0), (50, 7), (64, 63), (200, 20)])
def test_round_trip_and_limit(spark, size, over):
    for text in TEXTS:
        parts = cut(spark, text, size, over)
        assert max(map(len, parts)) <= size and len(parts) > 1
        assert rebuilt(parts, size, over) == text.strip()


def test_boundaries_by_strength(spark):
    assert cut(spark, "Aaaa bbbb cccc.\n\nDddd eeee ffff. Gg", 24, 0) == ["Aaaa bbbb cccc.\n\n", "Dddd eeee ffff. Gg"]
    assert cut(spark, "Aaaa bbbb. Cccc dddd eeee", 16, 0) == ["Aaaa bbbb. ", "Cccc dddd eeee"]
    assert cut(spark, "Aaaa bbbb, Cccc dddd eeee", 16, 0) == ["Aaaa bbbb, ", "Cccc dddd eeee"]
    assert cut(spark, "Aaaa bbbb Cccc dddd", 12, 0) == ["Aaaa bbbb ", "Cccc dddd"]
    assert cut(spark, "Aaaa bbbb. Cccc", 13, 3) == ["Aaaa bbbb. ", "b. Cccc"]


def test_edges(spark):
    assert cut(spark, "  short \n", 10, 3) == ["short"]
    assert cut(spark, " \n ", 10, 3) == [] and cut(spark, "", 10, 3) == []
    assert cut(spark, None, 10, 3) is None and cut(spark, "abc", None, 3) is None and cut(spark, "abc", 0, 3) is None
    assert rebuilt(cut(spark, "abcdefgh", 3, 9), 3, 2) == "abcdefgh"
    assert rebuilt(cut(spark, "abcdefgh", 3, None), 3, 0) == "abcdefgh"
    long = "Hello there, world. " * 100_000
    assert max(map(len, cut(spark, long, 512, 64))) <= 512
    pad = spark.createDataFrame([("a" + " " * 200_000 + "b",), ("　\x85x ",)], "t string")
    assert [len(r[0]) for r in pad.select(trimmed(F.col("t"))).collect()] == [200_002, 1]


def test_requests(spark):
    rows = [(1, 1, ["x" * 11, None, " " * 50, "y" * 10]), (1, 1, ["x" * 11, None, " " * 50, "y" * 10]), (2, 2, None), (3, 9, ["z" * 99]), (4, None, ["z" * 99])]
    requests = spark.createDataFrame(rows, "request_id long, setting_id int, texts array<string>")
    settings = spark.createDataFrame([(1, 10, 2), (2, None, None)], "setting_id int, chunk_size int, chunk_overlap int")
    got = oversized_requests(requests, settings).select("request_id", "text_no").distinct().collect()
    assert [tuple(r) for r in got] == [(1, 0)]
    assert oversized_requests(requests.limit(0), settings).count() == 0


def test_boundary_behind_a_long_gap(spark):
    gap = " " * 30
    assert cut(spark, f"Aaaa bbbb cccc dddd eeee ffff.{gap}Gggg hhhh, iiii jjjj kkkk llll mmmm nnnn oooo", 70, 0)[0] == f"Aaaa bbbb cccc dddd eeee ffff.{gap}"
    assert cut(spark, f"Aaaa bbbb cccc dddd\n{gap}\nGggg hhhh. iiii jjjj kkkk llll mmmm nnnn oooo pppp", 70, 0)[0] == f"Aaaa bbbb cccc dddd\n{gap}\n"
