import random

import pytest
from pyspark.sql import functions as F

from factloom.llm.sample import broken_samples, permute, sample, sampled_assertions, selected


def test_permutation_is_a_bijection_with_exact_rate(spark):
    for bits, seed in ((8, 1), (12, 42), (16, -7)):
        ids = spark.range(1 << bits).select("id", permute(F.col("id"), F.lit(seed), bits).alias("p"))
        row = ids.agg(F.countDistinct("p").alias("n"), F.min("p").alias("a"), F.max("p").alias("b")).first()
        assert (row.n, row.a, row.b) == (1 << bits, 0, (1 << bits) - 1)
        assert sample(spark.range(1 << bits), "id", 0.25, seed, bits).count() == (1 << bits) // 4


def test_wide_domain_is_even_and_seeds_differ(spark):
    n = 200_000
    ids = spark.range(n)
    for base in (0, 10**9, (1 << 61) - 1, 1 << 62, -(1 << 62), -(1 << 63)):
        got = ids.select((F.col("id") + F.lit(base)).alias("id")).where(selected(F.col("id"), F.lit(0.1), F.lit(42))).count()
        assert abs(got - n * 0.1) < 5 * (n * 0.09) ** 0.5
    both = ids.where(selected(F.col("id"), F.lit(0.1), F.lit(1)) & selected(F.col("id"), F.lit(0.1), F.lit(2))).count()
    assert abs(both - n * 0.01) < 5 * (n * 0.01) ** 0.5


def test_stable_nested_and_only_grows(spark):
    few, many = spark.range(5_000), spark.range(20_000).repartition(7)
    a = {r.id for r in sample(few, "id", 0.2, 9).collect()}
    b = {r.id for r in sample(many, "id", 0.2, 9).collect()}
    c = {r.id for r in sample(many, "id", 0.5, 9).collect()}
    assert a <= b <= c and a == {i for i in b if i < 5_000}


def test_edges(spark):
    rows = spark.createDataFrame([(None, 1.0, 1), (5, None, 1), (5, 1.0, None), (-1, 1.0, 1), (5, 2.0, 1), (5, 0.0, 1), (5, float("nan"), 1), (2**62, 1.0, 1), (-(2**63), 1.0, 1)], "id long, r double, s long")
    got = [x.k for x in rows.select(selected(F.col("id"), F.col("r"), F.col("s")).alias("k")).collect()]
    assert got == [False, False, False, True, True, False, False, True, True]
    with pytest.raises(ValueError):
        permute(F.col("id"), F.lit(1), 63)
    assert sample(rows.limit(0), "id", 0.5, 1).count() == 0


MANIFEST = "manifest_id long, exported_at timestamp, source_file string, normalization_version int, min_weight double, coverage_percent double, sample_seed long, scanned_rows long, eligible_row_count long, sampled_row_count long"
ASSERTED = "assertion_id long, source_file string, load_batch int, relation string, start_uri string, end_uri string, metadata_json string"


def assertions(spark, n=400):
    rnd = random.Random(5)
    rows = [(i, "f", i // 100, rnd.choice(["/r/IsA", "/r/RelatedTo"]), f"/c/en/a{i}", f"/c/en/b{i}", rnd.choice(['{"weight": 2.0}', '{"weight": 0.5}', "{bad", None, "{}"])) for i in range(n)]
    return spark.createDataFrame(rows, ASSERTED)


def test_broken_samples(spark):
    s = lambda i, day, scanned, elig, got, version=1: (i, f"2025-01-{day:02d}", "f", version, 1.0, 25.0, 42, scanned, elig, got)
    rows = [
        s(1, 1, 100, 30, 8), s(2, 2, 200, 60, 7),  # fell: a case
        s(3, 3, 200, 60, 9),  # changed without new rows: a case
        s(4, 4, 300, 90, None), s(5, 5, 300, 90, 12),  # NULL is skipped, growth is fine
        s(6, 6, 100, 30, 5),  # scanned fell: no case
        s(7, 1, 100, 30, 9, None), s(8, 2, 100, 30, 8, None),  # NULL version is a series of its own: a case
    ]
    m = spark.createDataFrame(rows, MANIFEST.replace("exported_at timestamp", "exported_at string")).withColumn("exported_at", F.to_timestamp("exported_at"))
    got = sorted(map(tuple, broken_samples(m, assertions(spark)).collect()))
    assert got == [(1, 2), (2, 3), (7, 8)]
    assert sorted(map(tuple, broken_samples(m, assertions(spark).limit(0)).collect())) == got
    assert broken_samples(m.limit(0), assertions(spark)).count() == 0


def test_the_replayed_sample_decides(spark, monkeypatch):
    """With another sample in its place, one that loses rows or changes by itself, other pairs are reported."""
    from factloom.llm import sample as S

    s = lambda i, day, scanned, elig, got: (i, f"2025-01-{day:02d}", "f", 1, 1.0, 25.0, 42, scanned, elig, got)
    rows = [s(1, 1, 100, 30, 8), s(2, 2, 200, 60, 7), s(3, 3, 200, 60, 9), s(4, 4, 200, 60, 9)]
    m = spark.createDataFrame(rows, MANIFEST.replace("exported_at timestamp", "exported_at string")).withColumn("exported_at", F.to_timestamp("exported_at"))
    assert sorted(map(tuple, broken_samples(m, assertions(spark)).collect())) == [(1, 2), (2, 3)]
    real = S.replayed_exports
    monkeypatch.setattr(S, "replayed_exports", lambda a, b: real(a, b).withColumn("replayed_count", -10 * F.col("manifest_id")))
    assert sorted(map(tuple, broken_samples(m, assertions(spark)).collect())) == [(2, 3), (3, 4)]


def test_many_files_with_a_hot_one(spark, monkeypatch):
    from factloom.llm import sample as S

    files = F.when(F.col("assertion_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("f"), (F.col("assertion_id") % 50).cast("string")))
    rows = assertions(spark, 4000).withColumn("source_file", files)
    one = rows.select("source_file").distinct().withColumn("x", F.length("source_file"))
    want = sorted(map(tuple, S._join_by_file(rows, one).select("assertion_id", "x").collect()))
    monkeypatch.setattr(S, "BROADCAST_FILES", 0)
    assert sorted(map(tuple, S._join_by_file(rows, one).select("assertion_id", "x").collect())) == want and len(want) == 4000


def test_sampled_assertions_grow(spark):
    m = spark.createDataFrame([(1, "2025-01-01", "f", 1, 1.0, 40.0, 3, 1, 1, 1)], MANIFEST.replace("exported_at timestamp", "exported_at string"))
    rows = assertions(spark)
    early = {r.assertion_id for r in sampled_assertions(rows.where("load_batch < 2"), m).collect()}
    late = {r.assertion_id for r in sampled_assertions(rows.unionByName(rows.where("assertion_id < 50")), m).collect()}
    assert early and early == {i for i in late if i < 200}
