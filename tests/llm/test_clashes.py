"""Every operator over tables with extra columns of clashing names, NULLs in every column and repeated rows."""

import pytest
from pyspark.sql import functions as F

from factloom.llm import collapse, dedup, leakage, packing, residue, sample, sentences, split

EXTRA = ("key", "id", "label", "core", "tokens", "words", "bodies", "first", "later", "salt", "s", "steps", "replayed_count", "each", "pieces", "ends", "predicate", "weight", "part", "bin", "closed", "copies", "n", "view", "token")


@pytest.fixture(scope="module")
def tables(spark, sf):
    def load(name, rows=60):
        df = spark.read.parquet(f"{sf}/{name}.parquet").limit(rows)
        nulls = df.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        df = df.unionByName(df.limit(3)).unionByName(nulls)
        return df.withColumns({c: F.lit("x") for c in EXTRA if c not in df.columns}).cache()

    return {n: load(n) for n in ("conceptnet_assertions", "conceptnet_manifest", "ingest_requests", "ingest_item_results", "vector_records", "background_jsonl", "benchmark_cases", "ingest_settings", "context_budgets", "documents")}


def test_all(tables):
    t = tables
    assert sample.broken_samples(t["conceptnet_manifest"], t["conceptnet_assertions"]).count() >= 0
    assert sample.sampled_assertions(t["conceptnet_assertions"], t["conceptnet_manifest"]).count() >= 0
    assert dedup.repeats(t["ingest_item_results"], t["vector_records"]).columns == ["first_item_id", "later_item_id"]
    assert split.oversized_requests(t["ingest_requests"], t["ingest_settings"]).count() > 0
    texts = sentences.request_texts(t["ingest_requests"])
    assert sentences.sentences(texts, "text", ["request_id", "text_no"]).count() > 0
    keys = collapse.statement_keys(t["ingest_item_results"], t["vector_records"], t["background_jsonl"])
    assert collapse.members(keys).count() == keys.count() > 0
    packed = packing.pack(packing.token_sizes(t["documents"]), t["context_budgets"])
    assert packed.groupBy("bin").agg(F.sum("tokens").alias("n"), F.first("capacity").alias("c")).where("n > c").count() == 0
    assert leakage.leaked(t["documents"], t["benchmark_cases"]).count() >= 0
    assert leakage.remove_leaked(t["documents"], t["benchmark_cases"]).count() > 0
    assert residue.residue(t["documents"]).count() >= 0
    assert residue.without_residue(t["documents"]).count() > 0
