"""Benchmark and ingest metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def proof_found(proof: Column) -> Column:
    p = F.trim(F.coalesce(proof, F.lit("")))
    return (p != "") & (p != "[]")


def goal_head(query: Column) -> Column:
    """Predicate of a goal (: $prf atom $tv), through a Not; '__unparsed__' where there is none (T53)."""
    q = F.trim(F.regexp_replace(query, r"\s+", " "))
    atom = F.regexp_extract(q, r"^\(: [$?]\S+ (\(.+\)) [$?]\S+\)$", 1)
    inner = F.regexp_extract(atom, r"^\(Not\s+(\(.+\))\)$", 1)
    head = F.regexp_extract(F.when(inner != "", inner).otherwise(atom), r"^\(([A-Za-z][A-Za-z0-9_]*)\b.*\)$", 1)
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("__unparsed__"))


def parser_summary(results: DataFrame) -> DataFrame:
    """results(parser, proof_found, expected, status, fallback_used, seconds): one row per parser, one shuffle."""
    known = F.col("expected").isNotNull()
    return results.groupBy("parser").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(known & (F.col("proof_found") == F.col("expected"))).alias("correct"),
        F.count_if(known).alias("correct_known"),
        F.count_if("proof_found").alias("proof_found"),
        F.count_if(F.col("status") == "no_query").alias("no_query"),
        F.count_if(F.col("status") == "weakly_aligned").alias("weakly_aligned"),
        F.count_if("fallback_used").alias("fallback_used"),
        F.round(F.avg("seconds"), 4).alias("avg_seconds"),
        F.round(F.median("seconds"), 4).alias("median_seconds"),
    )


BREAKDOWN = ("context_retrieval_seconds", "parse_query_seconds", "reasoning_seconds", "source_lookup_seconds", "answer_generation_seconds")


def analysis_summary(results: DataFrame) -> DataFrame:
    """Rates per parser; a proof is a proxy if the heads of the original and the executed goal differ, which is taken over
    proved cases only. Medians are over present values; missing times of ingest and query count as 0 in their sum."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a, b = goal_head(F.coalesce("original_query", F.lit(""))), goal_head(F.coalesce("executed_query", F.lit("")))
    proved = F.col("proof_found")
    timed = [c for c in BREAKDOWN if c in results.columns]
    return results.groupBy("parser").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(proved).alias("proofs"),
        share(proved).alias("proof_rate"),
        share(F.col("fallback_used")).alias("fallback_rate"),
        share(F.col("status") == "no_query").alias("no_query_rate"),
        F.coalesce(F.avg(F.when(proved, F.when(a != b, 1.0).otherwise(0.0))), F.lit(0.0)).alias("proxy_rate"),
        F.count_if(proved & ((a == "__unparsed__") | (b == "__unparsed__"))).alias("unparsed_heads"),
        F.median(F.coalesce("ingest_seconds", F.lit(0.0)) + F.coalesce("query_seconds", F.lit(0.0))).alias("median_ingest_plus_query"),
        *[F.median(c).alias(f"median_{c}") for c in timed],
    )


def ingest_counters(chunks: DataFrame, checked: DataFrame, key: str = "doc_id", batch_size: int = 4) -> DataFrame:
    """chunks(key, chunk_no, chunk) and checked statements(key, chunk_no, stmt, reason): counters, first three rejected
    samples and status per text. A text fails if it has chunks and none gave a statement.

    Of the rejected ones only the three smallest by place are kept while counting, not all of them.
    """
    per_chunk = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct(F.floor(F.col("chunk_no") / batch_size)).alias("batch_count"))
    rejected = checked.where(F.col("reason").isNotNull()).select(key, F.struct("chunk_no", "stmt", "reason").alias("r"))
    ranked = rejected.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("r"))).where("k <= 3")
    samples = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["stmt"]).alias("rejected_samples"))
    counts = checked.groupBy(key).agg(F.count_if(F.col("reason").isNull()).alias("n_atoms"), F.count_if(F.col("reason").isNotNull()).alias("rejected_count"), F.countDistinct("chunk_no").alias("answered"))
    out = per_chunk.join(counts, key, "left").join(samples, key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        key, "chunk_count", "batch_count", n("n_atoms"), n("rejected_count"), (F.col("chunk_count") - n("answered")).alias("empty_results"),
        F.coalesce("rejected_samples", F.array().cast("array<string>")).alias("rejected_samples"),
        F.when((F.col("chunk_count") > 0) & (n("n_atoms") == 0), "failed").otherwise("success").alias("status"),
    )


QUICK = {"smoke": 5, "entailmentbank": 3, "abstracts": 6}


def select_cases(cases: DataFrame, suite: str, quick: bool = False, order: str = "case_id") -> DataFrame:
    """Cases of a suite, or of all suites for 'combined'; quick takes the first few of each."""
    if suite == "combined":
        parts = [select_cases(cases, s, quick, order) for s in QUICK]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    mine = cases.where(F.col("suite") == suite)
    return mine.orderBy(order).limit(QUICK[suite]) if quick else mine
