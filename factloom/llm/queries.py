"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import collapse, dedup, leakage, packing, residue, sample, sentences, split
from factloom.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return sample.broken_samples(table(spark, sf, "conceptnet_manifest"), table(spark, sf, "conceptnet_assertions"))


def p1_replay(spark: SparkSession, sf: str) -> DataFrame:
    """What the Feistel sample of each export with a recorded count holds."""
    known = table(spark, sf, "conceptnet_manifest").where("sampled_row_count is not null")
    return sample.replayed_exports(known, table(spark, sf, "conceptnet_assertions")).select("manifest_id", "replayed_count")


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.sampled_assertions(table(spark, sf, "conceptnet_assertions"), table(spark, sf, "conceptnet_manifest"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.repeats(table(spark, sf, "ingest_item_results"), table(spark, sf, "vector_records"))


def p2_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The last batch checked against the stored history of all earlier ones."""
    return dedup.last_batch_repeats(table(spark, sf, "ingest_item_results"), table(spark, sf, "vector_records"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces_of(spark, sf).select("request_id", "text_no").distinct()


def p3_pieces_of(spark: SparkSession, sf: str) -> DataFrame:
    return split.oversized_requests(table(spark, sf, "ingest_requests"), table(spark, sf, "ingest_settings"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    cut = p3_pieces_of(spark, sf).dropDuplicates(["request_id", "text_no"])
    return cut.select("request_id", "text_no", F.posexplode("pieces").alias("piece_no", "piece"))


def p3_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per size: oversized texts, their characters, and pieces or texts that break a promise: pieces over the limit, texts
    that the pieces without their overlaps do not give back, overlaps that differ from the end before them."""
    rows = split.oversized_requests(table(spark, sf, "ingest_requests"), table(spark, sf, "ingest_settings"), keep_text=True).dropDuplicates(["request_id", "text_no"])
    over = F.least(F.greatest(F.col("chunk_overlap"), F.lit(0)), F.col("chunk_size") - 1)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("bad"))

    def step(acc, p):
        back = F.least(over, F.length(acc["text"]))
        return F.struct(F.concat(acc["text"], p.substr(back + 1, F.length(p))).alias("text"), (acc["bad"] + (F.right(acc["text"], back) != p.substr(F.lit(1), back)).cast("int")).alias("bad"))

    checked = rows.select("chunk_size", split.trimmed(F.col("text")).alias("whole"), F.aggregate("pieces", start, step).alias("r"), F.size(F.filter("pieces", lambda p: F.length(p) > F.col("chunk_size"))).alias("long"))
    return checked.groupBy("chunk_size").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("r.text")).alias("characters"), F.sum("long").cast("long").alias("over_limit"),
        F.sum("r.bad").cast("long").alias("bad_overlaps"), F.count_if(F.col("r.text") != F.col("whole")).alias("not_rebuilt"),
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = sentences.request_texts(table(spark, sf, "ingest_requests"))
    return sentences.sentences(texts, "text", ["request_id", "text_no"]).select("request_id", "text_no", "end_pos").distinct()


def _statement_keys(spark: SparkSession, sf: str) -> DataFrame:
    return collapse.statement_keys(*(table(spark, sf, t) for t in ("ingest_item_results", "vector_records", "background_jsonl")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = collapse.members(_statement_keys(spark, sf))
    return groups.where(F.col("id") != F.col("first_id")).select("table_name", "first_id", F.col("id").alias("copy_id"))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of each number of copies, and the records in them."""
    counts = collapse.collapse(_statement_keys(spark, sf))
    return counts.groupBy("copies").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("copies").alias("n_records"))


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_sizes(table(spark, sf, "documents")), table(spark, sf, "context_budgets"))


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """The documents packed by characters: what is placed per capacity, and containers or items that break a promise."""
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.length("text").cast("long").alias("tokens"))
    rows = packing.pack(docs, table(spark, sf, "context_budgets"))
    bins = rows.groupBy("budget_id", "capacity", "bin").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("pieces"), F.count_if((F.col("piece") > 0) & (F.col("tokens") > F.col("capacity"))).alias("bad"))
    return bins.groupBy("budget_id").agg(
        F.sum("held").alias("placed"), F.sum("pieces").alias("pieces"), F.count_if(F.col("held") > F.col("capacity")).alias("overfull"),
        (F.sum("held") >= 0.9 * F.sum("capacity")).alias("well_filled"),
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "benchmark_cases")).select("case_id", "doc_id")


def p7_longest(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.longest_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark_cases"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by label and by what found it: a rule, the SimHash tables or the prefix filter."""
    return residue.residue(table(spark, sf, "documents")).groupBy("label", "found_by").agg(F.countDistinct("doc_id").alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (p1_found, p1_replay, p1_sample, p2_found, p2_batch, p3_found, p3_pieces, p3_check, p4_found, p5_found, p5_counts, p6_pack, p6_check, p7_found, p7_longest, p8_found, p8_labels)
    return {f.__name__: f for f in each}
