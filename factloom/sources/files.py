"""Files: statements, background triples and records, suites, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import slug

TRIPLE_COLUMNS = ("uri", "relation", "start_uri", "end_uri", "metadata_json")
RECORD = "nl string, pln array<string>, source string, background boolean, relation string"
CASE = "name string, id string, case_id string, category string, texts array<string>, premises array<string>, input_text string, question string, user_query string, expected_proof string"


def statements(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """One statement a line; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("stmt")).where(F.col("stmt") != "")
    return lines.withColumn("source", F.lit(source)) if source else lines


def scanned_triples(spark: SparkSession, path: str, max_rows: int = 0) -> tuple[DataFrame, int]:
    """Triples with their line number seq, and the number of lines scanned; with max_rows the line that goes beyond it is
    scanned, not used (S5)."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())  # one task reads a file's lines in order
    total = lines.count()
    if max_rows and total > max_rows:
        lines, total = lines.orderBy("seq").limit(max_rows), max_rows + 1
    fields = F.split("value", "\t")
    rows = lines.where(F.size(fields) >= 5).select("seq", *[fields[i].alias(c) for i, c in enumerate(TRIPLE_COLUMNS)])
    return (rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else rows), total


RESULT = (
    "`case`: struct<name: string>, timing: struct<ingest_seconds: double, query_seconds: double, total_seconds: double>, "
    "end_to_end: struct<query: struct<original_query: string, executed_query: string, query_status: string, fallback_used: boolean, "
    "context_retrieval_seconds: double, parse_query_seconds: double, reasoning_seconds: double, source_lookup_seconds: double, "
    "answer_generation_seconds: double>>, proof_found: boolean, correct: boolean"
)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result artifacts of comparisons, {parser: [row, ...]} under 'results' or at the top, as one row per parser and case
    in the form that metrics.analysis_summary reads (S13, T54)."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.results"), F.col("value"))
    rows = whole.select(F.explode(F.from_json(inner, f"map<string, array<struct<{RESULT}>>>")).alias("parser", "rows"))
    each = rows.select("parser", F.explode("rows").alias("r"))
    q, t = "r.end_to_end.query", "r.timing"
    return each.select(
        "parser", F.col("r.case.name").alias("name"), F.coalesce("r.proof_found", F.lit(False)).alias("proof_found"), F.col("r.correct").alias("correct"),
        F.col(f"{q}.query_status").alias("status"), F.coalesce(f"{q}.fallback_used", F.lit(False)).alias("fallback_used"), f"{q}.original_query", f"{q}.executed_query",
        f"{t}.ingest_seconds", f"{t}.query_seconds", F.col(f"{t}.total_seconds").alias("seconds"),
        *[F.col(f"{q}.{c}") for c in ("context_retrieval_seconds", "parse_query_seconds", "reasoning_seconds", "source_lookup_seconds", "answer_generation_seconds")],
    )


def triples(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """Tab-separated triples, plain or gzipped; lines with fewer than five fields are skipped, further fields ignored.

    A gzipped file is one task's to read, so its rows are spread afterwards. With max_rows only that many lines are
    read, in order.
    """
    lines = spark.read.text(path)
    if max_rows:
        lines = lines.limit(max_rows)
    fields = F.split("value", "\t")
    rows = lines.where(F.size(fields) >= 5).select(*[fields[i].alias(c) for i, c in enumerate(TRIPLE_COLUMNS)])
    return rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else rows


def records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with nl and pln; other lines are skipped."""
    rows = spark.read.schema(RECORD + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("nl").isNotNull() & F.col("pln").isNotNull()).drop("_bad")


def cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Benchmark cases of either spelling: question or user_query, texts, premises or input_text; from one JSON list a
    file, or from JSON lines."""
    raw = spark.read.schema(CASE).option("multiLine", multi_line).json(path)
    name = F.coalesce("name", "id", "case_id", slug(F.coalesce("question", "user_query", F.lit("case"))))
    texts = F.coalesce("texts", "premises", F.when(F.col("input_text").isNotNull(), F.array("input_text")))
    expected = F.when(F.col("expected_proof").isNotNull(), F.lower(F.trim("expected_proof")).isin("1", "true", "yes", "y"))
    return raw.select(name.alias("name"), "id", "case_id", F.coalesce("category", F.lit("external")).alias("category"), texts.alias("texts"), F.coalesce("question", "user_query").alias("question"), expected.alias("expected_proof"))


def pick_cases(rows: DataFrame, wanted: str | list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Cases whose case_id, id or name is wanted; at most limit of them."""
    if wanted is not None:
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        rows = rows.where(F.col("case_id").cast("string").isin(names) | F.col("id").cast("string").isin(names) | F.col("name").isin(names))
    return rows.limit(limit) if limit else rows


def context(spark: SparkSession, path: str) -> DataFrame:
    """Context statements: a JSON list, or text of one a line."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "array<string>")).alias("stmt"))
    return statements(spark, path)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest as a dictionary; None where it is missing."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("multiLine", True).json(path).limit(1).collect()
    except AnalysisException:
        return None
    return rows[0].asDict(recursive=True) if rows else None


def is_stale(found: dict | None, source_file: str, version: int, min_weight: float, coverage: float, seed: int) -> bool:
    want = {"source_file": source_file, "normalization_version": version, "min_weight": min_weight, "coverage_percent": coverage, "sample_seed": seed}
    return found is None or any(found.get(k) != v for k, v in want.items())


def stale(version: int, min_weight: float, coverage: float, seed: int) -> Column:
    """Whether a manifest row was made with other settings; NULLs count as other."""
    want = {"normalization_version": version, "min_weight": min_weight, "coverage_percent": coverage, "sample_seed": seed}
    out = F.lit(False)
    for name, value in want.items():
        out = out | ~F.col(name).eqNullSafe(F.lit(value))
    return out


def write_background(emitted: DataFrame, atoms_path: str, records_path: str) -> None:
    """Atom lines and JSON records of emitted triples."""
    emitted.select("atom").write.mode("overwrite").text(atoms_path)
    emitted.select("nl", "pln", "source", "background", "relation").write.mode("overwrite").json(records_path)


def lines_sha256(lines: DataFrame, column: str) -> str:
    """SHA-256 over the sorted SHA-256 of the lines: the same for every layout of files. The hashes are reduced in 4,096
    groups before the last step."""
    h = lines.select(F.sha2(column, 256).alias("h"))
    groups = h.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", "h"))), ""), 256).alias("h")).first().h


def write_manifest(counts: dict, path: str) -> None:
    """A manifest of sorted keys as one JSON file, in the file system of the path."""
    import json

    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(json.dumps(counts, indent=2, sort_keys=True).encode())
    out.close()


def needs_reindex(existing: int, expected: int) -> bool:
    """Whether an index has to be rebuilt: it is empty, or holds fewer records than expected."""
    return not (existing > 0 and (expected == 0 or existing >= expected))
