"""Micro-batch ingest and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from factloom.operators import kb

REQUEST = "request_id long, batch_no int, received_at timestamp, client string, setting_id int, texts array<string>"


def request_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(texts: DataFrame, translate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Translates each micro-batch and appends its valid statements; later batches see what earlier ones stored.

    A batch writes to a folder of its own number and overwrites it when it is repeated, so a restart adds nothing twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        good, bad = kb.accept(translate(batch))
        good.write.mode("overwrite").parquet(f"{out}/statements/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vocabulary(statements: DataFrame) -> DataFrame:
    """Predicates with their arities and numbers of uses, batch or stream."""
    return statements.where(F.col("head").isNotNull()).groupBy("head", "arity").agg(F.count(F.lit(1)).alias("uses"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts and sums per tumbling window and type. On a stream the watermark drops later events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: session windows per user."""
    rows = events.withWatermark("ts", gap) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
