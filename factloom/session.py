"""Session helpers: table loading and cutting lineage in a folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **config: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; config overrides what is set here."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("factloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "factloom-warehouse"))
        .config(map=config)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the session's checkpoint folder; where neither is set, a temporary one
    on a single machine and an error on a cluster, whose executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="factloom-"))
        atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
    return f"file://{_local_dirs[0]}"


#: One folder for the intermediate tables of this process.
_RUN = f"factloom/{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{_RUN}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes the intermediate tables of this process. DataFrames that read them end with it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_RUN}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Later plans start from files that every executor can read again, so a lost executor costs a reread
    and not the whole lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
