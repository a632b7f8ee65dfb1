"""Facts out of the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import table


def fact(rows: DataFrame, head: str, a: Column, b: Column, dist: Column | None = None) -> DataFrame:
    """A certain fact head(a, b) of each row, with a value distribution where given."""
    extra = [] if dist is None else [dist.alias("dist")]
    return rows.select(F.lit(head).alias("head"), F.array(a, b).alias("args"), F.lit(1.0).alias("s"), F.lit(1.0).alias("c"), *extra)


def named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.col(key).cast("string"))


def locations(spark: SparkSession, sf: str) -> DataFrame:
    s = fact(table(spark, sf, "supplier"), "AtLocation", named("supplier", "s_suppkey"), named("nation", "s_nationkey"))
    c = fact(table(spark, sf, "customer"), "AtLocation", named("customer", "c_custkey"), named("nation", "c_nationkey"))
    return s.unionByName(c)


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return fact(table(spark, sf, "nation"), "PartOf", named("nation", "n_nationkey"), named("region", "n_regionkey"))


def classes(spark: SparkSession, sf: str) -> DataFrame:
    return fact(table(spark, sf, "customer"), "IsA", named("customer", "c_custkey"), F.lower("c_mktsegment"))


def orders_by(spark: SparkSession, sf: str) -> DataFrame:
    return fact(table(spark, sf, "orders").select("o_custkey").distinct(), "Ordered", named("customer", "o_custkey"), F.lit("something"))
