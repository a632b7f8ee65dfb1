"""Knowledge base of statements: files, appends, exact and canonical lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dist
from factloom.functions.text import canonical_symbol, let
from factloom.operators import atoms


def parse_statements(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """Adds name, body, kind, head, args, arity, truth value, value distribution and the canonical key of flat bodies. A
    negated flat body is a fact whose head is 'Not:head'."""
    s = F.col(column)
    inner = F.coalesce(atoms.body_of(s), F.regexp_extract(s, r"^\(:\s+[^\s()]+\s+(\([^()]+\)|\(Not\s+\([^()]+\)\s*\))\s+\(", 1))
    parsed = statements.withColumn("body", F.nullif(inner, F.lit("")))
    negated = F.regexp_extract("body", r"^\(Not\s+(\([^()]+\))\s*\)$", 1)
    flat = F.when(F.col("body").startswith("(Not"), F.coalesce(F.nullif(negated, F.lit("")), F.col("body"))).otherwise(F.col("body"))
    parsed = parsed.withColumn("sig", let(flat, atoms.parse_flat))
    mark = F.when(F.col("body").startswith("(Not"), "Not:").otherwise("")
    return parsed.select(
        "*",
        atoms.name_of(s).alias("name"),
        F.when(F.contains(s, F.lit("(Implication")), "rule").when(F.col("sig").isNotNull(), "fact").otherwise("other").alias("kind"),
        F.concat(mark, F.col("sig.head")).alias("head"),
        F.col("sig.args").alias("args"),
        F.col("sig.arity").alias("arity"),
        atoms.truth_of(s).alias("tv"),
        dist.parse_value(s).alias("dist"),
        F.concat(mark, canonical_key(F.col("sig"))).alias("canon_key"),
    ).drop("sig")


def canonical_key(sig: Column) -> Column:
    """Head and canonical arguments of a signature; equal for atoms that differ in the spelling of constants."""
    return F.when(sig.isNotNull(), F.concat_ws(" ", sig["head"], F.transform(sig["args"], lambda a: canonical_symbol(a))))


def accept(statements: DataFrame, column: str = "stmt") -> tuple[DataFrame, DataFrame]:
    """Valid statements, parsed, and rejected ones with their reason: two filters over one plan."""
    checked = atoms.validate(statements, column)
    good = parse_statements(checked.where(F.col("reason").isNull()).drop("reason"), column)
    return good, checked.where(F.col("reason").isNotNull()).select(F.col(column).alias("stmt"), "reason")


def append(statements: DataFrame, path: str, column: str = "stmt") -> DataFrame:
    """Appends valid statements to the table at path, partitioned by kind; returns the rejected ones."""
    good, bad = accept(statements, column)
    good.write.mode("append").partitionBy("kind").parquet(path)
    return bad


def _first_by(facts: DataFrame, key: str) -> DataFrame:
    """First fact of each key by seq, combined before the shuffle, so that a join meets one row per key. Keys are often
    computed, so facts are not filtered by the goals' keys first: that would compute them again."""
    return facts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min_by("stmt", "seq").alias("proof"))


def lookup_exact(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """goals(goal_id, goal) with the first fact (by seq) whose body is the ground goal's; NULL where there is none."""
    wanted = goals.select("goal_id", atoms.ground_goal(F.col("goal")).alias("key"))
    return wanted.join(_first_by(facts, "body"), "key", "left").select("goal_id", "proof")


def lookup_canonical(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """As lookup_exact, by head and canonical arguments."""
    wanted = goals.select("goal_id", canonical_key(atoms.parse_flat(atoms.ground_goal(F.col("goal")))).alias("key"))
    return wanted.join(_first_by(facts, "canon_key"), "key", "left").select("goal_id", "proof")


def lookup(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """Exact lookup, then canonical lookup for the goals without a match."""
    exact = lookup_exact(goals, facts)
    rest = goals.join(exact.where(F.col("proof").isNull()).select("goal_id"), "goal_id", "left_semi")
    return exact.where(F.col("proof").isNotNull()).unionByName(lookup_canonical(rest, facts))


def delete_by_source(rows: DataFrame, source: str) -> DataFrame:
    """Rows of other sources; those without a source stay."""
    return rows.where(~F.col("source").eqNullSafe(F.lit(source)))
