"""Problem 5: records that differ only in layout, collapsed to one each and counted.

Keys that many rows share are found exactly by partial counts: each input partition keeps counters of bounded number
that fall short of the true counts by at most 1/(2 MAX_HOT) of its rows; summed up they name at most 2 MAX_HOT keys that
contain all keys held by 1/MAX_HOT of all rows, and an exact count of just those follows. Hot keys are counted in two
levels with a salt and joined back as a broadcast of at most MAX_HOT rows, so their rows are never shuffled together;
all other keys take one shuffle, in which no group is larger than 1/MAX_HOT of the rows. The representative is the
smallest identifier.

What counts as formatting is the class of characters that a canonical text keeps: letters, marks, digits and symbols by
default, so that vowel signs and signs of operation tell records apart; the statement tables keep letters and digits
only, as their records are defined.

Defined cases: rows with a NULL key are no records and are left out; rows with a NULL identifier count as copies
but never represent; repeated rows with one identifier count as often as they come; an empty input gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

#: Most keys that can be hot; each of them then holds at least 1/MAX_HOT of the rows.
MAX_HOT = 1000
SALTS = 32


#: Characters that a canonical text keeps.
CONTENT = r"\p{L}\p{M}\p{N}\p{S}"
LETTERS_AND_DIGITS = r"\p{L}\p{N}"


def canonical(text: Column, keep: str = CONTENT) -> Column:
    """What counts as content, in lower case."""
    return F.regexp_replace(F.lower(text), rf"[^{keep}]+", "")


def canonical_array(values: Column, keep: str = CONTENT) -> Column:
    """Canonical statements in sorted order; NULL for a NULL or empty array. NULL statements are skipped."""
    kept = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_sort(F.transform(kept, lambda x: canonical(x, keep))))


def content_key(*parts: Column) -> Column:
    """128-bit key of canonical parts: strings or arrays of canonical strings, which hold no control characters."""
    return F.unhex(F.md5(F.concat_ws("\x1e", *[F.coalesce(p, F.lit("\x00")) for p in parts])))


def _frequent(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the partition with counts that fall short by at most 1/(2 MAX_HOT) of its rows: frequent-items counters."""
    counts: dict[bytes, int] = {}
    for batch in rows:
        for item in pc.value_counts(batch.column(0)).to_pylist():
            counts[item["values"]] = counts.get(item["values"], 0) + item["counts"]
        if len(counts) > 4 * MAX_HOT:  # take from all what the smallest beyond the bound has
            least = sorted(counts.values(), reverse=True)[2 * MAX_HOT]
            counts = {k: n - least for k, n in counts.items() if n > least}
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])


def hot_keys(keyed: DataFrame) -> DataFrame:
    """key, first_id, copies of exactly the keys that hold at least 1/MAX_HOT of the rows, and over 1,000 rows."""
    total = keyed.count()
    need = max(1000, -(-total // MAX_HOT))
    if total < need:
        return keyed.select("key", F.col("id").alias("first_id"), F.lit(0).cast("long").alias("copies")).limit(0)
    counted = keyed.select("key").mapInArrow(_frequent, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    maybe = counted.where(F.col("n") >= need - total / (2 * MAX_HOT)).select("key")  # at most 2 MAX_HOT rows
    partial = (
        keyed.join(F.broadcast(maybe), "key", "left_semi")
        .groupBy("key", (F.xxhash64("id") % SALTS).alias("salt"))
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )
    return (
        partial.groupBy("key")
        .agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
        .where(F.col("copies") >= need)
    )


def members(keyed: DataFrame) -> DataFrame:
    """keyed(key binary, id long, ...) with first_id and copies of its group, for every row with a key.

    keyed should be cheap to read more than once (a written table).
    """
    keyed = keyed.where(F.col("key").isNotNull())
    hot = materialize(hot_keys(keyed), "hot-keys")  # at most MAX_HOT rows
    group = F.expr("min(id) over (partition by key)"), F.expr("count(*) over (partition by key)")
    cold = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").select("*", group[0].alias("first_id"), group[1].alias("copies"))
    return cold.unionByName(keyed.join(F.broadcast(hot), "key"))


def collapse(keyed: DataFrame) -> DataFrame:
    """key, first_id, copies: one row per group, with the map-side combine that a plain aggregate gives to all keys."""
    keyed = keyed.where(F.col("key").isNotNull())
    hot = materialize(hot_keys(keyed), "hot-keys")
    cold = (
        keyed.join(F.broadcast(hot.select("key")), "key", "left_anti")
        .groupBy("key")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )
    return cold.unionByName(hot)


# The three tables of statements.

RECORD = "nl string, pln array<string>, source string, background string, relation string"


def item_keys(items: DataFrame) -> DataFrame:
    return items.select(F.lit("ingest_item_results").alias("table_name"), F.col("item_id").alias("id"), _key("i", canonical_array(F.col("atoms"), LETTERS_AND_DIGITS)).alias("key"))


def record_keys(records: DataFrame) -> DataFrame:
    return records.select(F.lit("vector_records").alias("table_name"), F.col("record_id").alias("id"), _key("v", canonical_array(F.col("pln"), LETTERS_AND_DIGITS)).alias("key"))


def line_keys(lines: DataFrame) -> DataFrame:
    """Only lines that are one JSON object with nl and pln; keys by all five fields, absent like NULL."""
    schema = RECORD + ", _bad string"
    whole = F.col("line").rlike(r"^\s*\{[\s\S]*\}\s*$")
    r = F.from_json("line", schema, {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    parsed = lines.where(whole).select(F.col("line_id").alias("id"), r.alias("r"))
    plain = [F.coalesce(F.concat(F.lit("="), F.col(f"r.{c}")), F.lit("\x00")) for c in ("source", "background", "relation")]
    key = _key("b", canonical_array(F.col("r.pln"), LETTERS_AND_DIGITS), canonical(F.col("r.nl"), LETTERS_AND_DIGITS), *plain)
    good = F.col("r._bad").isNull() & F.col("r.nl").isNotNull() & F.col("r.pln").isNotNull()
    return parsed.where(good).select(F.lit("background_jsonl").alias("table_name"), "id", key.alias("key"))


def _key(kind: str, statements: Column, *rest: Column) -> Column:
    """NULL where there is no statement; the kind keeps the tables' groups apart."""
    return F.when(statements.isNotNull(), content_key(F.lit(kind), F.array_join(statements, "\x1f"), *rest))


def statement_keys(items: DataFrame, records: DataFrame, lines: DataFrame) -> DataFrame:
    """table_name, id, key of all three tables, written once: later passes read 30 bytes a row and no text."""
    return materialize(item_keys(items).unionByName(record_keys(records)).unionByName(line_keys(lines)).where(F.col("key").isNotNull()), "statement-keys")
