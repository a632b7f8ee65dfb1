"""Problem 2: new batches deduplicated against all history.

A persistent table maps chunks to the accepted records that hold them, with the size of each chunk; a batch looks its
chunks up in it, adds up what a pair of records shares, verifies the pairs whose coverage is high enough and appends the
chunks of what it accepts. History is read as this narrow table, only in the buckets that the batch touches, and as the
token hashes of records in a pair; never as texts, and what was rejected is never read again.

Chunks. Repeats are defined on sets of words and of statement bodies in any order, so both are put into one fixed order
first, rarest token first, and the rare end of it is chunked: the hash of a token is the rolling hash of a window of one,
and a chunk ends behind each token whose hash falls on a boundary (one in CHUNK_TOKENS). Words that moved then change
nothing, and a word that differs changes the chunk around it only. The frequent end makes no chunks: they would be hot
keys. A pair that shares COVERAGE of the smaller record's bytes in chunks is a candidate.

Chunks alone lose pairs whose differences touch every chunk (see the README), so the single tokens of the rare end are
stored beside them as an exact way for the rest (a chunk of one token is that token): two records that share 0.7 of their
tokens must share two of the first n - ceil(0.7 n) + 2 of each, which is the rare end. Both kinds of keys lie in one table
and take one join. What a candidate pair shares in all decides, counted exactly.

A batch is added by History.add. Within a batch items repeat each other too. A batch is taken in slices of identifier
order, the first one small: a family of near-copies is then represented in the table after its first slice and later
members meet that one representative instead of each other, so the pairs of a family are bounded by the first slice's
size. Exact copies are reduced to their first before, by hashes, and share what is decided for it. Pairs are resolved in
rounds: an item without an undecided smaller neighbour is accepted, its neighbours are rejected.

Defined cases: only items with status 'success' take part; NULL nl and NULL or empty atoms give an empty set, which
shares nothing; an item without a stored record is compared by its statements; of several stored records the one with
the smallest record_id counts; repeated rows of one item_id count once; items without batch_no belong to the backlog.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.collapse import members
from factloom.session import materialize, scratch_path

#: Shared part of all tokens from which on an item repeats another, as tenths.
TENTHS = 7
#: Stored tokens that a candidate pair must share; sets of one token share that one.
SHARED = 2
#: Tokens of a chunk on average, and the part of the smaller record's bytes that a candidate pair shares in chunks of the
#: rare end, which holds about a third of them.
CHUNK_TOKENS = 3
COVERAGE = 0.05
#: Most tokens that are ordered by frequency, the most frequent ones; the order decides about speed only.
ORDERED_TOKENS = 50_000
#: Most rows of identifiers, and of keys, that are broadcast: some 5 and some 25 MB.
BROADCAST_ROWS = 200_000
BROADCAST_KEYS = 400_000
#: Folders of the key table by the key's hash.
BUCKETS = 16
FIRST_SLICE = 15_000
SLICE_GROWTH = 20

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: ( or [, the colon, the name, then the body up to the last bracket that opens the truth value.
BODY = re.compile(r"[^(\[{]*[(\[{]\s*:[^(\[{]*([(\[{].*)[(\[{][^(\[{]*\Z", re.S)
PLAIN = re.compile(r"[\W_]+")


def statement_body(statement: str) -> str:
    """Letters and digits of the body of `(: name body tv)` in lower case; of all of it where it has another form."""
    found = BODY.match(statement)
    return PLAIN.sub("", (found.group(1) if found else statement).lower())


def _hash(tokens: set[str]) -> list[int]:
    return sorted(xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in tokens)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        nl, atoms = batch.column("nl").to_pylist(), batch.column("atoms").to_pylist()
        words = [_hash(set(WORD.findall(t.lower()))) if t else [] for t in nl]
        bodies = [_hash({b for a in s if a and (b := statement_body(a))}) if s else [] for s in atoms]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("batch_no"), pa.array(words, kind), pa.array(bodies, kind)], names=["item_id", "batch_no", "words", "bodies"]
        )


def hashed_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """item_id, batch_no and the token hashes of both views of each successful item."""
    done = items.where((F.col("status") == "success") & F.col("item_id").isNotNull()).select("item_id", "batch_no", "atoms").dropDuplicates(["item_id"])
    stored = records.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min_by("nl", "record_id").alias("nl"))
    both = done.join(stored, "item_id", "left")
    return both.mapInArrow(_tokens, "item_id long, batch_no int, words array<long>, bodies array<long>")


def _ordered(ranked: tuple[np.ndarray, np.ndarray]):
    """Sorts token arrays by (frequency, hash) and adds the keys of the key table: kind, key, the bytes that sharing it
    adds and the bytes of the whole. Kinds 0 and 1 are looked-up tokens of words and bodies, 2 and 3 their chunks."""
    known, often = ranked

    def one(column: pa.ListArray, view: int) -> tuple[pa.Array, tuple[np.ndarray, ...]]:
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
        df = np.where(known[at] == values, often[at], 0) if len(known) else np.zeros(len(values), np.int64)
        order = np.lexsort((values, df, row))
        values = values[order]
        least = (TENTHS * n + 9) // 10
        look = n - least + np.minimum(SHARED, least)
        inside = np.flatnonzero(np.arange(len(values)) - np.repeat(offsets[:-1], n) < np.repeat(look, n))
        mixed = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        ends = (mixed >> np.uint64(40)) % np.uint64(CHUNK_TOKENS) == 0
        rare, rare_row, ends = mixed[inside], row[inside], ends[inside]
        begin = np.flatnonzero(np.concatenate(([True], ends[:-1] | (rare_row[1:] != rare_row[:-1])))) if len(rare) else np.zeros(0, np.int64)
        chunk = np.add.reduceat(rare, begin).view(np.int64) if len(begin) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((begin, [len(rare)])))
        several = size > 1
        begin, chunk, size = begin[several], chunk[several], size[several]
        keys = (
            np.concatenate((rare_row, rare_row[begin])),
            np.concatenate((np.full(len(inside), view), np.full(len(begin), view + 2))).astype(np.int8),
            np.concatenate((values[inside], chunk)),
            np.concatenate((np.full(len(inside), 8), 8 * size)).astype(np.int32),
            8 * np.concatenate((n[rare_row], n[rare_row[begin]])).astype(np.int32),
        )
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, a = one(batch.column("words"), 0)
            bodies, b = one(batch.column("bodies"), 1)
            row, *fields = (np.concatenate(x) for x in zip(a, b))
            order = np.argsort(row, kind="stable")
            each = pa.StructArray.from_arrays([pa.array(f[order]) for f in fields], names=["kind", "key", "part", "whole"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), each)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("batch_no"), words, bodies, keys], names=["item_id", "batch_no", "words", "bodies", "keys"])

    return run


SETS = "item_id long, batch_no int, words array<long>, bodies array<long>"
KEYED = SETS + ", keys array<struct<kind: tinyint, key: bigint, part: int, whole: int>>"
KEYS = "item_id long, kind tinyint, key long, part int, whole int, bucket int"


ORDER = "t long, count long"


def _token_counts(hashed: DataFrame) -> DataFrame:
    """The most frequent tokens, of at least one item in a thousand, with their counts."""
    least = F.greatest(F.lit(2), F.lit(hashed.count() // 1000))
    counts = hashed.select(F.explode(F.concat("words", "bodies")).alias("t")).groupBy("t").count().where(F.col("count") >= least)
    return counts.orderBy(F.desc("count"), "t").limit(ORDERED_TOKENS)


def _sorted_order(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    counts = counted.toArrow()
    tokens, often = counts.column("t").to_numpy(), counts.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], often[order]


def token_order(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counted tokens, sorted by token. A history stores its own and keeps it."""
    return _sorted_order(_token_counts(hashed))


def _keys(keyed: DataFrame) -> DataFrame:
    """The rows of the key table."""
    return keyed.select("item_id", F.inline("keys")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))


def _alike(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return (shared > 0) & (10 * shared >= TENTHS * (F.size(a) + F.size(b) - shared))


def _small(rows: DataFrame) -> DataFrame:
    """rows (a written table of one or two identifiers) as a broadcast if they are few, else for a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _without(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """keyed without the items of ids(item_id)."""
    return keyed.join(_small(ids), "item_id", "left_anti").select(*keyed.columns)


def _verified(pairs: DataFrame, earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The pairs (first, later) that share enough of either view. Token sets are only moved for items in a pair."""
    pairs = materialize(pairs, "pairs")
    firsts = materialize(pairs.select(F.col("first").alias("item_id")).distinct(), "firsts")
    a = earlier.join(_small(firsts), "item_id", "left_semi").selectExpr("item_id as first", "words as aw", "bodies as ab")
    b = later.selectExpr("item_id as later", "words as bw", "bodies as bb")
    both = b.join(_small(pairs), "later").join(a, "first")
    return both.where(_alike(F.col("aw"), F.col("bw")) | _alike(F.col("ab"), F.col("bb"))).select("first", "later")


def _candidates(earlier: DataFrame, later: DataFrame, ordered: bool) -> DataFrame:
    """Pairs (first, later) that share enough bytes of chunks, or two looked-up tokens."""
    a = earlier.selectExpr("kind", "key", "item_id as first", "whole as aw")
    b = later.selectExpr("kind", "key", "item_id as later", "whole as bw", "part")
    sizes = (10 * F.least("aw", "bw") >= TENTHS * F.greatest("aw", "bw")) & (F.lit(True) if not ordered else F.col("first") < F.col("later"))
    met = a.join(b, ["kind", "key"]).where(sizes).groupBy("first", "later", "kind").agg(F.sum("part").alias("shared"), F.min(F.least("aw", "bw")).alias("whole"))
    covered = F.when(F.col("kind") >= 2, F.col("shared") >= COVERAGE * F.col("whole")).otherwise(F.col("shared") >= F.least(F.lit(8 * SHARED), F.col("whole")))
    return met.where(covered).select("first", "later").distinct()


def _copies(hashed: DataFrame) -> DataFrame:
    """item_id and same_as of each item with both sets like those of a smaller one: what is decided for that one holds
    for it, so copies are never looked up and never meet each other. Only 128-bit hashes are shuffled, and those of sets
    that many items have are not (see collapse)."""
    some = hashed.where((F.size("words") > 0) | (F.size("bodies") > 0))
    both = F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("words", "bodies"), F.xxhash64(F.lit(1), "bodies", F.lit(2), "words"))])
    groups = members(materialize(some.select(F.unhex(both).alias("key"), F.col("item_id").alias("id")), "item-keys"))
    return groups.where("id <> first_id").select(F.col("id").alias("item_id"), F.col("first_id").alias("same_as"))


class History:
    """Accepted records with their keys, in the shared folder: one part per slice, and beside them the token order by
    which all are stored. A History opened on an existing path goes on with what is there.

    A part counts once its last table is written to its end; what an interrupted write left is written over. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path, self.parts = spark, path or scratch_path(spark, "history"), 0
        self.order = self._stored_order() if self._complete("order") else None
        while self._complete(f"items/{self.parts}"):
            self.parts += 1
        if self.parts and self.order is None:
            raise ValueError(f"{self.path} has parts but no token order")

    def _complete(self, folder: str) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def _stored_order(self) -> tuple[np.ndarray, np.ndarray]:
        return _sorted_order(self.spark.read.schema(ORDER).parquet(f"{self.path}/order"))

    def accepted(self) -> DataFrame:
        return self.spark.read.schema(SETS).parquet(*[f"{self.path}/items/{k}" for k in range(self.parts)])

    def keys(self, buckets: list[int]) -> DataFrame:
        """The key table in the buckets."""
        parts = [self.spark.read.schema(KEYS).parquet(f"{self.path}/keys/{k}") for k in range(self.parts)]
        return functools.reduce(DataFrame.unionByName, parts).where(F.col("bucket").isin(buckets))

    def append(self, keyed: DataFrame) -> None:
        """One file per bucket and part: only what was accepted is shuffled, by the hash of its key."""
        keys = _keys(keyed).repartition(BUCKETS, "bucket")
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/{self.parts}")
        keyed.select("item_id", "batch_no", "words", "bodies").write.mode("overwrite").parquet(f"{self.path}/items/{self.parts}")
        self.parts += 1

    def keyed(self, hashed: DataFrame) -> DataFrame:
        """The items in the stored order, written once; the first batch decides the order."""
        if self.order is None:
            _token_counts(hashed).write.mode("overwrite").parquet(f"{self.path}/order")
            self.order = self._stored_order()
        return materialize(hashed.mapInArrow(_ordered(self.order), KEYED), "keyed-items")

    def add(self, hashed: DataFrame) -> DataFrame:
        """Adds a batch (hashed_items, or keyed_items of any order), whose item_ids follow those added before; returns
        (first, later) of what repeats an accepted item, with the smallest one that it repeats. The batch should be cheap
        to read more than once (a written table)."""
        hashed = hashed.select("item_id", "batch_no", "words", "bodies")
        span = hashed.agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        none = self.spark.createDataFrame([], "first long, later long")
        if not span.n:
            return none
        keyed = self.keyed(hashed)
        copies = materialize(_copies(keyed), "copies")
        rest = _without(keyed, copies.select("item_id"))
        out = none
        for a, b in _slices(keyed, span.lo, span.hi, span.n):
            for part in self.add_slice(rest.where(F.col("item_id").between(a, b))):
                out = out.unionByName(part)
        out = materialize(out, "repeats")
        of_copies = copies.join(out.selectExpr("first as head", "later as same_as"), "same_as", "left")
        return out.unionByName(of_copies.selectExpr("coalesce(head, same_as) as first", "item_id as later"))

    def met(self, keyed: DataFrame) -> DataFrame:
        """Candidate pairs of accepted items and those of a slice. The slice's keys are broadcast if they are few, so that
        history is scanned and not shuffled; more meet it in a shuffle of the touched buckets."""
        keys = _keys(keyed)
        found = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most BUCKETS rows
        if sum(r.n for r in found) <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        return _candidates(self.keys([r.bucket for r in found]), keys, ordered=False)

    def add_slice(self, keyed: DataFrame) -> list[DataFrame]:
        """Accepts what repeats nothing accepted so far, in order of item_id; returns (first, later) of the rest."""
        found: list[DataFrame] = []
        if self.parts:
            repeats = _verified(self.met(keyed), self.accepted(), keyed).groupBy("later").agg(F.min("first").alias("first"))
            found.append(materialize(repeats.select("first", "later"), "repeats"))
            keyed = _without(keyed, found[0].select(F.col("later").alias("item_id")))
        own = _keys(keyed)
        edges = materialize(_verified(_candidates(own, own, ordered=True), keyed, keyed), "edges")
        dead = _rejected(edges)
        if dead is not None:
            kept = edges.join(dead.selectExpr("later as first"), "first", "left_anti").join(dead, "later")
            found.append(kept.groupBy("later").agg(F.min("first").alias("first")).select("first", "later"))
            keyed = _without(keyed, dead.select(F.col("later").alias("item_id")))
        self.append(keyed)
        return found


def _rejected(edges: DataFrame) -> DataFrame | None:
    """Items (later) that are not accepted when the pairs are resolved in order of item_id; None if there is no pair.

    A round rejects the partners of the items that have no undecided smaller one; pairs of rejected items then drop
    out. A few rounds do, as one more is needed only where repeats form chains; every fourth writes its pairs.
    """
    dead: DataFrame | None = None
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        if rounds % 4 == 0:
            edges = materialize(edges, "edges")
        heads = edges.select("first").distinct().join(edges.selectExpr("later as first").distinct(), "first", "left_anti")
        new = materialize(edges.join(heads, "first").select("later").distinct(), "rejected")
        dead = new if dead is None else dead.unionByName(new)
        edges = edges.join(new, "later", "left_anti").join(new.selectExpr("later as first"), "first", "left_anti").select("first", "later")
    return dead


def keyed_items(items: DataFrame, records: DataFrame, order: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The items by a token order, a new one by default, written once. A history orders what it is given by its own."""
    hashed = materialize(hashed_items(items, records), "hashed-items")
    return materialize(hashed.mapInArrow(_ordered(token_order(hashed) if order is None else order), KEYED), "keyed-items")


def repeats(items: DataFrame, records: DataFrame, path: str | None = None) -> DataFrame:
    """first_item_id, later_item_id: every item that repeats an accepted one, with the smallest that it repeats.

    All batches but the last are a backlog, added to the history at path (a new one by default) as one arrival; a backlog
    then takes as many slices as its size needs and not some for every batch. The last batch is then added to the history
    as opened again. Adding batches one by one gives the same rows, as item_ids ascend with batches.
    """
    spark = items.sparkSession
    hashed = materialize(hashed_items(items, records), "hashed-items")
    last = hashed.agg(F.max("batch_no").alias("b")).first().b
    since = hashed.where(F.col("batch_no") == F.lit(last)).agg(F.min("item_id").alias("i")).first().i
    history = History(spark, path)
    found = history.add(hashed if since is None else hashed.where(F.col("item_id") < since))
    if since is not None:
        found = found.unionByName(History(spark, history.path).add(hashed.where(F.col("item_id") >= since)))
    return found.select(F.col("first").alias("first_item_id"), F.col("later").alias("later_item_id"))


def last_batch_repeats(items: DataFrame, records: DataFrame) -> DataFrame:
    """The repeats of the last batch alone: the backlog is in the history, which is opened again for the batch."""
    last = items.agg(F.max("batch_no").alias("b")).first().b
    since = items.where(F.col("batch_no") == F.lit(last)).agg(F.min("item_id").alias("i")).first().i
    return repeats(items, records).where(F.col("later_item_id") >= F.lit(since))


def _slices(batch: DataFrame, lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """Ranges of item_id that hold about FIRST_SLICE items, then SLICE_GROWTH times as many each."""
    shares, size, done = [], FIRST_SLICE, 0
    while done + size < n:
        done += size
        shares.append(done / n)
        size *= SLICE_GROWTH
    if not shares:
        return [(lo, hi)]
    cuts = batch.select(F.percentile_approx("item_id", F.lit(shares), F.lit(1000)).alias("c")).first().c
    edges = [lo - 1, *sorted({c for c in cuts if lo <= c < hi}), hi]
    return [(a + 1, b) for a, b in zip(edges, edges[1:])]
