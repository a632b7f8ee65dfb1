"""Problem 6: filling containers of fixed capacity with items of varying length, by bounded-space online packing.

Each task keeps at most OPEN open containers per capacity. An item goes into the fullest container that still has
room for it; when none has, the fullest container is emitted and a new one opened. What is open at a task's end is
packed again with the leftovers of up to MERGE other tasks by the same rule, level by level, until one group is left,
so that no task ever holds more than MERGE x OPEN containers and its share of the waste stays a constant. An item is
cut only if it exceeds the capacity: into full pieces and a rest, which is packed like an item.

Items are sized in tokens of a public tokenizer, whose vocabulary file is a parameter.

Defined cases: rows without an identifier or a size are left out; NULL and empty texts have no tokens and take no room: they give no row;
capacities that are NULL or not positive take nothing; of repeated capacities each is filled on its own; equal room
is decided in favour of the container opened first.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN = 32
MERGE = 64


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and its number of tokens."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sizes(tokenizer), "doc_id long, tokens long")


class Packer:
    """Open containers of one capacity. A container is [room, items]; an item is (size, payload)."""

    def __init__(self, capacity: int, open_: int = OPEN) -> None:
        self.capacity, self.most, self.bins = capacity, open_, []

    def put(self, size: int, items: list) -> list | None:
        """Places items of a total size of at most the capacity; returns the items of a container that closed."""
        best = None
        for b in self.bins:
            if b[0] >= size and (best is None or b[0] < best[0]):
                best = b
        if best is not None:
            best[0] -= size
            best[1] += items
            if best[0] == 0:
                self.bins.remove(best)
                return best[1]
            return None
        out = None
        if len(self.bins) >= self.most:
            fullest = min(self.bins, key=lambda b: b[0])
            self.bins.remove(fullest)
            out = fullest[1]
        if size == self.capacity:
            if out is not None:
                self.bins.append([fullest[0], out])  # nothing had to close for a container that is full at once
            return list(items)
        self.bins.append([self.capacity - size, list(items)])
        return out


ROWS = pa.schema([("budget_id", pa.int32()), ("capacity", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64()), ("bin", pa.int64()), ("part", pa.int32()), ("closed", pa.bool_())])
DDL = "budget_id int, capacity long, doc_id long, piece int, tokens long, bin long, part int, closed boolean"


class _Out:
    """Rows of emitted containers, in record batches. Containers are numbered within a task."""

    def __init__(self, task: int) -> None:
        self.rows: list[tuple] = []
        self.next, self.task = task << 33, task

    def add(self, budget: int, capacity: int, items: list, closed: bool) -> None:
        for doc_id, piece, tokens in items:
            self.rows.append((budget, capacity, doc_id, piece, tokens, self.next, self.task, closed))
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[] for _ in ROWS]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, ROWS)], schema=ROWS)


def _first(budgets: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(TaskContext.get().partitionId())
        packers = {b: Packer(c) for b, c in budgets}
        for batch in batches:
            for doc_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b, c in budgets:
                    piece, left = 0, n
                    while left > c:
                        out.add(b, c, [(doc_id, piece, c)], True)
                        piece, left = piece + 1, left - c
                    if left and (full := packers[b].put(left, [(doc_id, piece, left)])) is not None:
                        out.add(b, c, full, True)
            yield out.batch()
        for b, c in budgets:
            for bin_ in packers[b].bins:
                out.add(b, c, bin_[1], False)
        yield out.batch()

    return run


def _again(key: tuple, table: pa.Table) -> pa.Table:
    """Packs the open containers of a group of tasks and numbers them anew; the last level closes all."""
    last = bool(table.column("last")[0].as_py())
    bins: dict[int, list] = {}
    for row in sorted(zip(*(table.column(c).to_pylist() for c in ("bin", "doc_id", "piece", "tokens")))):
        bins.setdefault(row[0], []).append(row[1:])
    budget, capacity, group = (k.as_py() for k in key)
    packer, out = Packer(capacity), _Out(0)
    out.next, out.task = min(bins), group
    ids = iter(sorted(bins))
    for _, items in sorted(bins.items(), key=lambda x: (-sum(i[2] for i in x[1]), x[0])):
        if (full := packer.put(sum(i[2] for i in items), items)) is not None:
            out.next = next(ids)
            out.add(budget, capacity, full, True)
    for bin_ in packer.bins:
        out.next = next(ids)
        out.add(budget, capacity, bin_[1], last)
    return pa.Table.from_batches([out.batch()])


def pack(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, capacity, doc_id, piece, tokens and the container (bin) of every piece of every item.

    sizes: doc_id, tokens. budgets: budget_id, capacity_tokens, a fixed table of a few rows. Only the items in
    containers still open at a task's end are shuffled.
    """
    caps = [(r.budget_id, r.capacity_tokens) for r in budgets.select("budget_id", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()]
    numbered = [(i, c) for i, (_, c) in enumerate(caps)]
    known = sizes.select(F.col("doc_id").cast("long"), F.col("tokens").cast("long")).where("doc_id is not null and tokens is not null")
    level = materialize(known.mapInArrow(_first(numbered), DDL), "packed")
    done = [level.where("closed")]
    left = level.where("not closed")
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // MERGE)
        merged = left.withColumn("part", F.floor(F.col("part") / MERGE).cast("int")).withColumn("last", F.lit(groups <= 1))
        left = materialize(merged.groupBy("budget_id", "capacity", "part").applyInArrow(_again, DDL), "packed")
        done.append(left.where("closed"))
        left = left.where("not closed")
        if groups <= 1:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    names = F.array(*[F.lit(b) for b, _ in caps]) if caps else F.array().cast("array<int>")
    return out.select(F.get(names, F.col("budget_id")).alias("budget_id"), "capacity", "doc_id", "piece", "tokens", "bin")
