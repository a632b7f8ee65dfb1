"""Problem 7: evaluation texts leaking into the corpus, by suffix arrays of corpus shards.

Each task turns its documents, in blocks of bounded size, into one sequence of word numbers and sorts the suffixes of
that sequence (a word-level suffix array, by prefix doubling). Every suffix of every evaluation text is then
binary-searched in it, all at once; suffixes that meet one with at least MIN_WORDS words in common give their longest
verbatim match and its place. Only words of the evaluation texts have numbers: a suffix that holds another word
among its first MIN_WORDS cannot match and is left out of the array before sorting, which changes no result.

The evaluation side is the query: it goes to the tasks in parts of at most PART_WORDS words, one pass of the corpus
per part (a fixed suite of some hundred cases is one part). Documents are read once per part, are never shuffled and
never cut.

Matches are extended from their first word only, in blocks of bounded size, so a passage that many cases and documents
repeat costs time for each pair of them but no memory.

Words are runs of letters and digits; case and the composition of accents are ignored.

Defined cases: rows without doc_id or case_id are left out; NULL and empty texts hold nothing; evaluation texts of fewer
than MIN_WORDS words hold no passage; on request (whole_short) they leak where a document holds them whole; NULL entries
are skipped; a passage found at several places of a document is reported at the first of the longest ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Most evaluation words sent to the tasks at once.
PART_WORDS = 2_000_000
#: Corpus words in a block, at most, beyond the last document's.
BLOCK_WORDS = 1_000_000
#: Pairs of an evaluation suffix and a place that are extended at once.
PAIRS = 1_000_000

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        return WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()))
    return WORD.findall(text.lower())


class Suite:
    """Evaluation texts as word numbers: numbers from 1, 0 for every other word."""

    def __init__(self, entries: list[tuple[int, int, str]], whole_short: bool = False) -> None:
        self.number: dict[str, int] = {}
        self.keys: list[tuple[int, int]] = []
        #: Entries of fewer than MIN_WORDS words by their word numbers.
        self.short: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        parts, starts, at = [], [0], 0
        for case_id, entry_no, text in entries:
            found = words(text)
            if len(found) < MIN_WORDS:
                if whole_short and found:
                    numbers = tuple(self.number.setdefault(w, len(self.number) + 1) for w in found)
                    self.short.setdefault(numbers, []).append((case_id, entry_no))
                continue
            parts.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in found), np.int32, len(found)))
            self.keys.append((case_id, entry_no))
            at += len(found)
            starts.append(at)
        self.words = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.starts = np.array(starts)
        owner = np.repeat(np.arange(len(self.keys)), np.diff(self.starts))
        left = self.starts[1:][owner] - np.arange(at)
        self.suffixes = np.flatnonzero(left >= MIN_WORDS)
        self.owner = owner[self.suffixes]
        self.length = left[self.suffixes]
        self.short_lengths = sorted({len(k) for k in self.short})
        self.short_starts = np.array(sorted({k[0] for k in self.short}), np.int32)

    def __bool__(self) -> bool:
        return len(self.suffixes) > 0 or bool(self.short)

    def whole(self, doc_id: int, seq: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """Rows of the short entries that a document holds whole, at their first place."""
        found: dict[tuple[int, ...], int] = {}
        for i in np.flatnonzero(np.isin(seq, self.short_starts)).tolist():
            run = tuple(seq[i : i + MIN_WORDS].tolist())
            for n in self.short_lengths:
                if run[:n] in self.short and len(run) >= n:
                    found.setdefault(run[:n], i)
        return [(*key, doc_id, len(run), i, 0) for run, i in found.items() for key in self.short[run]]


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of seq ordered by at least their first depth items; numbers are positive, 0 ends a run."""
    rank = seq.astype(np.int64)
    k = 1
    while True:
        after = np.zeros_like(rank)
        if k < len(rank):
            after[:-k] = rank[k:]
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        k *= 2
        if k >= depth:
            return order
        sorted_key = key[order]
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate(([1], sorted_key[1:] != sorted_key[:-1])))
        rank = new


def _bounds(seq: np.ndarray, order: np.ndarray, query: np.ndarray, at: np.ndarray, depth: int, upper: bool) -> np.ndarray:
    """For each query suffix the first place in order whose suffix is not below it (upper: is above it) by depth items."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        pos = order[np.minimum(mid, len(order) - 1)]
        below = np.zeros(len(at), bool)
        equal = open_.copy()
        for d in range(depth):
            here = np.flatnonzero(equal)
            if not len(here):
                break
            p = pos[here] + d
            c = np.where(p < len(seq), seq[np.minimum(p, len(seq) - 1)], 0)
            q = query[at[here] + d]
            below[here[c < q]] = True
            equal[here[c != q]] = False
        if upper:
            below |= equal
        low = np.where(open_ & below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    return low


def _matches(seq: np.ndarray, suite: Suite) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Evaluation suffixes (indexes), corpus positions and match lengths of all matches of MIN_WORDS words or more that
    no longer match contains, in blocks of at most PAIRS candidate pairs."""
    order = suffix_array(seq, MIN_WORDS)
    order = order[_holds_run(seq)[order]]
    if not len(order) or not len(suite.suffixes):
        return
    low = _bounds(seq, order, suite.words, suite.suffixes, MIN_WORDS, upper=False)
    high = _bounds(seq, order, suite.words, suite.suffixes, MIN_WORDS, upper=True)
    n = high - low
    total = np.cumsum(n)
    at_start = suite.suffixes == suite.starts[suite.owner]
    for begin in range(0, int(total[-1]), PAIRS):
        pair = np.arange(begin, min(begin + PAIRS, int(total[-1])))
        which = np.searchsorted(total, pair, side="right")
        place = order[pair - total[which] + n[which] + low[which]]
        before = (place > 0) & ~at_start[which]
        same = suite.words[np.maximum(suite.suffixes[which] - 1, 0)] == seq[np.maximum(place - 1, 0)]
        first = ~(before & same)
        which, place = which[first], place[first]
        length = np.full(len(which), MIN_WORDS)
        active = np.arange(len(which))
        while len(active):
            d, w = length[active], which[active]
            p = place[active] + d
            inside = (d < suite.length[w]) & (p < len(seq))
            active, d, w, p = active[inside], d[inside], w[inside], p[inside]
            active = active[suite.words[suite.suffixes[w] + d] == seq[p]]
            length[active] += 1
        yield which, place, length


def _holds_run(seq: np.ndarray) -> np.ndarray:
    """Whether MIN_WORDS numbered words start at each position."""
    ends = np.flatnonzero(np.concatenate((seq == 0, [True])))
    return ends[np.searchsorted(ends, np.arange(len(seq)))] - np.arange(len(seq)) >= MIN_WORDS


def _block(docs: list[tuple[int, np.ndarray]], suite: Suite) -> list[tuple[int, int, int, int, int, int]]:
    """(case_id, entry_no, doc_id, longest match, its first word in the document, in the entry) per entry and document."""
    runs, ids, offsets = [], [], []
    for doc_id, seq in docs:
        ends = np.flatnonzero(np.concatenate((seq == 0, [True])))
        begins = np.concatenate(([0], ends[:-1] + 1))
        for b, e in zip(begins[ends - begins >= MIN_WORDS], ends[ends - begins >= MIN_WORDS]):
            runs += [seq[b:e], np.zeros(1, np.int32)]
            ids.append(np.full(e - b + 1, doc_id, np.int64))
            offsets.append(np.arange(b, e + 1))
    if not runs:
        return []
    ids_at, offset_at = np.concatenate(ids), np.concatenate(offsets)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for which, place, length in _matches(np.concatenate(runs), suite):
        doc, offset, entry = ids_at[place], offset_at[place], suite.owner[which]
        order = np.lexsort((offset, -length, doc, entry))
        keep = np.concatenate(([True], (entry[order][1:] != entry[order][:-1]) | (doc[order][1:] != doc[order][:-1])))[: len(order)]
        first = order[keep]
        inside = suite.suffixes[which[first]] - suite.starts[entry[first]]
        for e, d, n, o, i in zip(entry[first].tolist(), doc[first].tolist(), length[first].tolist(), offset[first].tolist(), inside.tolist()):
            if (e, d) not in best or (-n, o) < (-best[e, d][0], best[e, d][1]):
                best[e, d] = (n, o, i)
    return [(*suite.keys[e], d, *found) for (e, d), found in best.items()]


FOUND = "case_id long, entry_no int, doc_id long, words int, doc_word int, entry_word int"


def _search(suite: Suite):
    schema = pa.schema([("case_id", pa.int64()), ("entry_no", pa.int32()), ("doc_id", pa.int64()), ("words", pa.int32()), ("doc_word", pa.int32()), ("entry_word", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, np.ndarray]] = []
        size = 0
        get = suite.number.get

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                seq = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
                if suite.short and (rows := suite.whole(doc_id, seq)):
                    yield flush(rows)
                if np.count_nonzero(seq) >= MIN_WORDS:
                    docs.append((doc_id, seq))
                    size += len(seq)
                if size >= BLOCK_WORDS:
                    yield flush(_block(docs, suite))
                    docs, size = [], 0
        if docs:
            yield flush(_block(docs, suite))

    return run


def entries(cases: DataFrame) -> DataFrame:
    """case_id, entry_no and text of every text of a case; the question is entry -1."""
    texts = cases.select("case_id", F.posexplode("texts").alias("entry_no", "text"))
    return texts.unionByName(cases.select("case_id", F.lit(-1).alias("entry_no"), F.col("question").alias("text"))).where(
        F.col("case_id").isNotNull() & F.col("text").isNotNull()
    )


def longest_matches(documents: DataFrame, cases: DataFrame, whole_short: bool = False) -> DataFrame:
    """The longest verbatim match of each evaluation text in each document that holds MIN_WORDS words of it in a row; with
    whole_short also evaluation texts of fewer words that a document holds whole."""
    spark = documents.sparkSession
    least = 1 if whole_short else 2 * MIN_WORDS - 1
    docs = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    out: DataFrame | None = None
    part: list[tuple[int, int, str]] = []
    size = 0

    def add() -> None:
        nonlocal out, part, size
        suite = Suite(part, whole_short)
        if suite:
            found = docs.mapInArrow(_search(suite), FOUND)
            out = found if out is None else out.unionByName(found)
        part, size = [], 0

    for row in entries(cases).orderBy("case_id", "entry_no").toLocalIterator():
        part.append((row.case_id, row.entry_no, row.text))
        size += len(row.text) // 2
        if size >= PART_WORDS:
            add()
    add()
    return out if out is not None else spark.createDataFrame([], FOUND)


def leaked(documents: DataFrame, cases: DataFrame, whole_short: bool = False) -> DataFrame:
    """case_id, doc_id: each document and each case of which it holds a passage."""
    return longest_matches(documents, cases, whole_short).groupBy("case_id", "doc_id").agg(F.max("words").alias("words"))


def remove_leaked(documents: DataFrame, cases: DataFrame, whole_short: bool = False) -> DataFrame:
    """The documents that hold no passage of any case, nor, with whole_short, a whole short text of one."""
    return documents.join(longest_matches(documents, cases, whole_short).select("doc_id").distinct(), "doc_id", "left_anti")
