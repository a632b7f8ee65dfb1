"""Sentence-first and paragraph-first chunks and translator batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import PARAGRAPH_CUES, PARAGRAPH_PREFIXES, merge_sentences, split_sentences

if TYPE_CHECKING:
    import pandas as pd

CHUNK_SIZE, CHUNK_OVERLAP, BATCH_SENTENCES, BATCH_CHARS = 512, 64, 4, 2000


def windows(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Windows of at most size characters that end at the last . ! ? or line break of their final fifth, with overlap."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while True:
        end = start + size
        if end >= len(text):
            out.append(text[start:].strip())
            break
        floor = start + int(size * 0.8)
        cut = max(text.rfind(c, floor, end) for c in ".!?\n")
        cut = cut + 1 if cut >= 0 else end
        out.append(text[start:cut].strip())
        start = max(cut - overlap, start + 1)
    return [x for x in out if x]


def _split_long(key: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "units": [[w for p in parts for w in windows(p)] for parts in pdf["units"]]})

    return run


def sentence_units(text: Column) -> Column:
    """Sentences, each with the ones that depend on it."""
    return merge_sentences(split_sentences(text))


def document_chunks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_no, chunk. Only texts with an oversized unit pass through Python."""
    units = documents.select(key, sentence_units(F.col(text)).alias("units"))
    long = F.exists("units", lambda u: F.length(u) > CHUNK_SIZE)
    schema = f"`{key}` {dict(documents.dtypes)[key]}, units array<string>"
    parts = units.where(~long).unionByName(units.where(long).mapInPandas(_split_long(key), schema))
    return parts.select(key, F.posexplode("units").alias("chunk_no", "chunk"))


def batches(units: Column, max_sentences: Column | int = BATCH_SENTENCES, max_chars: Column | int = BATCH_CHARS) -> Column:
    """Greedy batches of consecutive units: array of arrays."""
    most = max_sentences if isinstance(max_sentences, Column) else F.lit(max_sentences)
    chars = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, u: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & ((F.size(acc["open"]) >= most) | (acc["n"] + 1 + F.length(u) > chars))
        grown = F.when(acc["n"] == 0, F.length(u)).otherwise(acc["n"] + 1 + F.length(u))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(u)).otherwise(F.concat(acc["open"], F.array(u))).alias("open"),
            F.when(full, F.length(u)).otherwise(grown).alias("n"),
        )

    return F.aggregate(units, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def _goes_on(sentence: str) -> bool:
    words = sentence.lower().split()
    return bool(words) and (words[0] in PARAGRAPH_CUES or " ".join(words[:2]) in PARAGRAPH_PREFIXES or " ".join(words[:3]) in PARAGRAPH_PREFIXES)


def _packed(parts: list[str], size: int, joint: str) -> list[str]:
    """Consecutive parts joined while the open group, with a joint behind each part, and the next one fit into size."""
    out: list[list[str]] = []
    used = 0
    for p in parts:
        if out and used + len(p) <= size:
            out[-1].append(p)
            used += len(p) + len(joint)
        else:
            out.append([p])
            used = len(p) + len(joint)
    return [joint.join(g) for g in out]


def _packed_sentences(parts: list[str], size: int) -> list[str]:
    """As _packed, but the sentence that opens a later group counts without its joint."""
    out: list[list[str]] = []
    used = 0
    for p in parts:
        fits = not out or used + len(p) <= size
        if not out or not fits:
            out.append([p])
            used = len(p) + (1 if len(out) == 1 else 0)
        else:
            out[-1].append(p)
            used += len(p) + 1
    return [" ".join(g) for g in out]


def paragraph_chunks(text: str, size: int = CHUNK_SIZE) -> list[str]:
    """Paragraphs packed up to size; a longer paragraph falls back to its sentences, each with those that go on with it,
    packed likewise."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    short: list[str] = []
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if len(para) <= size:
            short += [para] if para else []
            continue
        out += _packed(short, size, "\n\n")
        short = []
        groups: list[str] = []
        for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", para)):
            if s and groups and _goes_on(s):
                groups[-1] += " " + s
            elif s:
                groups.append(s)
        out += _packed_sentences(groups, size)
    return out + _packed(short, size, "\n\n")


def document_paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in it:
            parts = [paragraph_chunks(t, size) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "chunks": parts})

    kind = dict(documents.dtypes)[key]
    rows = documents.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, chunks array<string>")
    return rows.select(key, F.posexplode("chunks").alias("chunk_no", "chunk"))
