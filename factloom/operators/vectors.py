"""Vectors: storing, exact top-k by cosine, context and source lookup."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

#: Most values (rows x dimensions) of queries that are sent to every task; more are searched in several passes.
QUERY_VALUES = 4_000_000


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(points: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k points nearest to each query, exactly.

    Queries go to the tasks in blocks of a checked size. Each task keeps its k best per query, by one matrix product
    per batch, so k rows per query and task are shuffled and not a row per pair.
    """
    schema = f"query_id long, {id_} long, score double"
    found: DataFrame | None = None
    block: list = []

    def search(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.array([r[1] for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pandas as pd

            best_s, best_i = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for pdf in batches:
                v = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = np.concatenate((best_s, np.round(q @ v.T, 12)), axis=1)
                i = np.concatenate((best_i, np.broadcast_to(pdf[id_].to_numpy(np.int64), (len(ids), len(pdf)))), axis=1)
                keep = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
            n = best_s.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(ids, n), id_: best_i.ravel(), "score": best_s.ravel()})

        return points.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias(id_), vector).mapInPandas(run, schema)

    size = 0
    for row in queries.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long"), vector).toLocalIterator():
        block.append(row)
        size += len(row[1])
        if size >= QUERY_VALUES:
            part = search(block)
            found = part if found is None else found.unionByName(part)
            block, size = [], 0
    if block or found is None:
        part = search(block) if block else points.sparkSession.createDataFrame([], schema)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def context(ranked: DataFrame, points: DataFrame, id_: str = "record_id") -> DataFrame:
    """Statements of each query's hits in order of rank, flattened."""
    hits = ranked.join(points.select(id_, "pln"), id_)
    return hits.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pln"))), lambda x: x["pln"])).alias("context"))


def last_distinct(rows: DataFrame, key: str, order: str, n: int = 50) -> DataFrame:
    """The last n of the distinct keys by first appearance, in order of appearance."""
    first = rows.groupBy(key).agg(F.min(order).alias(order))
    return first.orderBy(F.desc(order), F.desc(key)).limit(n)


def hashing_embedder(dimensions: int = 64):
    """A deterministic embedding of texts: signed feature hashing of words and word pairs, of unit length."""

    import pandas as pd

    def embed(texts):
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(dimensions)
            words = (t or "").lower().split()
            for f in [*words, *(" ".join(p) for p in zip(words, words[1:]))]:
                h = xxhash.xxh3_64_intdigest(f)
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(embed, "array<float>")


def store(records: DataFrame, path: str, dimensions: int = 64) -> None:
    """Appends records with their vectors, partitioned by source."""
    records.withColumn("vector", hashing_embedder(dimensions)(F.col("nl"))).write.mode("append").partitionBy("source").parquet(path)


def checked_dimension(points: DataFrame, vector: str = "embedding") -> int | None:
    """The one dimension of all vectors; None for an empty table, an error where they differ."""
    row = points.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if row.a != row.b:
        raise ValueError(f"vectors of {row.a} and of {row.b} dimensions")
    return row.a


def proof_atoms(proof: Column) -> Column:
    """Innermost atoms of a proof without truth values, of at least five characters, sorted and distinct."""
    found = F.regexp_extract_all(proof, F.lit(r"\([^()]+\)"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda a: ~F.contains(a, F.lit("STV")) & (F.length(a) >= 5))))


def source_lookup(proofs: DataFrame, points: DataFrame, embed, least: float = 0.6, atoms_per_proof: int = 30) -> DataFrame:
    """proofs(proof_id, proof): distinct nl of the point nearest to each of its atoms, where the score is over least.

    points(vec_id, embedding, nl). Atoms are embedded once each.
    """
    each = proofs.select("proof_id", F.explode(F.slice(proof_atoms(F.col("proof")), 1, atoms_per_proof)).alias("atom"))
    wanted = each.select("atom").distinct().withColumn("vec_id", F.xxhash64("atom")).withColumn("embedding", embed(F.translate("atom", "()", "")))
    hits = top_k(points, wanted, 1).where(F.col("score") > least)
    named = hits.join(points.select("vec_id", "nl"), "vec_id").select(F.col("query_id"), "nl")
    return each.withColumn("query_id", F.xxhash64("atom")).join(named, "query_id").select("proof_id", "nl").distinct()
