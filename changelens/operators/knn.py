"""Nearest neighbours of a set of queries against all vectors, in blocks on both sides.

Vectors and queries are dealt into blocks of bounded size by a hash of their id, each block of queries meets each
block of vectors, each meeting returns its best, and the bests are merged.  Nothing is collected; a meeting holds
one block of either side and is one matrix product for each chunk of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors, and queries, in a block about; queries scored at once.
BLOCK, ASKED = 8192, 4096
CHUNK = 512


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """``l2sq``: one minus the squared distance; ``cosine``: the cosine."""
    if metric == "cosine":
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
        return q @ x.T
    return 1.0 - ((q * q).sum(1)[:, None] - 2.0 * (q @ x.T) + (x * x).sum(1))


def _meet(queries: DataFrame, vectors: DataFrame, fn, schema: str) -> DataFrame:
    n, m = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // ASKED))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("part", every(m))
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).withColumn("block", every(n))
    return asked.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInPandas(fn, schema)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """``(queries, k)`` places of the best scores of each row, ties to the smaller id; ids must ascend."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
    # above the k-th best, then of those that equal it the first
    above, equal = score > least, score == least
    take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
    at = np.nonzero(take)[1].reshape(len(score), k)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(score, at, 1), axis=1, kind="stable"), 1)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", digits: int = 4) -> DataFrame:
    """``query_id, id, score, rank``: the k best of ``(id, v)`` for each query, by the rounded score,
    ties to the smaller id.  A query meets its own row too, if it is among the vectors."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        qs, got, points = [], [], []
        if len(a) and len(b):
            order = np.argsort(b.id.to_numpy(), kind="stable")
            ids, x = b.id.to_numpy()[order], np.stack(b.v.to_numpy()).astype(np.float64)[order]
            q = np.stack(a.q.to_numpy()).astype(np.float64)
            for s in range(0, len(a), CHUNK):
                m = np.round(scores(q[s : s + CHUNK], x, metric), digits) + 0.0
                at = _first(m, ids, k)
                qs.append(np.repeat(a.query_id.to_numpy()[s : s + CHUNK], at.shape[1]))
                got.append(ids[at].ravel())
                points.append(np.take_along_axis(m, at, 1).ravel())
        none = [np.zeros(0)]
        return pd.DataFrame({"query_id": np.concatenate(qs or none).astype(np.int64), "id": np.concatenate(got or none).astype(np.int64), "score": np.concatenate(points or none)})

    got = _meet(queries, vectors.select("id", "v"), best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_by_group(queries: DataFrame, vectors: DataFrame, group: str, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """``query_id, <group>, score, rank``: groups (files of chunks) ranked by their best member."""

    def fold(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            names, at = np.unique(b[group].to_numpy(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(len(names)))
            x = np.stack(b.v.to_numpy()).astype(np.float64)[order]
            q = np.stack(a.q.to_numpy()).astype(np.float64)
            for s in range(0, len(a), CHUNK):
                top = np.maximum.reduceat(scores(q[s : s + CHUNK], x, metric), first, axis=1)
                asked = a.query_id.to_numpy()[s : s + CHUNK]
                out.append(pd.DataFrame({"query_id": np.repeat(asked, len(names)), group: np.tile(names, len(asked)), "score": top.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], group: [], "score": []})

    kind = vectors.schema[group].dataType.simpleString()
    got = _meet(queries, vectors.select("id", "v", group), fold, f"query_id long, {group} {kind}, score double")
    best = got.groupBy("query_id", group).agg((F.round(F.max("score"), digits) + F.lit(0.0)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), group)
    return best.withColumn("rank", F.row_number().over(w))
