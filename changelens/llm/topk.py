"""Exact top-k inner products through a pivot-distance index.

Vectors become integers.  One more coordinate turns the largest inner product into the smallest
distance: with M the largest norm, a vector x gets sqrt(M^2 - |x|^2) and a query 0, so that
|q - x|^2 = |q|^2 + M^2 - 2 q.x.  The index keys every vector by its nearest pivot and its distance
to that pivot; rings of equal width around a pivot are its annuli.

A query's first bound comes from a bounded sample of candidates.  Then its annuli are expanded nearest first, GROWTH
times as many in each round: an annulus is left out for good as soon as the triangle inequality shows that all in it
are farther than the k-th best so far, each round tightens that bound, and a query whose nearest annulus left is
beyond it is done.  Within an annulus scores are exact integers.  The number of pivots follows the root of that of
vectors.  Large annuli are split by a hash of the id, so a hot vector fills no task, and so are the queries that
meet them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm._util import materialise, tune
from changelens.llm.sampling import first_by_hash

#: Pivots: half the root of the number of vectors, this many at most; rings of a pivot at most.
MOST_PIVOTS, RINGS = 4096, 8
#: Vectors in the sample that fixes pivots and first bounds, at least, and for each pivot.
SAMPLE, EACH = 4096, 8
#: Vectors in one part of an annulus, and queries that meet it at once.
PART, QUERIES = 4096, 1 << 16
#: Annuli that a query expands first, and how many times as many it does in each later round.
FIRST, GROWTH = 2, 8
CHUNK = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v array<long>`` of floor(256 x); vectors null, empty, or with a null or non-finite
    component, and rows without an id, take no part."""
    x = vectors[vec_col].cast("array<double>")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", fine)
    ).select("vec_id", F.transform("x", lambda e: F.floor(e * 256)).alias("v"))


def _matrix(column) -> np.ndarray:
    """Vectors held as the bytes of doubles."""
    held = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(held), np.float64).reshape(len(held), -1) if held else np.zeros((0, 1))


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, np.float64)], pa.binary())


def _pivots(sample: np.ndarray, most: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's centres of the sample, from spread-out seeds."""
    r = np.random.default_rng(1)
    distinct = np.unique(sample, axis=0)
    k = min(most, len(distinct))
    centres = distinct[r.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        d = (sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)
        own = d.argmin(1)
        for j in range(k):
            if (own == j).any():
                centres[j] = sample[own == j].mean(0)
    return centres


class Space:
    """Pivots, ring width and the sample; all of bounded size."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, largest: float, most: int):
        self.m2 = largest
        self.slack = 1e-3 + 1e-6 * np.sqrt(largest)  # beyond any rounding of a distance
        self.ids, self.sample = ids, sample
        self.pivots = _pivots(self.lift(sample), most)
        d = self.distances(self.lift(sample))
        self.width = max(1.0, float(d.min(1).max()) / (RINGS - 1))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0))]

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d = (lifted**2).sum(1)[:, None] - 2 * lifted @ self.pivots.T + (self.pivots**2).sum(1)
        return np.sqrt(np.maximum(d, 0))

    def annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivot, ring, distance); what lies beyond the outermost ring belongs to it."""
        d = self.distances(self.lift(x))
        p = d.argmin(1)
        own = d[np.arange(len(x)), p]
        return p, np.minimum((own / self.width).astype(np.int64), RINGS - 1), own


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row that aren't minus infinity, ties to the first column."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
    above, equal = score > least, score == least
    take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(take & (score > -np.inf))


def rounds(cells: int) -> list[tuple[int, int]]:
    """From which to which of its annuli, nearest first, a query expands in each round."""
    out, at, many = [], 0, FIRST
    while at < cells:
        out.append((at, min(cells, at + many)))
        at, many = at + many, many * GROWTH
    return out


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows whose id divides by ``every`` against every row but their own.

    Returns ``query_id, rank (from 1), vec_id, score`` of the k highest integer inner products, ties
    to the smaller vec_id; fewer where there are fewer candidates.  Vectors must agree in length:
    those of another length than most take no part.  Repeated ids: equal rows count once, and rows
    that differ under one id count as one candidate with its best score and as one query each whose
    results are merged.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    tune(spark)
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    all_v = materialise(quantised(vectors, id_col, vec_col).withColumn("norm", norm), "quantised")
    sizes = all_v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm").alias("m"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score long"
    if not sizes:
        return spark.createDataFrame([], out)
    size = sizes[0]
    v = all_v.where(F.size("v") == size.d).select("vec_id", "v")
    pivots = max(1, min(MOST_PIVOTS, round(size.n**0.5 / 2)))
    picked = first_by_hash(v, max(SAMPLE, EACH * pivots), "vec_id", total=size.n).collect()
    picked = list({r.vec_id: r for r in picked}.values())  # an id counts once towards the first bounds
    space = Space(np.array([r.vec_id for r in picked]), np.array([r.v for r in picked], np.float64), float(size.m), pivots)
    held = spark.sparkContext.broadcast(space)
    exact = space.m2 < 2.0**50  # doubles hold such integers exactly

    def keyed(batches):
        s = held.value
        for b in batches:
            col = b.column("v")
            x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))
            p, ring, _ = s.annulus(x) if len(x) else (np.zeros(0), np.zeros(0), None)
            whole = b.column("v") if not exact else pa.array([None] * len(col), pa.list_(pa.int64()))
            yield pa.record_batch([b.column("vec_id"), pa.array(np.asarray(p * RINGS + ring, np.int32)), _packed(x), whole], names=["vec_id", "cell", "v", "whole"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    index = materialise(v.mapInArrow(keyed, "vec_id long, cell int, v binary, whole array<long>"), "index")
    counts = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}  # RINGS for a pivot at most
    cells = np.array(sorted(counts))
    parts = np.array([-(-counts[c] // PART) for c in cells])
    first = np.cumsum(parts) - parts
    layout = spark.sparkContext.broadcast((cells, parts, first))
    asked = max(1, -(-size.q // QUERIES))

    def dealt(batches):
        at, n, a0 = layout.value
        for b in batches:
            where = np.searchsorted(at, b.column("cell").to_numpy())
            h = b.column("h").to_numpy()
            yield pa.record_batch([pa.array((a0[where] + h % n[where]).astype(np.int32)), b.column("vec_id"), b.column("v"), b.column("whole")], names=["part", "vec_id", "v", "whole"])

    placed = index.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))).mapInArrow(dealt, "part int, vec_id long, v binary, whole array<long>")
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)))) if asked > 1 else placed.withColumn("turn", F.lit(0))
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("whole").alias("q_whole"))

    def expand(lower: int, upper: int):
        """Each query with every part of the annuli of a round that its bound lets in."""

        def run(batches):
            s = held.value
            at, n, a0 = layout.value
            p, ring = at // RINGS, at % RINGS
            lo, hi = ring * s.width, np.where(ring == RINGS - 1, np.inf, (ring + 1) * s.width)
            for b in batches:
                ids, x = b.column("query_id").to_numpy(), _matrix(b.column("q"))
                known = b.column("kth").to_numpy(zero_copy_only=False)
                rows_q, rows_part = [], []
                for c in range(0, len(ids), CHUNK):
                    own, qi, kth = x[c : c + CHUNK], ids[c : c + CHUNK], known[c : c + CHUNK]
                    norms = (own * own).sum(1)
                    dist = np.sqrt(np.maximum(norms[:, None] - 2 * np.c_[own, np.zeros(len(own))] @ s.pivots.T + (s.pivots**2).sum(1), 0))
                    if not lower and len(s.ids) > k:
                        scores = own @ s.sample.T
                        scores[qi[:, None] == s.ids] = -np.inf
                        kth = np.maximum(kth, np.partition(scores, -k, axis=1)[:, -k])
                    d = dist[:, p]
                    gap = np.maximum(np.maximum(lo - d, d - hi), 0)  # no nearer than this by the triangle inequality
                    limit = np.sqrt(np.maximum(norms + s.m2 - 2 * kth, 0)) + s.slack  # the k-th best is so far
                    order = np.argsort(np.argsort(gap + 1e-9 * d, axis=1, kind="stable"), axis=1)
                    r, cell = np.nonzero((gap <= limit[:, None]) & (order >= lower) & (order < upper))
                    reps = n[cell]
                    rows_q.append(np.repeat(c + r, reps))
                    rows_part.append(np.repeat(a0[cell], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
                pick = pa.array(np.concatenate(rows_q) if rows_q else np.zeros(0, np.int64))
                part = np.concatenate(rows_part) if rows_part else np.zeros(0)
                yield pa.record_batch([b.column(c).take(pick) for c in ("query_id", "q", "q_whole")] + [pa.array(part.astype(np.int32))], names=["query_id", "q", "q_whole", "part"])

        return run

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Exact scores within one part: at most PART vectors or so, queries in chunks."""
        got = [np.zeros((0, 3), np.int64)]
        if len(a) and len(b):
            by = np.argsort(b.vec_id.to_numpy(), kind="stable")
            ids = b.vec_id.to_numpy()[by]
            read = lambda d, x, w: _matrix(d[x]) if exact else np.array([[int(e) for e in r] for r in d[w]], object)
            x, q, qs = read(b, "v", "whole")[by], read(a, "q", "q_whole"), a.query_id.to_numpy()
            firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for c in range(0, len(qs), CHUNK):
                score = q[c : c + CHUNK] @ x.T
                if len(firsts) < len(ids):  # the best row of each id
                    score = np.maximum.reduceat(score, firsts, axis=1)
                score = score.astype(np.float64) if exact else score
                own = ids[firsts]
                same = qs[c : c + CHUNK][:, None] == own
                if exact:
                    score[same] = -np.inf
                    i, j = best(score, k)
                else:
                    pairs = [(i, j) for i, row in enumerate(score) for j in sorted(np.flatnonzero(~same[i]), key=lambda t, row=row: (-row[t], t))[:k]]
                    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
                got.append(np.stack([qs[c : c + CHUNK][i], own[j], score[i, j].astype(np.int64)], axis=1))
        return pd.DataFrame(np.concatenate(got), columns=["query_id", "vec_id", "score"])

    found, low = None, F.lit(-(2.0**60))
    left = queries.withColumn("kth", low)
    for lower, upper in rounds(len(cells)):
        if found is not None:
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").cast("double").alias("known"))
            left = queries.join(kth, F.col("query_id") == F.col("qid"), "left").select("query_id", "q", "q_whole", F.coalesce("known", low).alias("kth"))
        routed = left.mapInArrow(expand(lower, upper), "query_id long, q binary, q_whole array<long>, part int").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(asked)).cast("int"))
        got = routed.groupBy("part", "turn").cogroup(placed.groupBy("part", "turn")).applyInPandas(meet, "query_id long, vec_id long, score long")
        got = got if found is None else got.unionByName(found.drop("rank"))
        one = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = materialise(one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found", size.q * k)
    return found


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
