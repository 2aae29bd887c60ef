"""Centroid clustering in exact integers, with Elkan's bounds.

Every vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound for each other
one.  After a round bounds move with the centroids.  A vector whose upper bound is below half the distance from its
centroid to the next keeps it unseen; otherwise a centroid is met only if neither its lower bound nor half of its
distance from the vector's own centroid lies beyond the upper bound.  Bounds are rounded outwards, upper ones to float32
and lower ones to float16, and a centroid is passed over only if it is strictly farther, so ties are always met and go
to the smaller number; what is met is measured in exact integers.

The state of a round is a written table (about as large as the input), which replaces that of the round before; a task
writes, beside its vectors, one row for each cluster with the sums of its vectors, so a round is a single pass and moves
no more than k rows a task.  The driver holds k centroids.
"""

from __future__ import annotations

from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import discard, materialise, tune

#: Components of a vector, centroids, and rounds that move them.
DIMS, K, ROUNDS = 64, 40, 5
#: Distances of components up to this are exact in doubles (64 times the square of twice this is 2^52); others are
#: computed with Python's integers.
EXACT = 1 << 22
#: Vectors in one Arrow batch.
ROWS = 4096
_MOST = (1 << 63) - 1
_STATE = "vec_id long, v binary, cluster int, upper float, lower binary, distance long, of int, n long, sums array<decimal(38,0)>, spread decimal(38,0)"
_NAMES = [c.split()[0] for c in _STATE.replace("(38,0)", "").split(", ")]


def kept(vectors: DataFrame, dims: int = DIMS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors that take part, their components floor(256 x) as longs.

    Left out are vectors that are null, not of ``dims`` components, or hold a component that is null, not finite, or too
    large for a long.  Null ids stay.
    """
    x = vectors[vec_col].cast("array<double>")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(2.0**55))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dims) & F.forall("x", fine))
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * 256)).alias("v"))


# ---------------------------------------------------------------------- arithmetic
def _down(x: np.ndarray, kind: type) -> np.ndarray:
    """Rounded to a narrower float that is no larger."""
    with np.errstate(over="ignore"):
        y = np.minimum(x, np.finfo(kind).max).astype(kind)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, kind(-np.inf)), y)


def _up(x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x.astype(kind)
    return np.where(y.astype(np.float64) < x, np.nextafter(y, kind(np.inf)), y)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from one centroid: doubles if both are, else Python integers."""
    d = x - c
    return (d * d).sum(1)


def _root(squares: np.ndarray, outwards: int) -> np.ndarray:
    """Square roots as doubles, moved outwards by more than any rounding."""
    r = np.sqrt(squares.astype(np.float64))
    return np.maximum(r * (1 + outwards * 1e-12) + outwards * 1e-300, 0)


class Centroids:
    """Centroids as integers, what they moved by, and their distances; all of size k times k or k times d."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        k = len(now)
        self.exact = bool(k) and max(abs(int(c)) for c in now.ravel()) <= EXACT
        self.doubles = now.astype(np.float64)
        between = np.array([[float(_squares(now[i : i + 1], now[j])[0]) for j in range(k)] for i in range(k)]).reshape(k, k)
        half = _root(between, -1) / 2 * (1 - 1e-12)
        np.fill_diagonal(half, np.inf)
        self.half, self.near = half, half.min(1) if k else np.zeros(0)
        self.moved = np.zeros(k) if before is None else _root(np.array([float(_squares(now[i : i + 1], before[i])[0]) for i in range(k)]), 1) * (1 + 1e-12)


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One round for a batch: new ``(cluster, upper, lower)`` and how many distances were computed.

    ``x``: integers, as doubles or as objects; ``upper`` and ``lower`` (n x k) bound distances from the centroids of the
    round before.  Bounds come back rounded outwards but in doubles.
    """
    rows = np.arange(len(x))
    upper = (upper + c.moved[cluster]) * (1 + 1e-15)
    lower = np.maximum(lower - c.moved, 0) * (1 - 1e-15)
    cluster = cluster.copy()
    live = rows[upper >= c.near[cluster]]
    at = cluster[live]
    reach = (lower[live] <= upper[live, None]) & (c.half[at] <= upper[live, None])
    reach[np.arange(len(live)), at] = False
    some = reach.any(1)
    live, at = live[some], at[some]
    if not len(live):
        return cluster, upper, lower, 0
    centres = c.doubles if x.dtype != object else c.now
    own = x[live]
    best = _squares(own, centres[at])
    met = len(live)
    tight = _root(best, 1)
    lower[live, at] = _root(best, -1)
    for j in range(len(c.now)):
        ask = np.flatnonzero((at != j) & (lower[live, j] <= tight) & (c.half[at, j] <= tight))
        if not len(ask):
            continue
        met += len(ask)
        d = _squares(own[ask], centres[j])
        lower[live[ask], j] = _root(d, -1)
        better = (d < best[ask]) | ((d == best[ask]) & (j < at[ask]))
        turn = ask[better]
        at[turn], best[turn] = j, d[better]
        tight[turn] = _root(d[better], 1)
    cluster[live], upper[live] = at, tight
    return cluster, upper, lower, met


# ---------------------------------------------------------------------- rounds
def _packed(x: np.ndarray) -> list[bytes]:
    """A vector's longs as bytes, two for each component where that is enough."""
    narrow = (np.abs(x) < 1 << 15).all(1)
    return [r.astype(np.int16 if s else np.int64).tobytes() for r, s in zip(x, narrow, strict=True)]


def _unpacked(column: list[bytes], dims: int) -> np.ndarray:
    return np.array([np.frombuffer(b, np.int16 if len(b) == 2 * dims else np.int64) for b in column], np.int64).reshape(-1, dims)


def _round(table: DataFrame, c: Centroids, fresh: bool, last: bool) -> DataFrame:
    """The state after vectors have met the centroids ``c``: rows of vectors, and a task's rows of sums (``of`` set)."""
    k, dims = c.now.shape

    def run(batches):
        counts, sums, spread = [0] * k, [np.zeros(dims, object) for _ in range(k)], [0] * k
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if fresh:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
                packed = _packed(v)
            else:
                packed = b.column("v").to_pylist()
                v = _unpacked(packed, dims)
                cluster, upper = b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy().astype(np.float64)
                lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float16).reshape(n, k).astype(np.float64)
            small = (np.abs(v) <= EXACT).all(1) if c.exact else np.zeros(n, bool)
            distance = np.zeros(n, object)
            for rows in (np.flatnonzero(small), np.flatnonzero(~small)):
                if len(rows):
                    x = v[rows].astype(np.float64 if small[rows[0]] else object)
                    cluster[rows], upper[rows], lower[rows], _ = assign(x, c, cluster[rows], upper[rows], lower[rows])
                    if last:
                        distance[rows] = [int(d) for d in _squares(x, (c.doubles if small[rows[0]] else c.now)[cluster[rows]])]
            for j in np.unique(cluster):
                own = cluster == j
                counts[j] += int(own.sum())
                if last:
                    spread[j] += sum(distance[own])
                else:
                    sums[j] = sums[j] + (v[own].sum(0).astype(object) if small[own].all() else v[own].astype(object).sum(0))
            none = pa.nulls(n, pa.int64())
            yield _batch(
                b.column("vec_id"), pa.array(packed if not last else [None] * n, pa.binary()), pa.array(cluster.astype(np.int32)), pa.array(_up(upper)),
                pa.array([r.tobytes() for r in _down(lower, np.float16)] if not last else [None] * n, pa.binary()),
                pa.array([min(d, _MOST) for d in distance], pa.int64()) if last else none, none.cast(pa.int32()), none, pa.nulls(n, pa.list_(pa.decimal128(38, 0))), pa.nulls(n, pa.decimal128(38, 0)),
            )
        some = [j for j in range(k) if counts[j]]
        if some:
            m = len(some)
            yield _batch(
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.float32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                pa.array(some, pa.int32()), pa.array([counts[j] for j in some], pa.int64()),
                pa.array([[Decimal(int(s)) for s in sums[j]] for j in some], pa.list_(pa.decimal128(38, 0))), pa.array([Decimal(int(spread[j])) for j in some], pa.decimal128(38, 0)),
            )

    return table.mapInArrow(run, _STATE)


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch(list(columns), names=_NAMES)


def _moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; empty clusters keep their centroid."""
    dims = now.shape[1]
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    out = now.copy()
    for r in state.where("of IS NOT NULL").groupBy("of").agg(F.sum("n").alias("n"), *totals).collect():  # k rows at most
        out[r.of] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Assigns every vector that takes part (see ``kept``) to one of k centroids after so many rounds.

    Returns ``vec_id, cluster, distance`` (squared), ``cluster_inertia, inertia, centroid_sha256``.  Rows with a null id
    take part and come last among the seeds; repeated rows count each; equal seeds are centroids of their own, of which
    the first gets all; fewer vectors than k give fewer centroids; without vectors the result is empty.  Sums and
    distances that no long holds come back as the largest long.  Other columns aren't read.
    """
    spark = vectors.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    own = kept(vectors, dims, id_col, vec_col)
    by = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = own.orderBy(by.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    before, now, state = None, np.array([list(map(int, r.v)) for r in first], object), None
    for r in range(rounds + 1):
        table = own if state is None else state.where("of IS NULL")
        got = materialise(_round(table, Centroids(now, before), state is None, r == rounds), "state")
        if state is not None:
            discard(state)
        state = got
        if r < rounds:
            before, now = now, _moved(state, now)
    sizes = {r.of: int(r.s) for r in state.where("of IS NOT NULL").groupBy("of").agg(F.sum("spread").alias("s")).collect()}
    total = min(sum(sizes.values()), _MOST)
    told = [(j, min(sizes.get(j, 0), _MOST), total, sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(now)]
    heads = spark.createDataFrame(told, "number int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    rows = state.where("of IS NULL").join(F.broadcast(heads), F.col("cluster") == F.col("number"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The same rounds with every distance computed."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM v ORDER BY j LIMIT {k}
)"""
    ]
    square = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT r, vec_id, v, j, d FROM (SELECT r, vec_id, v, j, CAST({square} AS BIGINT) AS d FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.j, coalesce(m.c, c{r}.c) AS c
  FROM c{r} LEFT JOIN (
    SELECT j, list(q ORDER BY i) AS c
    FROM (SELECT j, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM (SELECT j, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY j, i)
    GROUP BY j
  ) m ON m.j = c{r}.j
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(a{rounds}.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.j = c{rounds}.j
"""


ORACLE_SQL = _oracle()
