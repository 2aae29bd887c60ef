"""Clusters against a loop that computes every distance; the bounds; vectors that take no part."""

from hashlib import sha256

import numpy as np
import pytest

from changelens.llm import elkan
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance long, number int"


def plain(rows, k, rounds):
    """Every distance in Python's integers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    key = lambda r: (r[0] is None, "" if r[0] is None else sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    square = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for r in range(rounds + 1):
        own = [min((square(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, o) in zip(kept, own) if o == j]
                if mine:
                    centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted([(i, j, d) for (i, _), (d, j) in zip(kept, own)], key=repr), centres


def check(spark, rows, k=5, rounds=5, dims=3):
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)
    got = elkan.clusters(df, k, rounds, dims).collect()
    want, centres = plain([r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])], k, rounds)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=repr) == want
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
    return got


def test_ties_copies_and_strange_rows(spark):
    """Vectors on a small grid tie all the time; nulls, other lengths and non-finite components take no part."""
    r = np.random.default_rng(3)
    rows = [(k, [float(x) / 256 for x in r.integers(-2, 3, 3)]) for k in range(300)]
    rows += [(5, [0.5, 0.25, -0.125])] * 40 + [(None, [0.0, 0.0, 0.001])] * 3
    rows += [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0]), (404, [1.0, float("nan"), 2.0]), (405, [float("inf"), 0.0, 0.0])]
    assert len(check(spark, rows)) == 343
    check(spark, rows, k=40)


def test_copies_of_a_seed(spark):
    """Equal seeds: the first gets all, the others stay empty."""
    got = check(spark, [(9, [1.0, 1.0, 1.0])] * 50 + [(1, [2.0, 2.0, 2.0])], k=4)
    assert len({r.cluster for r in got}) == 2


def test_large_components(spark):
    """Beyond what doubles hold exactly."""
    r = np.random.default_rng(4)
    check(spark, [(k, [float(x) for x in r.integers(-(1 << 20), 1 << 20, 3) + r.integers(0, 256, 3) / 256]) for k in range(80)])


def test_few_and_none(spark):
    check(spark, [(1, [0.1, 0.2, 0.3])])
    assert elkan.clusters(spark.createDataFrame([], SCHEMA), dims=3).count() == 0
    assert elkan.clusters(spark.createDataFrame([(1, None, 0, 0, 0)], SCHEMA), dims=3).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_spare_work(seed):
    """After each round bounds lie around the true distances, ties go to the smaller number, and work shrinks."""
    r = np.random.default_rng(seed)
    middle = r.integers(-60, 60, (8, 6))
    x = (middle[r.integers(0, 8, 500)] + r.integers(-9, 10, (500, 6))).astype(np.float64)
    now = x[:8].astype(np.int64).astype(object)
    before, cluster, upper, lower = None, np.zeros(500, np.int64), np.full(500, np.inf), np.zeros((500, 8))
    work = []
    for _ in range(6):
        c = elkan.Centroids(now, before)
        cluster, upper, lower, met = elkan.assign(x, c, cluster, upper, lower)
        upper, lower = elkan._up(upper).astype(np.float64), elkan._down(lower, np.float16).astype(np.float64)
        true = ((x[:, None] - now.astype(np.float64)) ** 2).sum(2)
        assert (cluster == true.argmin(1)).all()
        assert (upper**2 >= true.min(1) * (1 - 1e-9)).all() and (lower**2 <= true * (1 + 1e-9)).all()
        work.append(met)
        before, now = now, np.array([[int(s) // int((cluster == j).sum()) for s in x[cluster == j].sum(0)] if (cluster == j).any() else list(now[j]) for j in range(8)], object)
    assert work[-1] < work[0] / 2 and work[0] <= 500 * 9


def test_rounding_outwards():
    x = np.r_[np.random.default_rng(1).uniform(0, 1e5, 2000), 0, 1e300, 65504.0]
    assert (elkan._down(x, np.float16).astype(np.float64) <= x).all() and (elkan._up(x).astype(np.float64) >= x).all()


def test_tables(spark):
    assert compare(elkan.clusters(spark.read.parquet(f"{SF}/embeddings.parquet")), connect(SF), elkan.ORACLE_SQL) is None
