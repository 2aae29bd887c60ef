"""Exact top-k against brute force."""

import math

import numpy as np
import pytest

from changelens.llm import topk


def slow(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            best = {}
            for i, b in ok:
                if i != q:
                    s = sum(x * y for x, y in zip(a, b))
                    best[i] = max(s, best.get(i, s))
            for r, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k], 1):
                out.add((q, r, i, -s))
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, part string, pivot int")
    res = [tuple(r) for r in topk.search(df, **more).collect()]
    assert len(res) == len(set(res))
    return set(res)


def vectors(n, dim=8, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(0, 1, (6, dim))
    x = c[r.integers(0, 6, n)] + r.normal(0, 0.3, (n, dim))
    return [(i, [float(np.float32(y)) for y in v / np.linalg.norm(v)]) for i, v in enumerate(x)]


def test_clusters(spark):
    rows = vectors(700)
    assert got(spark, rows) == slow(rows)


def test_hot_vector_ties_and_odd_rows(spark, monkeypatch):
    rows = vectors(300, seed=4) + [(1000 + i, [0.5] * 8) for i in range(150)]
    rows += [(2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2002, [float("inf")] * 8), (None, [1.0] * 8), (2003, [])]
    rows += [(7, rows[7][1]), (50, rows[50][1]), (8, rows[9][1])]
    monkeypatch.setattr(topk, "PART", 40)
    monkeypatch.setattr(topk, "SAMPLE", 64)
    assert got(spark, rows) == slow(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (3, [0.0, -1.0])], [(0, [0.0, 0.0]), (50, [0.0, 0.0]), (51, [0.0, 0.0])], [(0, [1e6, 3.0]), (1, [-1e7, 2.0]), (2, [2e6, 5.0])]])
def test_small(spark, rows):
    assert got(spark, rows) == slow(rows)


def test_rounds_cover_every_annulus_once_and_grow():
    for n in (1, 2, 3, 18, 500):
        seen = [c for a, b in topk.rounds(n) for c in range(a, b)]
        assert seen == list(range(n))
    assert [b - a for a, b in topk.rounds(10_000)][:3] == [2, 16, 128]


def test_many_rounds_and_blocks_of_queries(spark, monkeypatch):
    rows = vectors(900, seed=8)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "FIRST", 1)
    monkeypatch.setattr(topk, "GROWTH", 2)
    monkeypatch.setattr(topk, "PART", 50)
    assert got(spark, rows, every=20) == slow(rows, every=20)
