"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) followed by a join of two written
tables, whose skewed partitions adaptive execution can split, so a hub with very many links is not
gathered in one task.  Links never reach the driver; it sees one row of totals a round.

Before that, links are contracted where they lie: a task keeps, of HELD links at a time, only a star for each
component among them, so keys that tell the same group many times over count once a task, not once a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import discard, materialise, released

#: Links that a task contracts at once, and at least that many in a task: 4 MB.
HELD = 1 << 18


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position for each of n, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def stars(links: np.ndarray) -> np.ndarray:
    """``(n, 2)`` links -> (node, smallest node it reaches), of each node but the smallest ones."""
    node, at = np.unique(links, return_inverse=True)
    at = at.reshape(-1, 2)
    root = roots(len(node), at[:, 0], at[:, 1])
    own = np.flatnonzero(root != np.arange(len(node)))
    return np.stack([node[own], node[root[own]]], axis=1)


def _contracted(batches):
    held, size = [], 0

    def out():
        s = stars(np.concatenate(held))
        return pa.record_batch([pa.array(np.ascontiguousarray(s[:, k])) for k in range(2)], names=["hi", "lo"])

    for b in batches:
        held.append(np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()], axis=1))
        size += b.num_rows
        if size >= HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def contracted(links: DataFrame, n: int) -> DataFrame:
    """n written links -> distinct ``hi, lo`` that join the same nodes."""
    some = links.where("a <> b").select("a", "b").coalesce(max(1, -(-n // HELD)))
    return some.mapInArrow(released(_contracted), "hi long, lo long").distinct()


def _totals(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row.n, row.s


def components(links: DataFrame) -> DataFrame:
    """A written table of links ``(a long, b long)`` in any order, repeats allowed -> ``(node, root)``.

    One row for each node that has a link to another; ``root`` is the smallest node reachable.
    Loops are ignored; an empty table gives an empty table.
    """
    n = links.count()
    edges = materialise(contracted(links, n), "edges", n)
    before = _totals(edges)
    while before[0]:
        n = 2 * before[0]  # a step makes no more edges than it is given, a node for each end at most
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low", n)
        large = materialise(
            edges.join(low, edges.lo == low.u).select("hi", F.col("m").alias("lo")).distinct(),
            "large",
            n,
        )
        floor = materialise(large.groupBy("hi").agg(F.min("lo").alias("m")), "floor", n)
        met = large.join(floor.withColumnRenamed("hi", "u"), F.col("hi") == F.col("u")).select(
            F.explode(
                F.array(
                    F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        )
        after = materialise(met.select("e.hi", "e.lo").where("hi <> lo").distinct(), "edges", n)
        now = _totals(after)
        for gone in (edges, low, large, floor):
            discard(gone)
        edges = after
        if now == before:
            break
        before = now
    return (
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        .unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")))
        .distinct()
    )
