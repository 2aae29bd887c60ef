"""Merkle manifest of a dataset: a tree of documents per source, a tree of sources above, a proof for each document.

Leaves are range-sorted by (source, id); a row's place in its source is its place in its part plus what earlier parts
hold of that source.  Each part runs a mountain-range stack over its leaves: a node that completes its run of FANOUT
carries into a parent on the next level, so the stack holds less than FANOUT nodes of each level.  Runs end at a
multiple of FANOUT or at the end of their level, whose length is known, so short runs are hashed as they are, without
padding.  Nodes whose run began in another part, or ends in one, stay open; open nodes of TOGETHER neighbouring parts
meet in one task that runs the same stack, and so on until all are closed: a part leaves at most two times FANOUT nodes
of each level open, whatever its size and however many rows one source has.

For proofs each part asks for the few nodes outside it that stand beside its leaves' ancestors; these are always nodes
that were open once.  Nothing is gathered on the driver, and every table between steps is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm._util import discard, materialise, partitions, tune

FANOUT = 3
#: Leaves of a part, about, and neighbouring parts whose open nodes meet in one task.
PART, TOGETHER = 50_000, 64


def H(*inputs: str) -> str:
    """Lowercase hex SHA-256 of the inputs' concatenation."""
    return sha256("".join(inputs).encode()).hexdigest()


def _field(c):
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaves(docs: DataFrame, tampered: bool = True) -> DataFrame:
    """``tree, doc_id, leaf, bad``: the leaf of each row, and that of its tampered form where the contract tampers.

    Trees are named by their source: the empty string for null, else the source behind an ``s``, which keeps bytewise order.
    """
    id_, text = docs["doc_id"].cast("long"), docs["text"].cast("string")

    def leaf(t):
        return F.sha2(F.concat(_field(id_), _field(docs["source"]), _field(docs["lang"]), _field(docs["n_chars"].cast("long")), _field(t)), 256)

    cut = F.replace(text, F.lit("\n"), F.lit(""))
    changed = (F.crc32(id_.cast("string")) % 2 == 0) & F.contains(text, F.lit("\n")) if tampered else F.lit(False)
    tree = F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), id_.alias("doc_id"), leaf(text).alias("leaf"), F.when(changed, leaf(cut)).alias("bad"))


# ---------------------------------------------------------------------- the stack
def widths(n: int, fanout: int = FANOUT) -> list[int]:
    """Nodes on each level of a tree of n leaves, the last being 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """A mountain range over consecutive nodes of one tree, pushed in order of the leaves they cover.

    ``closed`` gathers parents as ``(level, index, hash)``; ``left`` holds nodes whose run began before this range.
    """

    def __init__(self, n: int, fanout: int = FANOUT):
        self.fanout, self.widths = fanout, widths(n, fanout)
        self.peaks: list[list[str]] = [[] for _ in self.widths]
        self.starts = [0] * len(self.widths)
        self.closed: list[tuple[int, int, str]] = []
        self.left: list[tuple[int, int, str]] = []

    def push(self, level: int, index: int, node: str) -> None:
        while level < len(self.widths) - 1:
            run = self.peaks[level]
            if not run and index % self.fanout:  # its run began in an earlier part
                self.left.append((level, index, node))
                return
            if not run:
                self.starts[level] = index
            run.append(node)
            if len(run) < self.fanout and index + 1 < self.widths[level]:
                return
            level, index, node = level + 1, index // self.fanout, H(*run)  # the carry
            self.closed.append((level, index, node))
            run.clear()
        if not level:  # a lone leaf is its tree's root
            self.closed.append((0, 0, node))

    def open(self) -> list[tuple[int, int, str]]:
        """Nodes that wait for others: left edges, and the peaks of runs that end in a later part."""
        waiting = [(level, self.starts[level] + k, h) for level, run in enumerate(self.peaks) for k, h in enumerate(run)]
        return self.left + waiting


def outside(a: int, b: int, n: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """``(level, index)`` of nodes that stand beside ancestors of the leaves [a, b), or are such, and cover other leaves too."""
    out, size = [], 1
    for level, width in enumerate(widths(n, fanout)[:-1]):
        low, high = fanout * (a // size // fanout), min(width, fanout * ((b - 1) // size // fanout) + fanout)
        own_low, own_high = -(-a // size), width if b == n else b // size
        if own_low >= own_high:
            out += [(level, k) for k in range(low, high)]
        else:
            out += [(level, k) for k in (*range(low, own_low), *range(own_high, high))]
        size *= fanout
    return out


# ---------------------------------------------------------------------- trees over parts
_NODE = "part long, tree string, n long, level int, idx long, hash string, open boolean"
_COLS = ["part", "tree", "n", "level", "idx", "hash", "open"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS) if rows else pd.DataFrame({c: pd.Series([], dtype=t) for c, t in zip(_COLS, ("int64", "object", "int64", "int32", "int64", "object", "bool"), strict=True)})


def _told(part: int, tree: str, n: int, stack: Range) -> list[tuple]:
    """Rows of the nodes that a stack made, and once more, as open, of those that wait for others."""
    return [(part, tree, n, *node, False) for node in stack.closed] + [(part, tree, n, *node, True) for node in stack.open()]


def _ranges(own: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one part, from its leaves and the places of its trees."""
    rows = []
    hashes = {t: g for t, g in own.sort_values(["tree", "place"], kind="stable").groupby("tree", sort=False)["leaf"]}
    for s in spans.itertuples():
        stack = Range(s.n)
        for k, h in enumerate(hashes[s.tree], s.start):
            stack.push(0, k, h)
        rows += _told(s.part, s.tree, s.n, stack)
    return _frame(rows)


def _merge(nodes: pd.DataFrame) -> pd.DataFrame:
    """What open nodes of neighbouring parts give together."""
    rows = []
    for (tree, n), g in nodes.groupby(["tree", "n"]):
        stack = Range(int(n))
        for level, k, h in sorted(zip(g.level, g.idx, g.hash, strict=True), key=lambda x: (int(x[1]) * FANOUT ** int(x[0]), -int(x[0]))):
            stack.push(int(level), int(k), h)
        rows += _told(int(g.part.iloc[0]), tree, int(n), stack)
    return _frame(rows)


def placed(rows: DataFrame, total: int, *order: str) -> DataFrame:
    """``rows`` (with ``tree`` and ``leaf``) in range-sorted parts: adds ``part`` and ``place``, the place among the part's rows.

    Rows that agree in everything are spread by a seeded number, so that copies of one row can't fill a part.
    """
    parts = max(partitions(rows.sparkSession), -(-total // PART)) if total > PART else 1
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "leaf")]
    salted = rows.withColumn("salt", F.rand(11))
    ranged = salted.repartitionByRange(parts, *keys, F.col("salt")) if parts > 1 else salted.coalesce(1)
    return ranged.sortWithinPartitions(*keys).select("*", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("place")).drop("salt")


def grow(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trees over a written table of ``part, place, tree, leaf``: (spans, nodes, upper, roots).

    ``spans``: ``part, tree, start, here, n``, where the leaves of a part stand in each tree; ``nodes``: what each part made
    and, as open, what it left to others; ``upper``: nodes that were open once and those made by merges; ``roots``:
    ``tree, n, hash``.
    """
    w = Window.partitionBy("tree")
    before = F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("here"))
    spans = materialise(counts.select("part", "tree", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "here", F.sum("here").over(w).alias("n")), "spans")
    both = rows.select("part", "place", "tree", "leaf").groupBy("part").cogroup(spans.groupBy("part"))
    nodes = materialise(both.applyInPandas(_ranges, _NODE), "nodes")
    upper, made, waiting = nodes.where("open"), nodes.where("NOT open"), nodes.where("open")
    width = (spans.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        width = -(-width // TOGETHER)
        near = waiting.withColumn("part", F.expr(f"part div {TOGETHER}"))
        merged = materialise(near.groupBy("part").applyInPandas(_merge, _NODE), "merged")
        waiting = merged.where("open")
        upper, made = upper.unionByName(merged.where("NOT open")), made.unionByName(merged.where("NOT open"))
    top = F.expr(f"n <= pow({FANOUT}, level) AND (level = 0 OR n > pow({FANOUT}, level - 1))")  # the one node of the last level
    return spans, nodes, upper, materialise(made.where(top).select("tree", "n", "hash"), "roots")


def _siblings(known: dict, level: int, index: int, width: int) -> tuple[str, str]:
    """The hashes left and right of a node in its run."""
    first = FANOUT * (index // FANOUT)
    run = [known[level, k] if k != index else None for k in range(first, min(width, first + FANOUT))]
    return "".join(run[: index - first]), "".join(run[index - first + 1 :])


def _paths(known: dict, start: int, here: int, n: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf from ``start`` on: (left, right) siblings of each level up to its tree's root."""
    levels, above = widths(n), {}

    def path(level: int, index: int) -> list[tuple[str, str]]:
        if level == len(levels) - 1:
            return []
        if (level, index) not in above:
            above[level, index] = [_siblings(known, level, index, levels[level]), *path(level + 1, index // FANOUT)]
        return above[level, index]

    for k in range(start, start + here):
        yield path(0, k)
        above.pop((0, k), None)


def _known(nodes: pd.DataFrame) -> dict:
    return {(int(level), int(k)): h for level, k, h in zip(nodes.level, nodes.idx, nodes.hash, strict=True)}


def _beside(spans: DataFrame, nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """``part`` with the nodes that its leaves' paths need, those made there and those asked from others, and its
    trees' spans as rows of level -1 (``idx``: the start)."""

    def ask(frames):
        for f in frames:
            yield pd.DataFrame([(s.part, s.tree, level, k) for s in f.itertuples() for level, k in outside(s.start, s.start + s.here, s.n)], columns=["asking", "wanted", "at", "number"])

    asked = spans.mapInPandas(ask, "asking long, wanted string, at int, number long")
    got = asked.join(upper, (F.col("wanted") == F.col("tree")) & (F.col("at") == F.col("level")) & (F.col("number") == F.col("idx")))
    cols = ["tree", "level", "idx", "hash", "n"]
    return (
        nodes.where("NOT open").select("part", *cols)
        .unionByName(got.select(F.col("asking").alias("part"), *cols))
        .unionByName(spans.select("part", "tree", F.lit(-1).alias("level"), F.col("start").alias("idx"), F.lit("").alias("hash"), "n"))
    )


def _upward(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree over the sources' roots: (``name, subroot, lefts, rights``: each source's siblings up to the root; the root)."""
    heads = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("hash").alias("leaf"))
    tops = materialise(placed(heads, heads.count(), "name"), "tops")
    spans, nodes, upper, root = grow(tops)

    def climb(leaf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        leaf, s = leaf.sort_values("place"), near[near.level < 0].iloc[0]
        known = _known(near[near.level >= 0]) | {(0, int(s.idx) + k): h for k, h in enumerate(leaf.leaf)}
        paths = _paths(known, int(s.idx), len(leaf), int(s.n))
        out = [(name, h, [x for x, _ in path], [y for _, y in path]) for name, h, path in zip(leaf.name, leaf.leaf, paths, strict=True)]
        return pd.DataFrame(out, columns=["name", "subroot", "lefts", "rights"])

    near = _beside(spans, nodes, upper)
    up = tops.groupBy("part").cogroup(near.groupBy("part")).applyInPandas(climb, "name string, subroot string, lefts array<string>, rights array<string>")
    return materialise(up, "upward"), root


def proofs(docs: DataFrame, tampered: bool = True) -> DataFrame:
    """Leaf, roots and proof of every row, and the root folded from the row as it is now.

    Returns per row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.  Rows of a source ascend by id
    (null first), rows of one id by their leaf, so equal rows are neighbours with proofs of their own; null fields are
    ``-`` in a leaf, a null source is a tree of its own before all others, and an id that is null is never tampered with.
    Texts may be of any length and empty.  Only the five named columns are read, so others can't clash.  An empty table
    gives an empty result.
    """
    tune(docs.sparkSession)
    own = materialise(leaves(docs, tampered), "leaves")
    rows = materialise(placed(own, own.count(), "doc_id"), "placed")
    discard(own)
    spans, nodes, upper, roots = grow(rows)
    upward, root = _upward(roots)
    first = root.first()
    whole = first.hash if first else ""

    def prove(leaf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out, beside = [], dict(list(near.groupby("tree")))
        for tree, g in leaf.sort_values(["tree", "place"]).groupby("tree", sort=False):
            mine = beside[tree]
            s, head = mine[mine.level == -1].iloc[0], mine[mine.level == -2].iloc[0]
            above = list(zip(head.lefts, head.rights, strict=True))
            top = "".join(x + y for x, y in above)
            known = _known(mine[mine.level >= 0]) | {(0, int(s.idx) + k): h for k, h in enumerate(g.leaf)}
            for id_, h, bad, path in zip(g.doc_id, g.leaf, g.bad, _paths(known, int(s.idx), len(g), int(s.n)), strict=True):
                at = bad if isinstance(bad, str) else h
                for x, y in (*path, *above):
                    at = H(x, at, y)
                out.append((id_, h, head.hash, whole, H(*[x + y for x, y in path], top), at, at == whole))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    none = F.lit(None).cast("array<string>")
    heads = spans.join(upward, F.col("tree") == F.col("name")).select(
        "part", "tree", F.lit(-2).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("hash"), "n", "lefts", "rights"
    )
    near = _beside(spans, nodes, upper).withColumns({"lefts": none, "rights": none}).unionByName(heads)
    leaf = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn integers beside nulls into floats
    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaf.groupBy("part").cogroup(near.groupBy("part")).applyInPandas(prove, out).withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(docs: DataFrame) -> DataFrame:
    """The dataset's manifest: ``kind, source, n, hash`` with a row of kind ``source`` for each source and one of kind
    ``root`` (source null, n the number of rows).  An empty table has neither."""
    own = materialise(leaves(docs, tampered=False), "leaves")
    total = own.count()
    roots = grow(materialise(placed(own, total, "doc_id"), "placed"))[3]
    discard(own)
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    whole = _upward(roots)[1].select(F.lit("root").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(total).cast("long").alias("n"), "hash")
    return roots.select(F.lit("source").alias("kind"), source.alias("source"), "n", "hash").unionByName(whole)


#: crc32's polynomial, reversed: a fixed value.  Eight steps for each digit of the id, the first of which takes it in.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


def _sql_field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Each level is made from the one below while more than one node is left; then paths are read off and folded.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS now
  FROM documents
), s AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY coalesce(encode('s' || source), ''::BLOB)) - 1 AS t, row_number() OVER () AS r
  FROM d
), low AS (
  SELECT t, 0 AS level, i, n, leaf AS h FROM s
  UNION ALL
  SELECT t, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY t, level, i // 3, n
), sub AS (
  SELECT t, h AS subroot, max(level) OVER () AS deepest, level FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, t AS i, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 3, n
), steps AS (
  SELECT r, low.level AS step, string_agg(h, '' ORDER BY low.i) FILTER (WHERE low.i < s.i // CAST(pow(3, level) AS BIGINT)) AS l,
         string_agg(h, '' ORDER BY low.i) FILTER (WHERE low.i > s.i // CAST(pow(3, level) AS BIGINT)) AS g
  FROM s JOIN low ON s.t = low.t AND low.n > 1 AND low.i // 3 = s.i // CAST(pow(3, level + 1) AS BIGINT) GROUP BY r, low.level
  UNION ALL
  SELECT r, 100 + high.level, string_agg(h, '' ORDER BY high.i) FILTER (WHERE high.i < s.t // CAST(pow(3, level) AS BIGINT)),
         string_agg(h, '' ORDER BY high.i) FILTER (WHERE high.i > s.t // CAST(pow(3, level) AS BIGINT))
  FROM s JOIN high ON high.n > 1 AND high.i // 3 = s.t // CAST(pow(3, level + 1) AS BIGINT) GROUP BY r, high.level
), path AS (
  SELECT r, coalesce(l, '') AS l, coalesce(g, '') AS g, row_number() OVER (PARTITION BY r ORDER BY step) AS k FROM steps
), fold AS (
  SELECT r, 0 AS k, now AS h FROM s
  UNION ALL
  SELECT path.r, path.k, sha256(l || h || g) FROM fold JOIN path ON path.r = fold.r AND path.k = fold.k + 1
), proof AS (
  SELECT r, string_agg(l || g, '' ORDER BY k) AS p FROM path GROUP BY r
), root AS (
  SELECT h AS root FROM high WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root AS verified
FROM s JOIN sub ON s.t = sub.t CROSS JOIN root LEFT JOIN proof ON s.r = proof.r
  JOIN (SELECT r, max_by(h, k) AS h FROM fold GROUP BY r) folded ON s.r = folded.r
"""
