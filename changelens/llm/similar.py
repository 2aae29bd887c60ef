"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, by Golay keys.

Fingerprints of two documents at that similarity differ in some nine bits of 64, too many for the pigeonhole over
segments to bound.  Segments still decode to nearby codewords: each document has two independent fingerprints of
three segments, and a key is one codeword index (12 bits) of a segment joined with one of the HASHES smallest
shingle hashes (64 bits).  Keys of so many bits don't meet by chance, however many documents there are: what
shares one has a shingle in common and a segment alike.  Measured on pairs at exactly 0.8, 98.8 % share a key; at
0.85, 99.6 %.  What shares a key and differs in at most MOST_BITS of the 128 bits is a candidate (99.9 % at 0.8).

Every candidate is verified by the exact Jaccard of whole shingle sets, in two steps.  First each key tells about as
many pairs as it has members: all candidate pairs if they are that few, else for each member the nearest before it
and the one through which a walk from the group's middle reaches it, if they differ in at most CLOSE bits; those
further apart are only told as one family.  Members of keys that left pairs out are open.
Then the open members of one family (what candidates join) are dealt into blocks of bounded size, and each pair of
blocks is compared whole, leaving out pairs that verified links have joined already.  So what a key
leaves out is tried, a group in which all are linked costs what it has members, and no task holds more than two
blocks.  Of a key that is crowded in a batch of rows some members stand for the others, all within CLOSE bits of them;
what is a candidate of one of those others but not of who stands for it is told by other keys of the two or not at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import MARK, materialise, partitions, released, tune, without
from changelens.llm.components import components, roots, stars
from changelens.llm.simhash import MIX, SEED, SEGMENTS, fingerprint, left_out, same_prints, segment_keys

WORDS, SIMILARITY = 5, 0.8
#: Smallest shingle hashes that make keys, each under another mixing of the hashes.
HASHES = 3
#: Bits of both fingerprints in which candidates may differ: at a similarity of 0.8, 99.9 % of pairs have 33 or fewer.
MOST_BITS = 34
#: A key that leaves pairs out tells the first step those in which so many bits differ: three in four of its links lie
#: within, while most pairs beyond are refused.  What is further apart only joins families here; the second step tries it.
CLOSE = 18
#: Groups up to so many members are compared all keys at once; up to so many, each with all before it.
FEW, MANY = 32, 2048
CHUNK, ROWS = 2048, 4096
#: Blocks of keys are dealt to so many targets for each partition.
SPREAD = 4
#: Shingles in a block of the second step, about.
BLOCK = 1 << 17


# ------------------------------------------------------------------------------------ sketches
def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one shingle; none, none."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    flat = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[:-words].tolist()]
    x = xxhash.xxh64_intdigest
    return np.unique(np.array([x(flat[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """(two fingerprints, HASHES smallest hashes) of a shingle set that isn't empty, as signed longs."""
    prints, least = [], []
    for k in range(max(2, HASHES)):
        mixed = _mixed(hashes, k)
        if k < HASHES:
            least.append(int(mixed.min().view(np.int64)))
        if k < 2:
            total = np.zeros(64, np.int64)
            for s in range(0, len(mixed), 1 << 16):
                total += np.unpackbits(mixed[s : s + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            prints.append(int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0]))
    return prints, least


def _sketches(batches):
    for b in batches:
        fp, prints, least, size = [], [], [], []
        for t in b.column("text").to_pylist():
            h = shingles(t)
            fp.append(fingerprint(t))
            p, m = sketch(h) if len(h) else ([0, 0], [0] * HASHES)
            prints.append(p)
            least.append(np.array(m, np.int64).tobytes())
            size.append(len(h))
        f = np.array(prints, np.int64).reshape(-1, 2)
        cols = [b.column("node"), b.column("doc_id"), b.column("mark"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(least, pa.binary()), pa.array(size, pa.int64())]
        yield pa.record_batch(cols, names=["node", "doc_id", "mark", "fp", "f0", "f1", "least", "size"])


def sketches(docs: DataFrame) -> DataFrame:
    """Written, one row for each row of ``docs``: ``node`` (a number of its own), ``doc_id``, ``mark`` (a hash of the
    text), ``fp`` (the SimHash operator's fingerprint), ``f0, f1, least`` and ``size`` of its shingle set."""
    tune(docs.sparkSession)
    own = docs.select(F.monotonically_increasing_id().alias("node"), docs["doc_id"].cast("long").alias("doc_id"), MARK(docs).alias("mark"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return materialise(own.mapInArrow(released(_sketches), "node long, doc_id long, mark long, fp long, f0 long, f1 long, least binary, size long"), "sketches")


# ---------------------------------------------------------------------------- keys and candidates
def keys(prints: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(n, 2)`` fingerprints and ``(n, HASHES)`` smallest hashes -> (row, key, place): a key is a codeword index of
    one segment and one smallest hash; keys of one segment and hash have one place, so that two documents which share
    several of them meet there once."""
    where, what, place = [], [], []
    for k in range(2):
        for s, (at, w) in enumerate(SEGMENTS):
            near = segment_keys(((prints[:, k] >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64), w)
            for c in near.T:
                rows = np.flatnonzero(c >= 0)
                word = (c[rows] | (k * 3 + s) << 12).astype(np.uint64)
                for j in range(least.shape[1]):
                    where.append(rows)
                    what.append(least[rows, j] ^ _mixed(word | np.uint64(j << 16), 64))
                    place.append(least[rows, j] + np.uint64(k * 3 + s << 8 | j))
    return np.concatenate(where), np.concatenate(what), np.concatenate(place)


def _distance(prints: np.ndarray, x, y) -> np.ndarray:
    return np.bitwise_count(prints[x] ^ prints[y]).sum(-1, dtype=np.int64)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(key)])


def _walk(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree links (parent, member) that join what candidates join; each walk starts from the middle of what is left,
    and members reached are looked for no more."""
    left, right = [], []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        bits = np.unpackbits(prints[rest].view(np.uint8).reshape(len(rest), -1), axis=1)
        middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(rest)).view(np.uint64)
        head = int(np.bitwise_count(prints[rest] ^ middle).sum(1, dtype=np.int64).argmin())
        front, rest = [rest[head]], np.delete(rest, head)
        while front and len(rest):
            at = front.pop(0)
            near = _distance(prints, rest, at) <= most
            found, rest = rest[near], rest[~near]
            left.append(np.full(len(found), at))
            right.append(found)
            front += found.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _nearest_before(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each member with the nearest candidate before it; and how many candidate pairs there are."""
    left, right, total = [], [], 0
    for s in range(0, len(prints), 512):
        rows = np.arange(s, min(len(prints), s + 512))
        d = sum(np.bitwise_count(prints[rows, k][:, None] ^ prints[None, : rows[-1], k]).astype(np.int64) for k in range(2))
        fit = (d <= most) & (np.arange(d.shape[1]) < rows[:, None])
        total += int(fit.sum())
        own = np.flatnonzero(fit.any(1))
        left.append(np.where(fit[own], d[own], 999).argmin(1) if len(own) else own)
        right.append(rows[own])
    return np.concatenate(left), np.concatenate(right), total


def chosen(key: np.ndarray, node: np.ndarray, prints: np.ndarray, most: int = MOST_BITS, close: int = CLOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(n, 2)`` distinct pairs to verify, ``(n, 2)`` links that join what candidates join beside them, and the
    members of keys that left pairs out."""
    order = np.lexsort((node, key))
    key, node, prints = key[order], node[order], prints[order]
    first, size = _groups(key)
    none = np.zeros(0, np.int64)
    left, right, loose, open_ = [none], [none], [np.zeros((0, 2), np.int64)], [none]
    live = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
    lows, highs = [none], [none]
    for step in range(1, FEW):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        near = live[(_distance(prints, live, live + step) <= most) & (node[live] != node[live + step])]
        lows.append(near)
        highs.append(near + step)
    low, high = np.concatenate(lows), np.concatenate(highs)
    if len(low):
        group = np.searchsorted(first, low, "right") - 1
        whole = (np.bincount(group, minlength=len(first)) <= np.maximum(size, 6))[group]
        by = np.lexsort((low, _distance(prints, low, high), high))
        best = np.zeros(len(by), bool)
        best[by] = np.r_[True, np.diff(high[by]) != 0]
        take = whole | best & (_distance(prints, low, high) <= close)
        left.append(low[take])
        right.append(high[take])
        if not whole.all():
            some, at = np.unique(np.concatenate([low[~whole], high[~whole]]), return_inverse=True)
            low_at, high_at = np.split(at, 2)
            root = roots(len(some), low_at, high_at)
            loose.append(np.stack([node[some], node[some[root]]], axis=1))
            open_.append(node[some])
    for at, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
        own = prints[at : at + n]
        x, y = _walk(own, most)
        total = None
        if n <= MANY:
            p, q, total = _nearest_before(own, most)
            x, y = np.unique(np.sort(np.concatenate([[x, y], [p, q]], axis=1), axis=0), axis=1)
        if total is None or total > len(x):
            joined = at + np.stack([x, y], axis=1)
            loose.append(node[joined])
            open_.append(node[np.unique(joined)])
            near = _distance(own, x, y) <= close
            x, y = x[near], y[near]
        left.append(at + x)
        right.append(at + y)
    a, b = node[np.concatenate(left)], node[np.concatenate(right)]
    pairs = np.unique(np.sort(np.stack([a, b], axis=1), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    loose = np.concatenate(loose)
    return pairs[pairs[:, 0] != pairs[:, 1]], loose[loose[:, 0] != loose[:, 1]], np.unique(np.concatenate(open_))


def covered(prints: np.ndarray, close: int = CLOSE) -> tuple[np.ndarray, np.ndarray]:
    """(position of each member that stands for others or itself, the one that stands for each): the first of what is
    left stands for all within ``close`` bits of it, and so on, until each has one."""
    lead = np.full(len(prints), -1)
    rest = np.arange(len(prints))
    while len(rest):
        near = _distance(prints, rest, rest[0]) <= close
        lead[rest[near]] = rest[0]
        rest = rest[~near]
    return np.flatnonzero(lead == np.arange(len(prints))), lead


def _spread(targets: int, most: int, close: int):
    """Blocks of keys for their targets.  Of a crowded key's members in a batch those are sent on that stand for all
    (see ``covered``), however many it takes; the others are told, to be verified, as pairs with the one that stands for
    them, and both are open, so the second step tries them against their whole family."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column("node").to_numpy()
            prints = np.stack([b.column(c).to_numpy() for c in ("f0", "f1")], axis=1).view(np.uint64)
            least = np.frombuffer(b"".join(b.column("least").to_pylist()), np.uint64).reshape(len(node), -1)
            at, key, place = keys(prints, least)
            order = np.argsort(key, kind="stable")
            at, key, place = at[order], key[order], place[order]
            first, size = _groups(key)
            keep, held = np.ones(len(key), bool), [np.zeros((0, 2), np.int64)]
            for s, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
                own = at[s : s + n]
                _, lead = covered(prints[own], close)
                others = np.flatnonzero(lead != np.arange(n))
                held.append(np.stack([node[own[lead[others]]], node[own[others]]], axis=1))
                keep[s + others] = False
            at, key = at[keep], key[keep]
            to = (_mixed(place[keep], 65) >> np.uint64(24)).astype(np.int64) % targets
            order = np.argsort(to, kind="stable")
            at, key, to = at[order], key[order], to[order]
            cut, many = _groups(to)
            ends = cut + many
            cols = [pa.array(to[cut], pa.int32()), *[pa.array([h[c:e].tobytes() for c, e in zip(cut, ends)], pa.binary()) for h in (key, node[at], prints[at])]]
            held = np.unique(np.concatenate(held), axis=0)
            lone = [held.tobytes() if k == 0 else b"" for k in range(len(cut))]
            yield pa.record_batch([*cols, pa.array(lone, pa.binary())], names=["target", "key", "node", "prints", "held"])

    return run


def told(pairs: np.ndarray, loose: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a task has chosen -> pairs to verify that join nothing else, pairs to verify that join the family of two
    open members, and the fewest links of open members that join what such pairs leave apart (or a member and itself)."""
    both = np.isin(pairs, open_).all(1) if len(pairs) else np.zeros(0, bool)
    near = pairs[both]
    loose = np.concatenate([loose, near])
    node = np.unique(np.concatenate([loose.ravel(), open_]))
    lead = roots(len(node), *np.searchsorted(node, near).T)
    rest = stars(node[lead[np.searchsorted(node, loose)]])
    alone = np.setdiff1d(open_, np.concatenate([near.ravel(), rest.ravel()]))
    return pairs[~both], near, np.concatenate([rest, np.stack([alone, alone], axis=1)])


def _meet(most: int, close: int):
    def run(batches):
        key, node, prints, held = [], [], [], [np.zeros((0, 2), np.int64)]
        for b in batches:
            for into, name in ((key, "key"), (node, "node"), (prints, "prints")):
                into += b.column(name).to_pylist()
            held += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in b.column("held").to_pylist() if x]
        if not key:
            return
        pairs, loose, open_ = chosen(np.frombuffer(b"".join(key), np.uint64), np.frombuffer(b"".join(node), np.int64), np.frombuffer(b"".join(prints), np.uint64).reshape(-1, 2), most, close)
        held = np.sort(np.concatenate(held), axis=1)  # close, so verified, and open
        pairs = np.unique(np.concatenate([pairs, held]), axis=0)
        rows = told(pairs, np.concatenate([loose, held]), np.union1d(open_, held))
        for (verify, joins), some in zip(((1, 0), (1, 1), (0, 1)), rows):
            some = np.sort(some, axis=1)
            flags = [pa.array(np.full(len(some), x, np.int32)) for x in (verify, joins)]
            yield pa.record_batch([*[pa.array(np.ascontiguousarray(some[:, k])) for k in range(2)], *flags], names=["a", "b", "verify", "joins"])

    return run


def met(sketched: DataFrame, most: int = MOST_BITS, close: int = CLOSE) -> DataFrame:
    """Written ``a, b, verify, joins``: distinct pairs; whether to verify one (0 or 1), and whether it joins a family,
    whose members are open (0 or 1; ``a`` and ``b`` may be one)."""
    spark = sketched.sparkSession
    p = partitions(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    dealt = sketched.where("size > 0").select("node", "f0", "f1", "least").repartition(p, "node")
    blocks = dealt.mapInArrow(released(_spread(SPREAD * p, most, close)), "target int, key binary, node binary, prints binary, held binary")
    out = materialise(blocks.repartition(p, "target").mapInArrow(released(_meet(most, close)), "a long, b long, verify int, joins int").groupBy("a", "b").agg(F.max("verify").alias("verify"), F.max("joins").alias("joins")), "candidates")
    tune(spark)
    return out


# ------------------------------------------------------------------------------------ verification
def _sets(batches):
    for b in batches:
        held = [shingles(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("node"), pa.array(held, pa.binary())], names=["node", "held"])


def _verify(least: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pairs_verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The written pairs whose Jaccard is ``least`` or more."""
    x, y = sets.select(F.col("node").alias("i"), F.col("held").alias("x")), sets.select(F.col("node").alias("j"), F.col("held").alias("y"))
    half = materialise(pairs.join(x, pairs.a == x.i).select("a", "b", "x"), "half")
    return materialise(half.join(y, half.b == y.j).select("a", "b", "x", "y").mapInArrow(released(_verify(least)), "a long, b long"), "similar")  # its tasks read sets, so they aren't cut by rows


def block_links(side: np.ndarray, node: np.ndarray, label: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], least: float, most: int) -> list[tuple[int, int]]:
    """Verified links between two blocks (side 0 and 1; or within one, side 2), enough to join whatever all verified
    candidate pairs join: pairs whose labels are joined by then are left out."""
    label = np.unique(label, return_inverse=True)[1]
    x_at, y_at = (np.flatnonzero(side == 2),) * 2 if (side == 2).any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    size = np.array([len(s) for s in sets])
    out = []
    for k, i in enumerate(x_at):
        others = y_at[k + 1 :] if y_at is x_at else y_at
        others = others[(label[others] != label[i]) & (np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i]) - 1e-9)]
        others = others[_distance(prints, others, i) <= most]
        if not len(others):
            continue
        flat = np.concatenate([sets[j] for j in others])
        place = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
        both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.r_[0, np.cumsum(size[others])[:-1]])
        for j in others[both >= least * (size[others] + size[i] - both) - 1e-9]:
            if label[j] != label[i]:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                label[label == label[j]] = label[i]
    return out


def _family_links(open_: DataFrame, sets: DataFrame, least: float, most: int) -> DataFrame:
    """``node, family, label, size, f0, f1`` -> verified links between members of one family that differ in label.

    A label that fills blocks of its own isn't compared with itself; small labels share blocks.
    """
    per = materialise(open_.groupBy("family", "label").agg(F.sum("size").alias("w")), "labels")
    many = per.groupBy("family").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("w") < BLOCK, F.col("w")).otherwise(0)).alias("rest"))
    named = per.join(many, "family").where("labels > 1")
    own = F.col("w") >= BLOCK
    named = materialise(named.select("family", "label", F.when(own, F.col("label")).otherwise(-1).alias("lab"), F.when(own, F.ceil(F.col("w") / BLOCK)).otherwise(F.ceil(F.greatest(F.col("rest"), F.lit(1)) / BLOCK)).alias("subs")), "named")
    spread = F.when(F.col("lab") >= 0, F.xxhash64("node")).otherwise(F.xxhash64("label"))
    dealt = materialise(open_.join(named, ["family", "label"]).withColumn("sub", F.pmod(spread, F.col("subs"))), "dealt")
    block = dealt.select("family", "lab", "sub").distinct()
    one, two = F.struct("lab", "sub"), F.struct("lab2", "sub2")
    pairs = block.join(block.select("family", F.col("lab").alias("lab2"), F.col("sub").alias("sub2")), "family")
    pairs = materialise(pairs.where((one <= two) & ((F.col("lab") != F.col("lab2")) | (F.col("lab") < 0))), "blocks")
    numbered = pairs.withColumn("meeting", F.struct("family", "lab", "sub", "lab2", "sub2"))
    ends = numbered.select("family", "meeting", F.explode(F.when(one == two, F.array(F.struct(F.lit(2).alias("side"), "lab", "sub"))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), "lab", "sub"), F.struct(F.lit(1).alias("side"), F.col("lab2").alias("lab"), F.col("sub2").alias("sub"))))).alias("e")).select("family", "meeting", "e.*")
    rows = dealt.join(ends, ["family", "lab", "sub"]).join(sets.withColumnRenamed("node", "i"), F.col("node") == F.col("i"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [np.frombuffer(h, np.uint64) for h in pdf.held]
        prints = pdf[["f0", "f1"]].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame(block_links(pdf.side.to_numpy(), pdf.node.to_numpy(), pdf.label.to_numpy(), prints, got, least, most), columns=["a", "b"]).astype("int64")

    return materialise(rows.select("meeting", "side", "node", "label", "f0", "f1", "held").groupBy("meeting").applyInPandas(meet, "a long, b long"), "within")


def similar_links(docs: DataFrame, sketched: DataFrame, least: float = SIMILARITY, known: DataFrame | None = None, most: int = MOST_BITS, close: int = CLOSE) -> DataFrame:
    """Written links ``(a, b)`` of nodes, smaller first, whose Jaccard is ``least`` or more.

    ``sketched``: ``sketches(docs)``.  Components of the links, with those of ``known`` (written links that hold
    anyway), are those of all candidate pairs that are so similar.  Texts without words have no links.
    """
    tune(docs.sparkSession)
    n = sketched.count()
    rows = met(sketched, most, close)
    pairs = rows.where("verify = 1").select("a", "b")
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct(), "ends", n)
    which = sketched.join(ends, sketched.node == ends.end, "left_semi").select(F.col("node").alias("at"), F.col("doc_id").alias("i"), F.col("mark").alias("m"))
    # by id and hash of the text: rows that agree in both have one set
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), MARK(docs).alias("mark"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    wanted = materialise(which.groupBy("i", "m").agg(F.min("at").alias("node")), "wanted", n)
    found = text.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
    found = materialise(found.select("node", "text").mapInArrow(released(_sets), "node long, held binary").dropDuplicates(["node"]), "found")
    lead = which.join(wanted.withColumnRenamed("i", "i2").withColumnRenamed("m", "m2"), F.col("i").eqNullSafe(F.col("i2")) & (F.col("m") == F.col("m2"))).select("at", F.col("node").alias("first"))
    sets = materialise(lead.join(found, lead["first"] == found.node).select(F.col("at").alias("node"), "held"), "sets")
    links = _pairs_verified(pairs, sets, least)
    marked = rows.where("joins = 1").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node")).distinct()
    if marked.isEmpty():
        return links
    joined = links if known is None else links.unionByName(known)
    label = components(materialise(joined.select("a", "b"), "joined", joined.count())).select(F.col("node").alias("x"), F.col("root").alias("label"))
    loose = materialise(rows.where("a <> b").select("a", "b"), "loose")
    family = components(loose).select(F.col("node").alias("y"), F.col("root").alias("family"))
    open_ = sketched.join(marked, "node", "left_semi").select("node", "size", "f0", "f1")
    open_ = open_.join(family, F.col("node") == F.col("y")).join(label, F.col("node") == F.col("x"), "left").select("node", "family", F.coalesce("label", "node").alias("label"), "size", "f0", "f1")
    more = _family_links(materialise(open_, "open"), sets, least, most)
    return materialise(links.unionByName(more).distinct(), "links", links.count() + more.count())


# ------------------------------------------------------------------------------------ the operator
def drop_similar(docs: DataFrame, least: float = SIMILARITY, most: int = MOST_BITS, close: int = CLOSE) -> DataFrame:
    """One row of each group stays, with its own columns: the one with the smallest id, ties by a hash of the text.

    Documents are linked by fingerprints within four bits, as the SimHash operator links them, or by a verified
    Jaccard of at least ``least`` over five-word shingles.  Rows are told apart by id and text, so an id that comes
    with several texts is several documents; rows that agree in both are one (the first by their JSON form stays).
    A null id never wins over a real one; of a group of null ids one row stays.  Null and empty texts are one group.
    Very long texts are sketched whole.  Extra columns may have any names; an empty table gives an empty table.
    """
    sketched = sketches(docs)
    linked = same_prints(sketched)
    both = materialise(similar_links(docs, sketched, least, linked, most, close).unionByName(linked), "both")
    return without(docs, *left_out(both, sketched))
