"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has three segments of 23, 23 and 18 bits (the last is padded with zeros).  The binary
Golay code is perfect: every 23-bit word lies within three bits of exactly one codeword.  The keys of
a segment are the 12-bit indices of the codewords to which it, or it with one bit turned, decodes:
one key where the word lies within two bits of its codeword, else six at most.  Two words that
differ in two bits have a word between them, one bit from either, so they share a key.

Pigeonhole: of four differing bits over three segments, either two segments differ in (0, 2 or fewer)
bits, or in (1, 1) and then the third in two at most.  Fingerprints that link therefore share a key of
an exact segment and a codeword of another (35 or 30 bits), or of one codeword each of all three (36
bits).  Keys of so many bits stay selective for as many fingerprints as there are documents.

Keys and distinct fingerprints travel in binary blocks; every shared key is verified by the full
Hamming distance.  A group is walked breadth first over the members not yet reached, so it costs
what it has members and components, and only a spanning star of each component leaves a task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import MARK, materialise, partitions, released, texts, tune, without
from changelens.llm.components import components, roots

SEED = 42
WORDS = 4
MOST_BITS = 4
#: Fixed value: generator polynomial of the [23, 12, 7] Golay code.
GOLAY = 0b110001110101
#: Fixed value: an odd multiplier that spreads keys over targets.
MIX = np.uint64(0x9E3779B97F4A7C15)
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))


# ---------------------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half the XXH64 of all word shingles; 0 for a text without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[: -words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    x = xxhash.xxh64_intdigest
    n = len(starts)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([x(flat[a:b], SEED) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _prints(batches):
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the 64 bits as a signed long."""
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(released(_prints), "doc_id long, fp long")


# ---------------------------------------------------------------------------- Golay decoding
def _syndrome(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


@lru_cache(None)
def _leaders() -> np.ndarray:
    """For each of the 2048 syndromes the error of at most three bits that causes it."""
    one = [1 << i for i in range(23)]
    errors = [0, *one]
    errors += [a ^ b for i, a in enumerate(one) for b in one[:i]]
    errors += [a ^ b ^ c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    e = np.array(errors, np.int64)
    out = np.full(2048, -1, np.int64)
    out[_syndrome(e)] = e
    assert len(e) == 2048 and (out >= 0).all()
    return out


@lru_cache(None)
def _turned(width: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what to add to a word for each codeword near it, -1 where fewer; and how many."""
    lead = _leaders()
    rows = []
    for e in lead:  # the word is codeword + e; turning a bit gives e ^ bit, which decodes on
        near = {int(e)}
        for i in range(width):
            f = int(e) ^ (1 << i)
            near.add((1 << i) ^ int(lead[_syndrome(np.array([f]))[0]]))
        rows.append(sorted(near))
    most = max(map(len, rows))
    table = np.array([r + [-1] * (most - len(r)) for r in rows], np.int64)
    return table, np.array([len(r) for r in rows])


def segment_keys(words: np.ndarray, width: int) -> np.ndarray:
    """``(n, most)`` codeword indices near each word, -1 where there are fewer."""
    table, _ = _turned(width)
    add = table[_syndrome(words)]
    return np.where(add < 0, -1, (words[:, None] ^ add) >> 11)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fp``, key): what kind of key it is, then an exact segment and a codeword index,
    or three codeword indices."""
    fp = fp.view(np.uint64)
    own = [((fp >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    near = [segment_keys(o, w) for o, (_, w) in zip(own, SEGMENTS)]
    where, what = [], []

    def put(at: np.ndarray, key: np.ndarray) -> None:
        where.append(at)
        what.append(key)

    for k, (i, j) in enumerate(PAIRS):
        for b in near[j].T:
            at = np.flatnonzero(b >= 0)
            put(at, k << 36 | own[i][at] << 12 | b[at])
    for a in near[0].T:
        for b in near[1].T:
            both = np.flatnonzero((a >= 0) & (b >= 0))
            for c in near[2][both].T:
                some = np.flatnonzero(c >= 0)
                at = both[some]
                put(at, len(PAIRS) << 36 | a[at] << 24 | b[at] << 12 | c[some])
    return np.concatenate(where), np.concatenate(what)


# ---------------------------------------------------------------------------- links in a task
#: Keys with up to so many members are compared pair by pair, all keys at once.
SMALL = 32


def key_links(key: np.ndarray, fp: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(a, b)`` that join whatever the verified distances within each key join."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order].view(np.uint64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    left, right = [], []
    live = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for step in range(1, SMALL):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        near = live[np.bitwise_count(fp[live] ^ fp[live + step]) <= most]
        left.append(fp[near])
        right.append(fp[near + step])
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rest = fp[at : at + n]
        while len(rest):  # one component of the key
            front, head, rest = rest[:1], rest[0], rest[1:]
            while len(front) and len(rest):
                near = np.bitwise_count(rest ^ front[0]) <= most
                front = np.concatenate([front[1:], rest[near]])
                left.append(np.full(int(near.sum()), head))
                right.append(rest[near])
                rest = rest[~near]
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _spread(targets: int):
    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            at, key = keys(fp)
            to = (key.view(np.uint64) * MIX >> np.uint64(24)).astype(np.int64) % targets
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0]) if len(order) else []
            ends = np.r_[cut[1:], len(order)] if len(order) else []
            rows = [(int(to[order[s]]), key[order[s:e]].tobytes(), fp[at[order[s:e]]].tobytes()) for s, e in zip(cut, ends)]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["target", "key", "fp"],
            )

    return run


def _links(batches):
    k, f = [], []
    for b in batches:
        k += b.column("key").to_pylist()
        f += b.column("fp").to_pylist()
    if not k:
        return
    key, fp = np.frombuffer(b"".join(k), np.int64), np.frombuffer(b"".join(f), np.int64)
    a, b = key_links(key, fp)
    node, at = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    if not len(node):
        return
    root = roots(len(node), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(root != np.arange(len(node)))
    yield pa.record_batch([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])


def links(distinct_fp: DataFrame) -> DataFrame:
    """Distinct ``(fp)`` -> links ``(a, b)`` whose components are those of all pairs within 4 bits."""
    spark = distinct_fp.sparkSession
    targets = 4 * partitions(spark)
    # a file of fingerprints is small beside its keys, so tasks are cut by rows, not by bytes read
    dealt = distinct_fp.select("fp").repartition(partitions(spark), "fp")
    blocks = dealt.mapInArrow(released(_spread(targets)), "target int, key binary, fp binary")
    return blocks.repartition(partitions(spark), "target").mapInArrow(released(_links), "a long, b long")


# ------------------------------------------------------------------------------- the operator
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest doc_id reachable over links of four bits or fewer, its own
    included.  Null and empty texts have fingerprint 0 and link like any other.  A null doc_id is
    never the smallest; a component of null ids only has a null component_id.  Repeated rows and
    other columns do no harm; an empty table gives an empty table.
    """
    d = materialise(fingerprints(docs), "prints")
    n = d.count()
    one = materialise(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", n)
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    joined = materialise(links(one).distinct(), "links", n)
    tune(spark)
    root = materialise(components(joined), "roots", n)
    linked = materialise(root.join(one, root.node == one.fp).select("node", "root", "least"), "linked", n)
    small = materialise(linked.groupBy("root").agg(F.min("least").alias("low")), "small", n)
    named = materialise(
        linked.join(small.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("node", "low"),
        "named",
        n,
    )
    every = materialise(
        one.join(named, one.fp == named.node, "left").select(
            F.col("fp").alias("f"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("low")).alias("component_id")
        ),
        "every",
        n,
    )
    return d.join(every, d.fp == every.f).select("doc_id", "fp", "component_id")


def same_prints(printed: DataFrame) -> DataFrame:
    """Written links ``(a, b)`` of nodes, enough to join what fingerprints within four bits join.

    ``printed``: a written table with ``node`` (distinct) and ``fp``.
    """
    n = printed.count()
    spark = printed.sparkSession
    one = materialise(printed.groupBy("fp").agg(F.min("node").alias("least")), "distinct", n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    joined = materialise(links(one).distinct(), "links", n)
    tune(spark)
    root = components(joined).where("node <> root")
    lead = root.join(one, root.node == one.fp).select(F.col("least").alias("a"), "root")
    lead = lead.join(one.select(F.col("fp").alias("f"), F.col("least").alias("b")), F.col("root") == F.col("f")).select("a", "b")
    same = printed.select("node", F.col("fp").alias("f")).join(one, F.col("f") == F.col("fp")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return materialise(lead.unionByName(same), "close", n)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the smallest id, ties by a hash of the text.

    Rows are told apart by id and text; rows that agree in both are one.  A null id never wins over a real one;
    of a component of null ids one row stays.
    """
    d = docs.select(F.monotonically_increasing_id().alias("node"), docs["doc_id"].cast("long").alias("doc_id"), MARK(docs).alias("mark"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("node"), b.column("doc_id"), b.column("mark"), pa.array(fp.view(np.int64))], names=["node", "doc_id", "mark", "fp"])

    tune(docs.sparkSession)
    printed = materialise(d.mapInArrow(released(run), "node long, doc_id long, mark long, fp long"), "printed")
    return without(docs, *left_out(same_prints(printed), printed))


def left_out(linked: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written ``(doc_id, mark)`` of rows that don't stay, and of rows that stay but are repeated.

    ``linked``: written links of nodes; ``rows``: a written table of ``node, doc_id, mark``.  Of what links join
    the row with the smallest id stays, ties by mark; null ids come last.
    """
    n = 2 * linked.count()
    root = components(linked)
    every = materialise(root.join(rows.select(F.col("node").alias("x"), "doc_id", "mark"), F.col("node") == F.col("x")).select("root", "doc_id", "mark"), "grouped", n)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    first = every.groupBy("root").agg(least.alias("w")).select(F.col("root").alias("r"), F.col("w.doc_id").alias("i"), F.col("w.mark").alias("m"))
    first = materialise(first, "first", n)
    stays = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))
    told = materialise(every.join(first, F.col("root") == F.col("r")).select("doc_id", "mark", stays.alias("stays")), "told", n)
    gone = materialise(told.where(~F.col("stays")).select("doc_id", "mark").distinct(), "gone", n)
    again = told.where("stays").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    return gone, materialise(again, "again", n)
