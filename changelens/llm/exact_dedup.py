"""Exact deduplication by a minimal perfect hash over the historical distinct digests.

History is indexed in shards.  A shard's minimal perfect hash (levels of collision-free bits, a key
that collides moves to the next level, the rank of its bit is its slot) maps each historical digest
to one slot that holds the full 32-byte digest, the winner's id and the number of rows.  An incoming
digest is looked up in its shard and compared byte by byte with the slot, so a digest that the hash
was not built for is never taken for a member; nonmembers form groups of their own.

Counts are combined per digest before any shuffle, shards are cut by digest bits (uniform however
many copies a text has) and their number follows the history, so no task grows with a hot group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import materialise, texts, tune, without

#: The white space that separates words in the contract of equality.
SPACE = r"[\x20\x09-\x0D]+"
#: Historical digests in one shard, about.
SHARD_KEYS = 50_000
GAMMA = 2.0


# ---------------------------------------------------------------------- the perfect hash itself
def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser; each level uses another increment."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(digests: np.ndarray) -> np.ndarray:
    """``(n, 32)`` bytes -> 64-bit keys folded from the whole digest."""
    w = np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)
    return w[:, 0] ^ _mix(w[:, 1], 1) ^ _mix(w[:, 2], 2) ^ _mix(w[:, 3], 3)


def build_mph(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct ``(n, 32)`` digests -> (bit levels, slot of each digest); slots are 0..n-1.

    Distinct digests whose folded 64-bit keys agree can never separate; that has odds below
    2**-31 for a shard and raises rather than loops.
    """
    keys, levels, slots, base = _words(digests), [], np.zeros(len(digests), np.int64), 0
    left = np.arange(len(digests))
    while len(left):
        if len(levels) > 200:
            raise ValueError("digests in this shard share a folded key")
        size = max(64, int(GAMMA * len(left)) | 1)
        pos = (_mix(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(pos, minlength=size) == 1
        own = bits[pos]
        rank = np.cumsum(bits) - 1
        slots[left[own]] = base + rank[pos[own]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~own]
    return levels, slots


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot that the hash gives each digest, -1 where no level has its bit.  Not yet byte-checked."""
    keys, out, base = _words(digests), np.full(len(digests), -1, np.int64), 0
    left = np.arange(len(digests))
    for k, bits in enumerate(levels):
        if not len(left):
            break
        pos = (_mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
        own = bits[pos]
        rank = np.cumsum(bits) - 1
        out[left[own]] = base + rank[pos[own]]
        base += int(bits.sum())
        left = left[~own]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _pack(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.packbits(b).tobytes() for b in levels), [len(b) for b in levels]


def _unpack(blob: bytes, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        m = (n + 7) // 8
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, m, at), count=n).astype(bool))
        at += m
    return out


INDEX = "shard long, bits binary, sizes array<int>, digests binary, winners binary, real binary, counts binary"


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    d = _matrix(pdf.digest)
    levels, slots = build_mph(d)
    place = np.argsort(slots)
    bits, sizes = _pack(levels)
    return pd.DataFrame(
        {
            "shard": [key[0]],
            "bits": [bits],
            "sizes": [sizes],
            "digests": [d[place].tobytes()],
            "winners": [pdf.winner.to_numpy(np.int64)[place].tobytes()],
            "real": [pdf.real.to_numpy(bool)[place].tobytes()],
            "counts": [pdf.n.to_numpy(np.int64)[place].tobytes()],
        }
    )


GROUPS = "digest binary, keep_id long, real boolean, group_size long"


def _lookup(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Slots with the rows that hit them, then the groups of nonmembers."""
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row.digests, np.uint8).reshape(-1, 32)
        keep = np.frombuffer(row.winners, np.int64).copy()
        real = np.frombuffer(row.real, bool).copy()
        size = np.frombuffer(row.counts, np.int64).copy()
    else:
        held, keep, real, size = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    out = [pd.DataFrame({"digest": [x.tobytes() for x in held], "keep_id": keep, "real": real, "group_size": size})]
    if len(new):
        d, n, won, has = _matrix(new.digest), new.n.to_numpy(np.int64), new.winner.to_numpy(np.int64), new.real.to_numpy(bool)
        member = np.zeros(len(d), bool)
        if len(held):
            slot = find_slots(_unpack(row.bits, list(row.sizes)), d)
            at = np.flatnonzero(slot >= 0)
            at = at[(held[slot[at]] == d[at]).all(axis=1)]  # the byte check
            member[at] = True
            size[slot[at]] += n[at]
            keep[slot[at]] = np.minimum(keep[slot[at]], won[at])
            real[slot[at]] |= has[at]
        out[0]["group_size"], out[0]["keep_id"], out[0]["real"] = size, keep, real
        rest = ~member
        out.append(pd.DataFrame({"digest": new.digest[rest], "keep_id": won[rest], "real": has[rest], "group_size": n[rest]}))
    return pd.concat(out, ignore_index=True)


#: Stands for a missing id while ids are compared: no real one sorts after it, and ``real`` tells them apart.
NO_ID = 2**63 - 1


# ------------------------------------------------------------------------------- the operator
def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, mark)``: the digest is of the normalised whole text, the mark a hash of the text as it is;
    null counts as empty."""
    d = texts(docs, id_col=id_col, text_col=text_col)
    normal = F.regexp_replace("text", SPACE, " ")
    return d.select("doc_id", F.unhex(F.sha2(normal, 256)).alias("digest"), F.xxhash64("text").alias("mark"))


def history_index(per_digest: DataFrame, shards: int) -> DataFrame:
    """``(digest, winner, n)`` of distinct digests -> one index row for each shard."""
    return per_digest.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, INDEX)


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def _per_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("winner"), (F.count("doc_id") > 0).alias("real"), F.count("*").alias("n")
    )


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written ``doc_id, digest, mark`` of every row, and ``held, keep_id, group_size`` of every digest."""
    tune(docs.sparkSession)
    d = materialise(digests(docs, id_col, text_col), "digests")
    lo, hi, n = d.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = 0 if lo is None else (lo + hi) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    shards = max(1, -(-n // (2 * SHARD_KEYS)))
    index = materialise(history_index(_per_digest(d.where(old)), shards), "mph")
    new = _per_digest(d.where(~old)).withColumn("shard", _shard(shards))
    groups = new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_lookup, GROUPS)
    groups = groups.select(F.col("digest").alias("held"), F.when(F.col("real"), F.col("keep_id")).alias("keep_id"), "group_size")
    return d, materialise(groups, "groups", n)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The lower half of the id range is the history, the upper half arrives afterwards; the result
    does not depend on where the line is drawn.  Null and empty texts are one group, as are texts
    that differ in white space only.  Rows that repeat an id together with its text share its
    decision.  A null id never wins over a real one; a group of null ids only has a null keep_id
    and its rows stay.  Very long texts are hashed whole.  An empty table gives an empty table;
    other columns are ignored.
    """
    d, groups = _grouped(docs, id_col, text_col)
    return d.join(groups, d.digest == groups.held).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts stays, with its own columns: that with the smallest id.

    Rows are told apart by id and text, so an id that comes with several texts is several documents.  Of rows
    of the smallest id whose texts differ in white space, the one with the least hash of its text stays; of rows
    that agree in id and text, the first by their JSON form.  A null id never wins over a real one; of a group of
    null ids one row stays.  Extra columns may have any names; an empty table gives an empty table.
    """
    d, groups = _grouped(docs)
    first = groups.where("group_size > 1").select("held", F.col("keep_id").alias("k"))
    of_more = d.join(first, F.col("digest") == F.col("held")).select("doc_id", "mark", "digest", F.col("doc_id").eqNullSafe(F.col("k")).alias("won"))
    counted = materialise(of_more.groupBy("digest", "doc_id", "mark", "won").count(), "counted")
    best = materialise(counted.where("won").groupBy("digest").agg(F.min("mark").alias("best")).withColumnRenamed("digest", "h"), "best")
    stays = F.col("won") & (F.col("mark") == F.col("best"))
    told = materialise(counted.join(best, F.col("digest") == F.col("h")).select("doc_id", "mark", "count", stays.alias("stays")), "told")
    return without(docs, told.where(~F.col("stays")).select("doc_id", "mark"), told.where("stays AND count > 1").select("doc_id", "mark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
