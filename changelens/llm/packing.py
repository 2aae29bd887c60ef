"""Best-fit packing in bulk-synchronous supersteps.

Documents become token pieces.  A piece longer than half the capacity shares with no other such, so it opens a
sequence, which leaves a gap.  Then supersteps repeat.  Pieces that are left and gaps are sorted together by range of
size, largest first, a gap before a piece of its size; a hot size is split by row.  Along that order a successor sweep
is a matching of brackets: each piece takes the smallest gap that it fits and that no longer piece has taken.  Every
partition sweeps its own range and is left with pieces that found no gap in it, and gaps that no piece took; how many
of either is all that the driver learns of a partition.  Between partitions conflicts are resolved by these ranks: the
first pieces left in a range get the last gaps left in the ranges before.  Then gaps are updated, and the next superstep
begins.  A superstep that places few opens sequences for the longest pieces, as many as the rest needs at least.

Where all pieces left are short and gaps fewer than they, a gap is cut into slots that hold the longest of them, so it
takes several in one superstep, and what its slots are left with is one gap again.  Supersteps go on to the last piece,
at every size of the table alike; places within sequences are summed up at the end.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm._util import materialise, partitions, released, texts, tune

CAPACITY = 1024
END_ID = 2
#: Fixed value: the vocabulary's own mark, which counts as one id where a text holds it.
SPECIAL = {"<|endoftext|>": 50256}


# ------------------------------------------------------------------------------ tokenising
class Tokens:
    """Token ids of the byte-level vocabulary.

    The rank file of the same vocabulary encodes four times as fast as the JSON file and gives equal
    ids; tests hold this for every character up to U+024F.  A text with any other character goes to
    the JSON file's own library, whose tables of character classes are another edition.
    """

    def __init__(self, json_path: str, rank_path: str | None):
        self.json_path, self.fast = json_path, None
        if rank_path:
            import public_tokenizers
            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.beyond = re.compile("[^\x00-ɏ]").search

    @cached_property
    def whole(self):
        """The JSON file's own library, loaded when a text first needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self.beyond(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)


@lru_cache(2)
def tokens(json_path: str, rank_path: str | None) -> Tokens:
    return Tokens(json_path, rank_path)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full, but the first may be shorter."""
    lead = n % capacity or min(n, capacity)
    return [(0, lead)] + [(s, capacity) for s in range(lead, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, paths: tuple | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids array<int>``."""
    tune(docs.sparkSession)
    where = paths or default_paths()

    def run(batches):
        t = tokens(*where)
        for b in batches:
            rows, doc_ids = [], b.column("doc_id").to_pylist()
            for doc_id, text in zip(doc_ids, b.column("text").to_pylist()):
                ids = np.append(t.encode(text), END_ID).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[s : s + n]
                    rows.append((doc_id, k, s, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols[:keep], kinds)], names=names[:keep])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return texts(docs).mapInArrow(released(run), schema + (", ids array<int>" if with_ids else ""))


# ------------------------------------------------------------------------------ supersteps
#: A superstep that places less than one piece in FEW opens sequences.
FEW = 4
PIECE, GAP = 1, 0


def sweep(kind: np.ndarray) -> np.ndarray:
    """Brackets in sorted order (gaps open, pieces close) -> each one's partner, -1 without."""
    partner, open_ = np.full(len(kind), -1, np.int64), []
    for k, piece in enumerate(kind.tolist()):
        if not piece:
            open_.append(k)
        elif open_:
            g = open_.pop()
            partner[k], partner[g] = g, k
    return partner


def between(left: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(pieces, gaps) that each partition is left with, in order -> runs ``(piece partition, first rank, how many, gap
    partition, last rank)``: pieces of rising rank get gaps of falling rank."""
    runs, open_ = [], []
    for part, (pieces, gaps) in enumerate(left):
        at = 0
        while at < pieces and open_:
            q, n = open_.pop()
            m = min(n, pieces - at)
            runs.append((part, at, m, q, n - 1))
            at += m
            if n > m:
                open_.append((q, n - m))
        if gaps:
            open_.append((part, gaps))
    return runs


def _swept(batches):
    """A sorted partition with each row's partner there, or its rank among those of its kind without one."""
    part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
    if not held:
        return
    size, kind, id_ = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("size", "kind", "id"))
    partner = sweep(kind)
    alone = partner < 0
    rank = np.full(len(kind), -1, np.int64)
    for k in (PIECE, GAP):
        own = alone & (kind == k)
        rank[own] = np.arange(own.sum())
    cols = [size, kind, id_, np.where(alone, -1, id_[partner]), np.where(alone, 0, size[partner]), rank, np.full(len(kind), part, np.int32)]
    yield pa.record_batch([pa.array(c) for c in cols], names=["size", "kind", "id", "other", "other_size", "rank", "part"])


def slots(gaps: DataFrame, longest: int, most: int) -> DataFrame:
    """Gaps ``(id, size)`` cut into slots that hold the longest piece each, at most so many to a gap; the last slot of a
    gap holds what is left."""
    n = F.least(F.greatest(F.expr(f"size div {longest}"), F.lit(1)), F.lit(most))
    cut = gaps.withColumn("n", n).select("id", "size", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    return cut.select("id", F.when(F.col("k") < F.col("n"), F.lit(longest)).otherwise(F.col("size") - (F.col("n") - 1) * longest).cast("long").alias("size"))


def _superstep(left: DataFrame, gaps: DataFrame, longest: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``left`` (id, size), ``gaps`` (id, size) -> written (placed: id, sequence_id, size), left, gaps.

    A gap takes as many pieces at once as it has slots, ``most`` at most."""
    if most > 1:
        gaps = slots(gaps, longest, most)
    spark = left.sparkSession
    p = partitions(spark)
    rows = left.select("size", F.lit(PIECE).alias("kind"), "id").unionByName(gaps.select("size", F.lit(GAP).alias("kind"), "id"))
    rows = rows.repartitionByRange(p, F.desc("size"), "kind", "id").sortWithinPartitions(F.desc("size"), "kind", "id")
    met = materialise(rows.mapInArrow(released(_swept), "size long, kind int, id long, other long, other_size long, rank long, part int"), "swept")
    over = {(r.part, r.kind): r["count"] for r in met.where("rank >= 0").groupBy("part", "kind").count().collect()}  # two rows a partition at most
    last = max((k[0] for k in over), default=-1) + 1
    runs = between([(over.get((k, PIECE), 0), over.get((k, GAP), 0)) for k in range(last)])
    by_part = {kind: {} for kind in (PIECE, GAP)}
    for n, (part, r0, m, q, g0) in enumerate(runs):
        by_part[PIECE].setdefault(part, []).append((r0, m, n))
        by_part[GAP].setdefault(q, []).append((g0 - m + 1, m, n))
    table = spark.sparkContext.broadcast({kind: {k: np.array(sorted(v), np.int64).T for k, v in d.items()} for kind, d in by_part.items()})

    def numbered(batches):
        """The run and the place in it by which a row without a partner meets one of another partition; run -1: none."""
        for b in batches:
            part, kind, rank = (b.column(c).to_numpy() for c in ("part", "kind", "rank"))
            run, place = np.full(len(part), -1, np.int64), np.zeros(len(part), np.int64)
            for k in (PIECE, GAP):
                for q in np.unique(part[kind == k]):
                    own = np.flatnonzero((part == q) & (kind == k))
                    if int(q) not in table.value[k]:
                        continue
                    first, many, number = table.value[k][int(q)]
                    at = np.searchsorted(first, rank[own], side="right") - 1
                    into = rank[own] - first[np.maximum(at, 0)]
                    hit = (at >= 0) & (into < many[at])
                    run[own[hit]] = number[at[hit]]
                    place[own[hit]] = into[hit] if k == PIECE else many[at[hit]] - 1 - into[hit]
            yield pa.record_batch([*[b.column(c) for c in ("size", "kind", "id")], pa.array(run), pa.array(place)], names=["size", "kind", "id", "run", "place"])

    alone = met.where("rank >= 0").select("size", "kind", "id", "rank", "part")
    if runs:  # of each partition the first pieces and the last gaps meet others; what meets none stays as it is
        bounds = [(q, PIECE, 0, max(r + m for r, m, _ in own)) for q, own in by_part[PIECE].items()]
        bounds += [(q, GAP, min(r for r, *_ in own), 1 << 62) for q, own in by_part[GAP].items()]  # two rows a partition at most
        meets = F.broadcast(spark.createDataFrame(bounds, "p int, k int, low long, high long"))
        told = alone.join(meets, (F.col("part") == F.col("p")) & (F.col("kind") == F.col("k")), "left").withColumn("meets", F.coalesce((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), F.lit(False)))
        asked = told.where("meets").select("size", "kind", "id", "rank", "part").mapInArrow(numbered, "size long, kind int, id long, run long, place long")
        asked = materialise(asked, "asked")
        far_gap = asked.where((F.col("kind") == GAP) & (F.col("run") >= 0)).select("run", "place", F.col("id").alias("other"), F.col("size").alias("other_size"))
        far = asked.where((F.col("kind") == PIECE) & (F.col("run") >= 0)).join(far_gap, ["run", "place"]).select("id", "size", "other", "other_size")
        alone = told.where(~F.col("meets")).select("size", "kind", "id").unionByName(asked.where("run < 0").select("size", "kind", "id"))
    near = met.where((F.col("kind") == PIECE) & (F.col("rank") < 0)).select("id", "size", "other", "other_size")
    fits = materialise(near.unionByName(far) if runs else near, "fits")
    placed = fits.select("id", F.col("other").alias("sequence_id"), "size")
    rest = fits.select(F.col("other").alias("id"), (F.col("other_size") - F.col("size")).alias("size")).where("size > 0")
    kept = alone.where(F.col("kind") == GAP).select("id", "size")
    after = rest.unionByName(kept)
    if most > 1:  # a gap's slots are one gap again
        after = materialise(after.groupBy("id").agg(F.sum("size").alias("size")), "gaps")
    return placed, alone.where(F.col("kind") == PIECE).select("id", "size"), after


# ------------------------------------------------------------------------------ the operator
#: So many pieces of one length are told apart exactly by their hashes; of more the share that is expected is taken.
TOLD = 10_000


def _opened(left: DataFrame, by_length: dict[int, int], many: int):
    """Condition that holds for the ``many`` longest pieces, one at least; of one length those of the smallest hashes."""
    for n in sorted(by_length, reverse=True):
        if many <= 0:
            return F.col("size") > n
        if by_length[n] > many:
            mixed = F.struct(F.xxhash64("id", F.lit(by_length[n])).alias("h"), F.col("id").alias("i"))  # another hash each time
            if many > TOLD:
                return (F.col("size") > n) | ((F.col("size") == n) & (F.pmod(mixed["h"], F.lit(1 << 20)) < (many << 20) // by_length[n]))
            last = left.where(F.col("size") == n).select(mixed.alias("m")).orderBy("m").limit(many).agg(F.max("m")).first()[0]
            low = F.struct(F.lit(last.h).alias("h"), F.lit(last.i).alias("i"))
            return (F.col("size") > n) | ((F.col("size") == n) & (mixed <= low))
        many -= by_length[n]
    return F.lit(True)


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces ``(doc_id, piece, length 1..capacity, ...)`` -> the same and ``sequence_id, offset``.

    A sequence has the number of the piece that opened it, which stands first in it.  Supersteps go on until no piece is
    left; the driver takes counts for each length and each partition.
    """
    spark = parts.sparkSession
    names = parts.columns
    pieces_ = materialise(parts.withColumn("id", F.monotonically_increasing_id()), "pieces")
    every = pieces_.select("id", F.col("length").alias("size"))
    first = F.col("size") * 2 > capacity
    placed = [every.where(first).select("id", F.col("id").alias("sequence_id"), "size")]
    left = every.where(~first)
    gaps = every.where(first).select("id", (F.lit(capacity) - F.col("size")).alias("size")).where("size > 0")
    before = None
    while True:
        by_length = {r["size"]: r["count"] for r in left.groupBy("size").count().collect()}  # a row a length
        n = sum(by_length.values())
        if not n:
            break
        longest = max(by_length)
        if before is not None and before - n < max(1, n // FEW):  # few found a gap: the longest open sequences
            least = min(by_length)
            room = gaps.where(F.col("size") >= least).agg(F.sum("size")).first()[0] or 0
            total = sum(k * c for k, c in by_length.items())
            many = max(-(-max(0, total - room) // capacity), total // capacity // 2, 1)
            opens = materialise(left.withColumn("opens", _opened(left, by_length, many)), "opens")
            placed.append(opens.where("opens").select("id", F.col("id").alias("sequence_id"), "size"))
            gaps = gaps.unionByName(opens.where("opens").select("id", (F.lit(capacity) - F.col("size")).alias("size")).where("size > 0"))
            left = opens.where(~F.col("opens")).select("id", "size")
            before = None
            continue
        before = n
        gaps = gaps.where(F.col("size") >= min(by_length))
        most = 1
        if 2 * longest <= capacity:  # short pieces: a gap may take several at once, if there are fewer gaps than pieces
            open_ = gaps.count()
            most = -(-2 * n // open_) if 0 < open_ < n else 1
        got, left, gaps = _superstep(left, gaps, longest, most)
        placed.append(got)
    at = placed[0]
    for more in placed[1:]:
        at = at.unionByName(more)
    order = Window.partitionBy("sequence_id").orderBy(F.col("id") != F.col("sequence_id"), F.desc("size"), "id")  # a sequence has ``capacity`` pieces at most
    at = at.select(F.col("id").alias("at"), "sequence_id", (F.sum("size").over(order) - F.col("size")).alias("offset"))
    return pieces_.join(at, F.col("id") == F.col("at")).select(*names, "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.
    Null and empty texts are one piece of the end mark; very long texts are cut into pieces.  Repeated
    rows and null ids are packed like others; other columns are ignored; an empty table gives an empty table.
    """
    return pack_pieces(pieces(docs, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of a packing that carries ids; a sequence has at most the capacity."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))
