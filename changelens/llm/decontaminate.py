"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of test items.

Normalising lower-cases A-Z and takes every other ASCII character that is no letter or digit as a separator, byte by
byte, so words are runs of bytes and whole texts of any length go through two C calls.  Windows of ten consecutive item
words (items of fewer: all of them), each between single spaces, are the automaton's patterns; the normalised text is
scanned once, and hits are mapped back to words and to characters of the original.

The automaton is broadcast, so its size is checked first: it holds LETTERS pattern letters at most.  Larger benchmarks
are dealt by a hash of (window, item) into that many parts, each scanned for in its own pass and released before the
next; what the passes find is merged per text.
"""

from __future__ import annotations

import itertools

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import MARK, discard, materialise, released, tune, unused, without

#: Consecutive words of a window, and pattern letters in one automaton (about 60 bytes each in a worker).
WORDS, LETTERS = 10, 3_000_000
#: Fixed values of the contract: A-Z fold to a-z; ASCII that is neither letter nor digit separates.
_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
_IS_WORD = np.array([b != 0x20 for b in _FOLD])


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a UTF-8 text; none of null."""
    return text.translate(_FOLD).split() if text else []


def _offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each word, in code points of the original."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.r_[False, _IS_WORD[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters before each byte
    return chars[edges[::2]], chars[edges[1::2]]


def windows(benchmark: DataFrame, size: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``window, item``: windows of ``size`` words of each item, or all words of a shorter one.

    Rows of one item id are one item; a null id counts as an item named by the empty string.
    """

    def cut(batches):
        for b in batches:
            own, items = [], []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                got = {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else ()
                own.extend(got)
                items.extend([item] * len(got))
            yield pa.record_batch([pa.array(own, pa.binary()), pa.array(items, pa.string())], names=["window", "item"])

    rows = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), benchmark[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "window binary, item string").distinct()


#: The automaton of the broadcast that a worker met last.
_BUILT: dict = {}
_TOKENS = itertools.count()


def _automaton(token: int, held) -> ahocorasick.Automaton:
    if token not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for window, items in held.value:
            a.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
        a.make_automaton()
        _BUILT[token] = a
    return _BUILT[token]


def _merged(runs: list[list[int]]) -> list[list[int]]:
    """Runs ``[first, after last, ...]`` in order of their ends, overlapping or touching ones joined."""
    out: list[list[int]] = []
    for run in runs:
        while out and out[-1][1] >= run[0]:
            last = out.pop()
            run = [min(last[0], run[0]), max(last[1], run[1])]
        out.append(run)
    return out


def _scan(a: ahocorasick.Automaton, own: list[bytes]) -> tuple[list[list[int]], set[str]]:
    """Runs of hit words, and the items whose windows hit."""
    line = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])  # the position of the blank after each word, the first blank at 0
    at, sizes, items = [], [], set()
    for end, (n, who) in a.iter(f" {line.decode('latin-1')} "):
        at.append(end)
        sizes.append(n)
        items.update(who)
    if not at:
        return [], items
    last = np.searchsorted(ends, at)
    return _merged([[int(e) - n + 1, int(e) + 1] for e, n in zip(last, sizes, strict=True)]), items


_FOUND = "doc_id long, mark long, n_words long, runs array<array<long>>, items array<string>"


def _pass(docs: DataFrame, held, all_rows: bool) -> DataFrame:
    token = next(_TOKENS)

    def run(batches):
        a = _automaton(token, held) if held is not None else None
        for b in batches:
            counts, runs, items, keep = [], [], [], []
            for k, text in enumerate(b.column("text")):
                text = text.as_py()
                own = words(text)
                hit, who = _scan(a, own) if a and own else ([], set())
                if hit:
                    starts, ends = _offsets(text)
                    hit = [[x, y, int(starts[x]), int(ends[y - 1])] for x, y in hit]
                if hit or all_rows:
                    keep.append(k)
                    counts.append(len(own))
                    runs.append(hit)
                    items.append(sorted(who))
            pick = pa.array(keep, pa.int64())
            yield pa.record_batch(
                [b.column("doc_id").take(pick), b.column("mark").take(pick), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "mark", "n_words", "runs", "items"],
            )

    return docs.mapInArrow(released(run), _FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, letters: int = LETTERS) -> DataFrame:
    """What each document shares with the items of ``benchmark``.

    Returns per row of ``docs``: ``doc_id, mark`` (a hash of the text), ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``items`` (sorted ids as strings), ``spans`` (start and end of each run of hit words, in
    characters of the original text, end exclusive) and ``contaminated``.  Null texts have no words, as have texts of
    separators alone; null ids stay null; repeated rows are reported repeatedly; texts may be of any length; empty tables
    give an empty result or no hits.  Only the id and the text are read, so other columns can't clash.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"), MARK(docs).alias("mark"))
    known = materialise(windows(benchmark, size), "windows")
    total = known.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    parts = -(-total // letters)
    found = None
    for p in range(max(1, parts)):
        mine = known.where(F.pmod(F.xxhash64("window", "item"), F.lit(max(1, parts))) == p)
        patterns = [(bytes(r.window), r["items"]) for r in mine.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")).toLocalIterator()] if total else []
        held = spark.sparkContext.broadcast(patterns) if patterns else None
        got = _pass(rows, held, all_rows=p == 0)
        if parts > 1:  # each pass is written before the next automaton is built
            got = materialise(got.withColumn("pass", F.lit(p)), "hits")
            found = got if found is None else found.unionByName(got)
            if held is not None:
                held.unpersist()
        else:
            found = got
    discard(known)  # all its windows have been read
    if parts > 1:
        found = _joined(found)
    found = found.withColumn("n_hit", F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0]))
    return found.select(
        "doc_id", "mark", "n_words", "n_hit", "items",
        F.transform("runs", lambda r: F.struct(r[2].alias("start"), r[3].alias("end"))).alias("spans"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _joined(found: DataFrame) -> DataFrame:
    """The first pass's rows with what all passes found in their texts."""
    keys = ["doc_id", "mark"]
    hits = found.where(F.size("runs") > 0).groupBy(*keys, "pass").agg(F.first("runs").alias("runs"), F.first("items").alias("items"))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        runs = sorted((list(map(int, r)) for many in g.runs for r in many), key=lambda r: r[1])
        chars = {r[0]: r[2] for r in runs}, {r[1]: r[3] for r in runs}
        whole = [[x, y, chars[0][x], chars[1][y]] for x, y in _merged([r[:2] for r in runs])]
        return pd.DataFrame({"hit_id": [g.doc_id.iloc[0]], "hit_mark": [g.mark.iloc[0]], "runs": [whole], "items": [sorted({i for many in g["items"] for i in many})]}).astype({"hit_id": "Int64"})

    merged = hits.groupBy(*keys).applyInPandas(merge, "hit_id long, hit_mark long, runs array<array<long>>, items array<string>")
    base = found.where(F.col("pass") == 0).select("doc_id", "mark", "n_words")
    none = F.array().cast("array<array<long>>"), F.array().cast("array<string>")
    return base.join(merged, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left").select(
        *keys, "n_words", F.coalesce("runs", none[0]).alias("runs"), F.coalesce("items", none[1]).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """``docs`` without rows that hold a window of the benchmark; columns keep names, order and types."""
    hit = materialise(contamination(docs, benchmark, size).where("contaminated").select("doc_id", "mark").distinct(), "contaminated")
    return without(docs, hit, hit.where(F.lit(False)))


def cut(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """``docs`` with the passages of the benchmark cut out of the texts; all rows stay.

    Rows of an id and text that repeat are cut alike.  Columns keep names, order and types.
    """
    i, m, s, r = (unused(docs, name) for name in ("row_id", "row_mark", "cut_spans", "cut_id"))
    hits = materialise(contamination(docs, benchmark, size).where("contaminated").groupBy("doc_id", "mark").agg(F.first("spans").alias("spans")), "cuts")
    own = docs.withColumns({i: docs["doc_id"].cast("long"), m: MARK(docs)})
    o = hits.select(F.col("doc_id").alias(r), F.col("mark").alias(m + "_"), F.col("spans").alias(s))
    met = own.join(o, F.col(i).eqNullSafe(F.col(r)) & (F.col(m) == F.col(m + "_")), "left")
    # what is left: the pieces before each span, and the one after the last
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(s, lambda x: x["end"]))
    starts = F.concat(F.transform(s, lambda x: x["start"]), F.array(F.char_length("text").cast("long")))
    left = F.concat_ws("", F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))))
    return met.withColumn("text", F.when(F.col(s).isNull(), F.col("text")).otherwise(left)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(report: DataFrame) -> DataFrame:
    """The contract's columns of a report."""
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), dwin AS (
  SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), hit AS (
  SELECT r, k, dwin.size, item FROM dwin JOIN win ON dwin.size = win.size AND dwin.win = win.win
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + size)) AS p FROM hit) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n ON doc.r = n.r LEFT JOIN i ON doc.r = i.r
"""
