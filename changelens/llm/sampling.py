"""Bounded samples of labelled rows for the learned operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Slices of the hash by which rows are picked.
SLICES = 1 << 20


def first_by_hash(rows: DataFrame, most: int, *keys: str, total: int | None = None) -> DataFrame:
    """The ``most`` rows that come first by a hash of the keys, ties by the keys' own order.

    All but so many slices of the hash as hold four times what is wanted are left out before the sort,
    so that a task does not keep ``most`` rows for the one that merges them, however many tasks there are.
    ``total``: how many rows there are, if known.
    """
    total = rows.count() if total is None else total
    wanted = 4 * most / max(1, total)
    mixed = F.xxhash64(*keys)
    own = F.pmod(mixed, F.lit(SLICES))
    if wanted < 1:
        rows = rows.where(own < max(1, int(wanted * SLICES)))
    return rows.orderBy(own, mixed, *keys).limit(most)


def fold(docs_or_labels: DataFrame, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(docs_or_labels["doc_id"].cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, learn_held: bool, most: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` labelled rows (the first by a hash of the id).

    Rows are labelled if their label is 0 or 1; of repeated labels the largest counts.
    ``learn_held``: learn from the fold ``held`` only, else from all others.  At most ``most`` ids are
    broadcast; of an id that comes with several texts, or repeatedly, one text counts (that with the
    least hash), so no more than ``most`` rows come back.
    """
    at = fold(labels, folds)
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"), at.alias("at"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)")
        .where(F.col("at") == held if learn_held else F.col("at") != held)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    picked = first_by_hash(known, most, "doc_id").withColumnRenamed("doc_id", "wanted")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    met = rows.join(F.broadcast(picked), rows.doc_id == F.col("wanted"))
    return met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
