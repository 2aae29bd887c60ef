"""The corpus pipeline: each stage reads what its predecessor kept.

All stages but the last return the columns of documents.  Toxic documents go; of equal texts, and of
each group of near duplicates, one document stays; personal data are masked; what is left is packed
into token sequences.  Models learn from the labels and documents that a stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changelens.llm import exact_dedup, packing, pii, similar, toxicity
from changelens.llm._util import materialise, read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores is below one half."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the document with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within four bits, or by a Jaccard of 0.8 or more over five-word
    shingles, the one with the smallest id."""
    return similar.drop_similar(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned scores and tokenisation are not expressible in SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
