"""Source trees as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from changelens.functions.lazy import vectorised

from changelens.schemas import EXCLUDED_DIRS

#: Extensions that are indexed, and those harvested for terms and constants.
INDEXED = (".java", ".sql", ".xml", ".py", ".kt", ".ts", ".tsx", ".js", ".xfdl")
HARVESTED = (".xml", ".sql", ".java", ".xfdl")


@vectorised("string")
def decode(content: pd.Series) -> pd.Series:
    """UTF-8 with or without its mark, else CP949, else UTF-8 with replacements."""

    def one(b):
        for enc in ("utf-8-sig", "cp949"):
            try:
                return bytes(b).decode(enc)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("utf-8", "replace")

    return content.map(one)


def relative(path: Column, root: str) -> Column:
    clean = root.rstrip("/").removeprefix("file:")
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/*", "/"), f"^/*{clean.lstrip('/')}/", "")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = INDEXED, below: tuple[str, ...] = ()) -> DataFrame:
    """``path, content, modified, length`` of the files under a root with the extensions, without those that
    have an excluded folder in their relative path; ``below`` keeps some subtrees only."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = relative(F.col("path"), root)
    ok = F.regexp_extract(F.lower(rel), r"(\.[^./]+)$", 1).isin(*extensions) & ~F.arrays_overlap(F.split(rel, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))
    if below:
        inside = F.lit(False)
        for b in below:
            inside = inside | F.startswith(rel, F.lit(b.strip("/") + "/"))
        ok = ok & inside
    return df.where(ok).select(rel.alias("path"), "content", F.col("modificationTime").alias("modified"), "length")


def texts(files: DataFrame) -> DataFrame:
    return files.select("path", decode("content").alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files as ``source, text``; richer formats need an extractor of their own."""
    df = spark.read.option("wholetext", "true").text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))
    return df


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, status``: ok, missing, or changed, by size and SHA-256 of each listed artifact."""
    now = files.select(F.col("path").alias("p"), F.sha2("content", 256).alias("h"), F.col("length").alias("n"))
    j = manifest.join(now, F.col("path") == F.col("p"), "left")
    return j.select("path", F.when(F.col("h").isNull(), "missing").when((F.col("h") != F.col("sha256")) | (F.col("n") != F.col("size")), "changed").otherwise("ok").alias("status"))
