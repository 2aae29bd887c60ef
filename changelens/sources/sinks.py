"""Writes: keyed tables, append-only logs, reports with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.operators.replay import allowed
from changelens.sources import store


def by_source(df: DataFrame, path: str, source: str = "source") -> None:
    """Each source is a partition; only partitions with new rows are rewritten, so a rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def append_events(df: DataFrame, path: str, key: tuple[str, ...] = ("run_id", "sequence_no")) -> int:
    """Commits events to the log at a path; an event whose key is there already is refused.  The commit's number."""
    return store.Log(df.sparkSession, path, key).append(df)


def event_ids(df: DataFrame, at: str = "occurred_at", order: str = "ord", prefix: str = "F") -> DataFrame:
    """Daily ids: prefix, day, number within the day."""
    dated = df.withColumn("day_", F.date_format(at, "yyyyMMdd"))
    n = store.numbered(dated, ["day_"], [at, order], "number_")
    return n.withColumn("event_id", F.concat(F.lit(f"{prefix}-"), "day_", F.lit("-"), F.lpad(F.col("number_").cast("string"), F.greatest(F.lit(4), F.length(F.col("number_").cast("string"))), "0"))).drop("day_", "number_")


def report(cases: DataFrame, artifacts: DataFrame, folder: str) -> DataFrame:
    """Cases as JSON lines, and of the artifacts only what their mode allows; returns the manifest."""
    cases.write.mode("overwrite").json(f"{folder}/cases")
    allowed(artifacts).write.mode("overwrite").json(f"{folder}/artifacts")
    files = cases.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    manifest = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return cases.sparkSession.read.parquet(f"{folder}/manifest")
