"""Replay of past changes: scopes, answer diffs, replacements, case metrics and their summary."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from changelens.functions.lazy import vectorised

from changelens.functions.text import holds, loose_path, squeeze, under
from changelens.schemas import ARTIFACTS


def in_scope(changed: DataFrame, scopes: DataFrame) -> DataFrame:
    """``case_id, path, scope``: excluded before in scope before out of scope.

    ``scopes``: case_id, kind (relevant or excluded), spec.  A case's specs are a few lines of a fixture and
    travel as two arrays, so a changed file stays one row.
    """
    specs = scopes.groupBy("case_id").agg(
        F.collect_list(F.when(F.col("kind") == "excluded", loose_path(F.col("spec")))).alias("ex"), F.collect_list(F.when(F.col("kind") == "relevant", loose_path(F.col("spec")))).alias("rel")
    )
    c = changed.withColumn("path", loose_path(F.col("path"))).join(specs, "case_id", "left")
    hit = lambda a: F.coalesce(F.exists(a, lambda s: under(F.col("path"), s)), F.lit(False))
    return c.select("case_id", "path", F.when(hit("ex"), "excluded").when(hit("rel"), "in_scope").otherwise("out_of_scope").alias("scope"))


def answer_diff(statuses: DataFrame, counts: DataFrame) -> DataFrame:
    """Changed files with their added and removed lines, none where unknown."""
    s, c = statuses.withColumn("path", loose_path(F.col("path"))), counts.withColumn("path", loose_path(F.col("path")))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return s.join(c, "path", "left").select("path", "status", zero("added"), zero("removed"))


def check_replacements(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``case_id, path, path_exists, found_after, found_before, ok`` at the answer's revision."""
    e = expected.withColumn("path", loose_path(F.col("path")))
    j = e.join(files.select("case_id", F.col("path").alias("p"), "content"), (e["path"] == F.col("p")) & (e["case_id"] == files["case_id"]), "left").drop(files["case_id"])
    there = F.col("content").isNotNull()
    found = lambda c: F.coalesce(holds(F.col("content"), F.col(c), F.col("match_mode")), F.lit(False))
    out = j.select("case_id", "path", there.alias("path_exists"), found("after").alias("found_after"), found("before").alias("found_before"))
    return out.withColumn("ok", F.col("path_exists") & F.col("found_after") & ~F.col("found_before"))


def replacement_key(path, before, after, mode):
    """One key for a replacement; texts are squeezed where the mode says so."""
    loose = mode == "normalized_text"
    t = lambda x: F.when(loose, squeeze(x)).otherwise(x)
    return F.concat_ws("\0", loose_path(path), t(before), t(after))


def generated_keys(generated: DataFrame) -> DataFrame:
    """Both keys of each generated replacement, so that any mode finds it."""
    k = lambda m: replacement_key(F.col("path"), F.col("before"), F.col("after"), F.lit(m))
    return generated.select("case_id", F.explode(F.array_distinct(F.array(k("exact"), k("normalized_text")))).alias("key"))


@vectorised("double")
def diff_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two diffs by squeezed lines; 0 where one is missing.  For reference only."""

    def one(x, y):
        x, y = ([" ".join(line.split()) for line in (t or "").splitlines()] for t in (x, y))
        x, y = [i for i in x if i], [i for i in y if i]
        return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def summary(metrics: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c)
    return metrics.agg(
        F.count("*").alias("case_count"), F.count_if("passed").alias("passed_count"), F.coalesce(F.round(F.avg(F.col("passed").cast("double")), 6), F.lit(0.0)).alias("pass_rate"),
        *[mean(c) for c in ("replacement_rate", "file_coverage", "unnecessary_rate", "jaccard")],
        F.count_if(F.coalesce("git_apply", F.lit(False))).alias("git_apply_ok_count"), F.count_if(F.coalesce(F.col("golden_status") == "passed", F.lit(False))).alias("golden_passed_count"),
    )


def allowed(artifacts: DataFrame, mode_column: str = "privacy_mode") -> DataFrame:
    """Artifacts that their mode lets out; a kind that no list names stays in."""
    spark = artifacts.sparkSession
    table = spark.createDataFrame([(m, k) for m, ks in ARTIFACTS.items() for k in ks], "m string, k string")
    return artifacts.join(F.broadcast(table), (F.col(mode_column) == F.col("m")) & (F.col("artifact_kind") == F.col("k")), "left_semi")  # a table of 16 rows


def strictest(cases: DataFrame) -> DataFrame:
    """The strictest privacy mode among cases."""
    order = F.array_position(F.array(F.lit("full"), F.lit("redacted"), F.lit("metadata_only")), F.col("privacy_mode"))
    return cases.agg(F.max_by("privacy_mode", order).alias("privacy_mode"))
