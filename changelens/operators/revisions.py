"""Files as they were at a revision: as-of lookups over landed versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_revision(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """``case_id, path, position, content``: of each asked file the last version at or before its place.

    ``versions``: repo, path, position, content (null: deleted there); ``asked``: case_id, repo, path, position.  Files
    that weren't there yet, or had been deleted, give no row.  Only versions of asked files are looked at; they and the
    distinct places asked for are merged in one order, so a file with very many versions or places costs their sum,
    however many cases ask for one; contents meet the questions in the last step alone.
    """
    who = asked.select("case_id", "repo", "path", "position").distinct()
    places = who.select("repo", "path", "position").distinct()
    seen = versions.select("repo", "path", "position", F.lit(0).alias("asks")).join(places.select("repo", "path").distinct().hint("merge"), ["repo", "path"], "left_semi")
    w = Window.partitionBy("repo", "path").orderBy("position", "asks")
    events = seen.unionByName(places.withColumn("asks", F.lit(1)))
    met = events.withColumn("last", F.last(F.when(F.col("asks") == 0, F.col("position")), ignorenulls=True).over(w)).where("asks = 1 AND last IS NOT NULL").drop("asks")
    v = versions.select("repo", "path", F.col("position").alias("last"), "content").where("content IS NOT NULL")
    found = met.join(v.hint("merge"), ["repo", "path", "last"])
    return who.join(found, ["repo", "path", "position"]).select("case_id", "path", F.col("last").alias("position"), "content")


def snapshot(versions: DataFrame, revisions: DataFrame) -> DataFrame:
    """``repo, revision, path, content``: the whole tree at each revision (``repo, revision``: a place in the repo).

    A version lives from its place until the next of its file, so a tree is the versions that live at its place.
    """
    w = Window.partitionBy("repo", "path").orderBy("position")
    lives = versions.select("repo", "path", "position", F.lead("position").over(w).alias("until"))
    r = revisions.select("repo", "revision").distinct()
    alive = lives.join(r, "repo").where((F.col("position") <= F.col("revision")) & (F.col("until").isNull() | (F.col("revision") < F.col("until"))))
    return alive.drop("until").join(versions.select("repo", "path", "position", "content"), ["repo", "path", "position"]).where("content IS NOT NULL").select("repo", "revision", "path", "content")
