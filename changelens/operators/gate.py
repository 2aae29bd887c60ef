"""Rules that decide what may be drafted, and the registry that routes data changes elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
DRAFTABLE = ("value_change", "rate_change", "date_change")
ANALYSIS_ONLY = ("structural_change", "no_code_impact")
MIN_CONFIDENCE, MIN_SCORE, MIN_SOURCES = 0.80, 0.80, 2


def decide(changes: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``change_id, decision, reasons``.

    ``changes``: change_id, change_type, confidence, repository_commit, source_conflict; ``candidates``:
    change_id, rank, path, sources (array), strongest, stale; ``files``: path of what exists.  The top
    candidate is looked at alone; staleness and missing files concern all.
    """
    there = candidates.join(files.select(F.col("path").alias("p"), F.lit(True).alias("there")), F.col("path") == F.col("p"), "left")
    seen = there.groupBy("change_id").agg(
        F.min_by(F.struct("sources", "strongest", "stale"), "rank").alias("top"),
        F.bool_and("stale").alias("all_stale"),
        F.bool_or(F.col("there").isNull()).alias("missing"),
    )
    c = changes.join(seen, "change_id", "left")
    top = F.col("top")
    independent = F.size(F.array_distinct(F.filter(top["sources"], lambda s: s != "code_graph")))
    verified = F.array_contains(top["sources"], "verified_mapping") & ~top["stale"]
    has = top.isNotNull()
    rules = {
        "change_type_not_draftable": ~F.col("change_type").isin(*DRAFTABLE),
        "classification_confidence_low": F.col("confidence") < MIN_CONFIDENCE,
        "retrieval_candidate_missing": ~has,
        "retrieval_score_low": has & (top["strongest"] < MIN_SCORE),
        "retrieval_evidence_insufficient": has & (independent < MIN_SOURCES) & ~verified,
        "stale_only_evidence": has & F.col("all_stale"),
        "candidate_file_missing": has & F.col("missing"),
        "repository_commit_missing": F.coalesce("repository_commit", F.lit("")) == "",
        "source_conflict": F.coalesce("source_conflict", F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    decision = F.when(F.size("r") == 0, "draft_allowed").when(F.col("change_type").isin(*ANALYSIS_ONLY), "analysis_only").otherwise("manual_review_required")
    return c.select("change_id", "change_type", reasons.alias("r")).select("change_id", decision.alias("decision"), F.array_join("r", ",").alias("reasons"))


def route(changes: DataFrame, items: DataFrame) -> DataFrame:
    """The first registry item (by its ord) of a change's law whose pattern its article holds.

    ``items`` is a small dimension; the join is an equi-join on the law, so no size is assumed.
    """
    met = changes.where(F.coalesce("article_no", F.lit("")) != "").join(items.where(F.coalesce("article_pattern", F.lit("")) != ""), "law_id").where(F.contains("article_no", "article_pattern"))
    w = Window.partitionBy("change_id").orderBy("ord")
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").select("change_id", "item_label", "guidance")


def final_decision(decisions: DataFrame, routed: DataFrame) -> DataFrame:
    """A change that the registry routes gets guidance instead of a draft."""
    out = decisions.join(routed, "change_id", "left")
    return out.select("change_id", F.when(F.col("item_label").isNotNull(), "db_update_guidance").otherwise(F.col("decision")).alias("decision"), "reasons", "item_label")
