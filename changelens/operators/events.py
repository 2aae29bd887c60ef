"""Append-only logs folded to states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.schemas import REASONS


def _when():
    """Order of a log; a missing time counts as the oldest."""
    return F.struct(F.coalesce(F.col("created_at"), F.lit("0001-01-01").cast("timestamp")).alias("t"), F.col("seq"))


def state(decisions: DataFrame) -> DataFrame:
    """``mapping_id, state, last_reason, last_at``: the last decision by time, then arrival."""
    return decisions.groupBy("mapping_id").agg(
        F.max_by("decision", _when()).alias("state"), F.max_by("reason_code", _when()).alias("last_reason"), F.max("created_at").alias("last_at")
    )


def contexts(decisions: DataFrame, legacy_actor: str = "legacy-backfill", legacy_text: str = "legacy verified flag") -> DataFrame:
    """One context per mapping: its state and what its log has seen."""
    verified = F.col("decision") == "verified"
    return decisions.groupBy("mapping_id").agg(
        F.max_by("decision", _when()).alias("state"),
        F.max_by("reason_code", _when()).alias("reason_code"),
        F.count_if(F.col("decision") == "rejected").alias("rejection_count"),
        F.bool_or(verified & (F.coalesce("reason_code", F.lit("")) == "golden_test_confirmed")).alias("golden_confirmed"),
        F.bool_or(verified & (F.coalesce("reason_code", F.lit("")) == "matched_historical_change")).alias("historical_match"),
        F.bool_or(verified & (F.col("actor") == legacy_actor) & (F.coalesce("reason_text", F.lit("")) == legacy_text)).alias("legacy"),
    )


def number_events(events: DataFrame, run: str = "run_id", at: str = "occurred_at", seq: str = "ord") -> DataFrame:
    """Sequence numbers from 1 within each run."""
    return events.withColumn("sequence_no", F.row_number().over(Window.partitionBy(run).orderBy(at, seq)))


def next_numbers(events: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """The number that each run's next event gets."""
    top = events.groupBy(run).agg(F.max("sequence_no").alias("top"))
    return runs.select(run).distinct().join(top, run, "left").select(run, (F.coalesce("top", F.lit(0)) + 1).alias("next_no"))


def valid_reason(decision, reason):
    """Whether a decision may carry a reason; a revocation needs none."""
    ok = F.lit(False)
    for d, reasons in REASONS.items():
        ok = ok | ((decision == d) & (reason.isin(*reasons) | (reason.isNull() & F.lit(d == "revoked"))))
    return F.coalesce(ok, F.lit(False))


def stale_reason(file_there, symbol_there, stored, current):
    """Why a mapping went stale; a changed file with its symbol is modified but valid."""
    return (
        F.when(~file_there, "file_missing")
        .when(~symbol_there, "symbol_missing")
        .when(stored.isNotNull() & current.isNotNull() & (stored != current), "modified_but_valid")
    )


def backfill(mappings: DataFrame, decisions: DataFrame, actor: str = "legacy-backfill", text: str = "legacy verified flag") -> DataFrame:
    """Decisions for verified mappings that have none, appended; running it again adds nothing."""
    lone = mappings.where("verified").join(decisions, "mapping_id", "left_anti")
    new = lone.select(
        "mapping_id", F.lit("verified").alias("decision"), F.lit("other").alias("reason_code"), F.lit(text).alias("reason_text"), F.lit(actor).alias("actor"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(0).cast("long").alias("seq"),
    )
    return decisions.unionByName(new)


def transitions(proposals: DataFrame, actions: DataFrame) -> DataFrame:
    """Drafts move once, to approved or rejected; the first action by time decides, later ones are refused."""
    w = Window.partitionBy("proposal_id").orderBy("acted_at", "seq")
    first = actions.where(F.col("action").isin("approve", "reject")).withColumn("n", F.row_number().over(w))
    done = first.where("n = 1").select("proposal_id", F.when(F.col("action") == "approve", "approved").otherwise("rejected").alias("to"))
    refused = first.where("n > 1").groupBy("proposal_id").agg(F.count("*").alias("refused"))
    out = proposals.join(done, "proposal_id", "left").join(refused, "proposal_id", "left")
    return out.select(
        "proposal_id",
        F.when(F.col("status") == "draft", F.coalesce("to", "status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "draft", F.coalesce("refused", F.lit(0))).otherwise(F.coalesce("refused", F.lit(0)) + F.when(F.col("to").isNotNull(), 1).otherwise(0)).cast("long").alias("refused"),
    )
