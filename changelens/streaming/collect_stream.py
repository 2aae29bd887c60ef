"""Collection as a stream: micro-batches of landed items, a keyed state that forgets, writes by month."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from changelens.operators.collect import only_new
from changelens.sources.store import Folder, key_of

ITEMS = "law_id string, law_name string, promulgation_date string, effective_date string, source string, domain string, ord long"
KEY = ["law_id", "promulgation_date"]
#: How long a key that has been delivered is remembered in the state.
REMEMBERED = 30 * 24 * 3600 * 1000
_COLUMNS = [c.split()[0] for c in ITEMS.split(", ")]


def _first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's first item, once; what is delivered again while it is remembered gives nothing."""
    if state.hasTimedOut:
        state.remove()
        return
    now = 0
    best = None
    for f in frames:
        own = f.sort_values("ord", kind="stable").head(1)
        best = own if best is None or own["ord"].iloc[0] < best["ord"].iloc[0] else best
        now = max(now, int(f["landed"].max().timestamp() * 1000))
    known = state.exists
    state.update((True,))
    state.setTimeoutTimestamp(max(now, state.getCurrentWatermarkMs()) + REMEMBERED)
    if not known and best is not None:
        yield best[_COLUMNS]


def _stored(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """What the table holds of some months; nothing where they haven't been written.  Any other fault is raised."""
    folder = Folder(spark, path)
    there = [f"{path}/month={m}" for m in months if folder.has(f"month={m}")]
    schema = ITEMS + ", month string, batch string"
    return spark.read.schema(schema).option("basePath", path).parquet(*there) if there else spark.createDataFrame([], schema)


def collect(spark: SparkSession, landing: str, table: str, checkpoint: str, once: bool = True, detail: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """New JSON files under ``landing`` become new rows of ``table``, by month of promulgation and batch.

    Deliveries that repeat are absorbed by a state of keys, which forgets a key REMEMBERED milliseconds after its last
    delivery and so stays as large as what is delivered in that time; what comes again even later is found in the months
    that its batch names, the only part of the history that a batch reads.  A batch that runs again overwrites its own
    folders.  Details are taken in the same batch before the checkpoint moves, so that a crash loses neither.
    """

    stream_key = key_of(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        s, own = batch.sparkSession, f"{stream_key}-{number:09d}"
        s.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        dated = batch.withColumns({"month": F.coalesce(F.nullif(F.substring("promulgation_date", 1, 6), F.lit("")), F.lit("none")), "batch": F.lit(own)}).persist()
        try:
            months = sorted(r.month for r in dated.select("month").distinct().collect())  # months, not items
            if not months:
                return
            earlier = _stored(s, table, months).where(F.col("batch") != own)
            new = only_new(dated, earlier, KEY)
            (detail(new) if detail else new).write.mode("overwrite").partitionBy("month", "batch").parquet(table)
        finally:
            dated.unpersist()

    # a batch's own time: no item is ever late, and keys are forgotten as batches go by
    stream = spark.readStream.schema(ITEMS).json(landing).withColumn("landed", F.current_timestamp()).withWatermark("landed", "0 seconds")
    first = stream.groupBy(*KEY).applyInPandasWithState(_first, ITEMS, "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)
    w = first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="24 hours")).start()


def high_water(items: DataFrame, default: str) -> DataFrame:
    """The latest date collected, or the default."""
    return items.agg(F.coalesce(F.max("promulgation_date"), F.lit(default)).alias("last_sync"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling windows; rows later than the mark are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )
