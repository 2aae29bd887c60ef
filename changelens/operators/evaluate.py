"""Metrics of classification, retrieval and patches, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(rows: DataFrame) -> DataFrame:
    """``class, tp, fp, fn, precision, recall, f1`` over labels and predictions; 0 where undefined."""
    right = F.col("prediction") == F.col("label")
    counts = rows.groupBy("label", "prediction").count()
    stacked = counts.select(
        F.explode(
            F.when(right, F.array(F.struct(F.col("label").alias("class"), F.col("count").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(
                F.array(
                    F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("count").alias("fp"), F.lit(0).cast("long").alias("fn")),
                    F.struct(F.col("label").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("count").alias("fn")),
                )
            )
        ).alias("x")
    )
    s = stacked.groupBy("x.class").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")])
    s = s.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(rows: DataFrame) -> DataFrame:
    """The mean F1 of the classes that occur as labels."""
    own = per_class(rows).where(F.col("tp") + F.col("fn") > 0)
    return own.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def confidence_rates(rows: DataFrame, low: float = 0.50, high: float = 0.80) -> DataFrame:
    wrong = (F.col("confidence") >= high) & (F.col("prediction") != F.col("label"))
    share = lambda b: F.coalesce(F.avg(b.cast("double")), F.lit(0.0))
    return rows.agg(
        share(F.col("prediction") == F.col("label")).alias("accuracy"), share(F.col("confidence") < low).alias("low_confidence_rate"), share(wrong).alias("high_confidence_wrong_rate")
    )


def by_case(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt out by case, so that what is grouped by case and more after it needs no shuffle; ``parts``: how many
    parts, where the session's number is too few for the table."""
    return rows.repartition(parts, "case_id") if parts else rows.repartition("case_id")


def retrieval(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), parts: int | None = None) -> DataFrame:
    """Per case: hit, recall and precision at each k, and the reciprocal rank.

    ``ranked``: case_id, path, rank; ``relevant``: case_id, path, a row for each listed file.  Found files
    count once, the recall's denominator counts the list; precision divides by what was returned.  A case
    without relevant files has hit 1 and recall 1.  Ranks are not null.
    """
    rows = ranked.select("case_id", "path", F.col("rank").cast("long").alias("rank")).unionByName(relevant.select("case_id", "path", F.lit(None).cast("long").alias("rank")))
    given = lambda k: F.col("rank") <= k
    # dealt out by case once: a path's rows meet there, then a case's paths
    per = by_case(rows, parts).groupBy("case_id", "path").agg(F.count_if(F.col("rank").isNull()).alias("listed"), F.min("rank").alias("first"), *[F.count_if(given(k)).alias(f"given{k}") for k in ks])
    named = F.col("case_id").isNotNull() & F.col("path").isNotNull()  # a null is equal to none
    good = named & (F.col("listed") > 0)
    aggs = [F.sum(F.when(named, F.col("listed")).otherwise(0)).alias("n_relevant"), F.min(F.when(good, F.col("first"))).alias("first")]
    for k in ks:
        n = F.when(F.col("case_id").isNotNull(), F.col(f"given{k}")).otherwise(0)
        aggs += [F.count_if(good & (n > 0)).alias(f"found{k}"), F.sum(F.when(good, n).otherwise(0)).alias(f"hits{k}"), F.sum(n).alias(f"given{k}")]
    every = per.groupBy("case_id").agg(*aggs)
    none = F.coalesce("n_relevant", F.lit(0)) == 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cols = [F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("reciprocal_rank")]
    for k in ks:
        cols += [
            F.when(none | (zero(f"hits{k}") > 0), 1).otherwise(0).alias(f"hit_{k}"),
            F.when(none, 1.0).otherwise(zero(f"found{k}") / F.col("n_relevant")).alias(f"recall_{k}"),
            _ratio(zero(f"hits{k}"), zero(f"given{k}")).alias(f"precision_{k}"),
        ]
    return every.select("case_id", *cols)


def summary(per_case: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Means of the metric columns."""
    keys = by or []
    cols = [c for c in per_case.columns if c not in ("case_id", *keys)]
    return per_case.groupBy(*keys).agg(F.count("*").alias("cases"), *[F.round(F.avg(c), digits).alias(c) for c in cols])


def run_summary(cases: DataFrame, metrics: list[str], by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Cases, mean and longest time, failures (rows with an error code) and the metrics' means, by the columns ``by``."""
    return cases.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), F.round(F.avg("latency"), digits).alias("avg_latency"), F.max("latency").alias("max_latency"), F.count("error_code").alias("failures"),
        *[F.round(F.avg(m), digits).alias(m) for m in metrics],
    )


def error_counts(cases: DataFrame) -> DataFrame:
    """``error_code, n``."""
    return cases.where(F.col("error_code").isNotNull()).groupBy("error_code").agg(F.count("*").alias("n"))


def forbidden(patched: DataFrame, forbidden_files: DataFrame) -> DataFrame:
    """``case_id, path``: files that a patch touched though it must not."""
    return patched.join(forbidden_files.select("case_id", "path").distinct(), ["case_id", "path"], "left_semi").distinct()


def patch(expected: DataFrame, generated: DataFrame, relevant: DataFrame, patched: DataFrame, parts: int | None = None) -> DataFrame:
    """Per case: replacement rate, file coverage, rate of needless files, and the files' Jaccard.

    ``expected``/``generated``: case_id, key; ``relevant``/``patched``: case_id, path.  Nothing wanted is
    full marks; nothing patched has no needless file; both empty agree fully.
    """
    of = lambda d, kind, c, want: d.select("case_id", F.lit(kind).alias("kind"), F.col(c).alias("item"), F.lit(want).alias("want"), F.lit(1 - want).alias("have"))
    rows = of(expected, "key", "key", 1).unionByName(of(generated, "key", "key", 0)).unionByName(of(relevant, "file", "path", 1)).unionByName(of(patched, "file", "path", 0))
    # dealt out by case once: an item's rows meet there, then a case's items
    items = by_case(rows, parts).groupBy("case_id", "kind", "item").agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    key, file, both = F.col("kind") == "key", F.col("kind") == "file", (F.col("want") > 0) & (F.col("have") > 0)
    met = both & F.col("item").isNotNull()  # a null is equal to none
    rate = lambda of, hit, n: F.try_divide(F.sum(F.when(of & hit, F.col(n)).otherwise(0)), F.sum(F.when(of, F.col(n)).otherwise(0)))
    apart = F.when(both & ~met, 2).otherwise(1)
    share = F.try_divide(F.sum(F.when(file & met, 1).otherwise(0)), F.sum(F.when(file, apart).otherwise(0)))
    of_case = lambda v, none, name: F.coalesce(F.when(F.col("case_id").isNotNull(), v), F.lit(none)).alias(name)
    return items.groupBy("case_id").agg(
        rate(key, met, "want").alias("r"), rate(file, met, "want").alias("c"), rate(file, ~met, "have").alias("u"), share.alias("j")
    ).select("case_id", of_case(F.col("r"), 1.0, "replacement_rate"), of_case(F.col("c"), 1.0, "file_coverage"), of_case(F.col("u"), 0.0, "unnecessary_rate"), of_case(F.col("j"), 1.0, "jaccard"))


def verdict(metrics: DataFrame) -> DataFrame:
    """A case passes if it ran, its fixture holds, all is replaced and covered, and nothing it ran failed."""
    ok = (
        F.col("failure_kind").isNull()
        & F.col("fixture_ok")
        & (F.col("replacement_rate") >= 1.0)
        & (F.col("file_coverage") >= 1.0)
        & F.coalesce("git_apply", F.lit(True))
        & F.coalesce(F.col("golden_status").isin("passed", "skipped"), F.lit(True))
    )
    return metrics.withColumn("passed", ok)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
