"""Rows met with the first of a few brackets that reaches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Brackets at most; more are no table of rates.
MOST = 1000


def first_bracket(rows: DataFrame, base: Column, brackets: DataFrame, *more: str) -> DataFrame:
    """``rows`` and the columns ``more`` of the bracket with the least ``upper`` that is not below ``base``.

    A null ``upper`` has no bound.  Brackets become one sorted array of one row, so rows are neither shuffled nor
    multiplied; more than MOST are an error.  Rows that no bracket reaches get nulls.
    """
    if brackets.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} brackets")
    one = F.struct(F.col("upper").isNull().alias("open"), "upper", *more)
    held = brackets.agg(F.array_sort(F.collect_list(one)).alias("brackets"))
    met = rows.join(F.broadcast(held))  # one row
    hit = F.try_element_at(F.filter("brackets", lambda b: b["open"] | (base <= b["upper"])), F.lit(1))
    return met.withColumn("hit", hit).select(*rows.columns, *[F.col(f"hit.{c}").alias(c) for c in more])
