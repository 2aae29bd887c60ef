"""The registered queries: each runs an operator over whole tables, beside the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


#: Cases of a few fixed rows: run by the tests, not registered.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_ORACLES: dict[str, str] = {}


def case(sql: str | None = None):
    """Keeps a case under its function's name."""

    def wrap(f):
        CASES[f.__name__] = f
        if sql:
            CASE_ORACLES[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one part of a shuffle takes.
PART_ROWS = 500_000


def parts(df: DataFrame) -> int:
    """How many parts a table's rows are dealt into, so that no task's share grows with the table; its rows are counted
    from the footers of its files."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline table; the same text serves the oracle."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")


def load() -> None:
    """Fill the registry."""
    from changelens.plans import change_queries, draft_queries, evaluation_queries, index_queries, log_queries, retrieval_queries, rule_queries, run_queries, table_queries  # noqa: F401
