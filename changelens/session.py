"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "changelens", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; ``conf`` adds to or overrides these."""
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    b = SparkSession.builder.appName(app)
    for k, v in own.items():
        b = b.config(k, v)
    return b.getOrCreate()
