"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomrecall", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
