"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew joins, Arrow; anything in conf comes on top."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
