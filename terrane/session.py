"""Spark session with the settings that the plans of this package expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "terrane", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds settings (a__b for a.b)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
