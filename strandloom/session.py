"""A session with the settings that the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandloom", master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything else by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
