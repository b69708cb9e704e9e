"""All queries, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None, also: str | None = None):
    """Registers a function of Tables under its name (and another one), with the SQL it must agree with."""

    def register(f):
        for key in filter(None, (name or f.__name__, also)):
            QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                ORACLE_SQL[key] = sql
        return f

    return register


from strandloom.plans import aggregates, annotation, files, graphs, loads, lookups, records, regions, scalars, search, sequences, shapes, texts, validation  # noqa: E402, F401
