"""Queries of the image operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, which both engines then show alike."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name. sql: what DuckDB is to find, too."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return wide(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
