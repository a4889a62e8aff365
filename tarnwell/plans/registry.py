"""Queries by name with the SQL that says the same; doubles are rounded to six places in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Half away from zero on the double itself, as DuckDB's round() does; Spark's goes by its decimal form."""
    near = lambda c: F.signum(c) * F.floor(F.abs(F.col(c)) * 1e6 + 0.5) / 1e6
    return df.select(*[near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add
