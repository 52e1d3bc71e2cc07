"""Query registry and the shared input expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with its SQL twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: str | Column) -> Column:
    """Six decimals, so that summation order does not show in comparisons."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r9(c: str | Column) -> Column:
    """Nine decimals for measures near 1: short fractions do not end on a rounding edge there."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9)
