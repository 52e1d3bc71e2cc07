"""Deterministic pseudo-random order and numbers, equal in Spark and in ANSI SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*cols: str | Column) -> Column:
    """md5 of the '|'-joined text of the columns: a stable shuffle order."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    if len(parts) == 1:
        return F.md5(parts[0].cast("string"))
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_int(digest: Column, digits: int) -> Column:
    """The first ``digits`` hex digits as a number; keeps the digest's order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_unit(*cols: str | Column) -> Column:
    """Uniform number in [0, 1) with 32 bits."""
    return hash_int(hash_key(*cols), 8) / F.lit(float(2**32))
