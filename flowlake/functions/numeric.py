"""Numeric column expressions: missing values, ratios, scaling, transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become null; they must not reach comparisons or aggregates."""
    d = _c(c)
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / (b + 1), null where b is -1."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double") + F.lit(1.0))


def binarize(c: str | Column) -> Column:
    """1 where positive, else 0 (null counts as 0)."""
    return F.coalesce((_c(c) > 0).cast("int"), F.lit(0))


def to_int(c: str | Column) -> Column:
    """Numeric text to int; anything else, hex included, becomes 0."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(0.0)).cast("int")


def blank_to_int(c: str | Column) -> Column:
    """A lone blank reads as 0, other text as an integer."""
    return F.when(_c(c) == " ", F.lit("0")).otherwise(_c(c)).try_cast("int")


def clip(c: str | Column, lo, hi) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def standard_scale(c: str | Column, mean: Column, std: Column) -> Column:
    """(x - mean) / population std; a constant column divides by 1."""
    return (_c(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def skew_transform(c: str | Column, skew: Column, top: Column) -> Column:
    """Logarithm towards symmetry: right skew ln(x+e), left skew ln(max(x+e)-x+e), e = 1e-5.

    Logarithms of non-positive numbers are null.
    """
    x = _c(c).cast("double")
    e = F.lit(1e-5)
    return (
        F.when(skew > 0, F.ln(x + e)).when(skew < 0, F.ln((top + e) - x + e)).otherwise(x)
    )


def bin_index(c: str | Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin, right edge inside the last bin; one bin when lo = hi."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.when(width > 0, F.floor((_c(c) - lo) / width)).otherwise(F.lit(0))
    return F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")
