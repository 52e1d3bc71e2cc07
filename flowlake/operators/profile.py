"""Profiling aggregates: one pass for all columns wherever the measure allows it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.numeric import bin_index, finite
from flowlake.operators.quantiles import quantile_columns
from flowlake.sources.durable import durable, gathered


def _long(df: DataFrame, columns: Sequence[str], fields) -> DataFrame:
    """Aggregate once, then one row per column. ``fields(c)`` lists (name, aggregate)."""
    cells = [F.struct(F.lit(c).alias("column"), *[e.alias(n) for n, e in fields(c)]) for c in columns]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def distribution_by(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Rows and share of each label inside each group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, sample std, median and 99th percentile per column."""
    q = quantile_columns(df, columns, [0.5, 0.99])
    return _long(
        df,
        columns,
        lambda c: [
            ("mean", F.avg(finite(c))),
            ("std", F.stddev_samp(finite(c))),
            ("median", q[c][0].cast("double")),
            ("q99", q[c][1].cast("double")),
        ],
    )


def range_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    q = quantile_columns(df, columns, [0.5])
    return _long(
        df,
        columns,
        lambda c: [
            ("min", F.min(finite(c)).cast("double")),
            ("max", F.max(finite(c)).cast("double")),
            ("median", q[c][0].cast("double")),
        ],
    )


def five_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std and the five-number summary (also the box-plot data)."""
    q = quantile_columns(df, columns, [0.25, 0.5, 0.75])
    return _long(
        df,
        columns,
        lambda c: [
            ("n", F.count(finite(c))),
            ("mean", F.avg(finite(c))),
            ("std", F.stddev_samp(finite(c))),
            ("min", F.min(finite(c)).cast("double")),
            ("q25", q[c][0].cast("double")),
            ("q50", q[c][1].cast("double")),
            ("q75", q[c][2].cast("double")),
            ("max", F.max(finite(c)).cast("double")),
        ],
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Outlier fences q25 - w*IQR and q75 + w*IQR, and the median."""
    q = quantile_columns(df, columns, [0.25, 0.5, 0.75])
    return _long(
        df,
        columns,
        lambda c: [
            ("lower", q[c][0] - F.lit(whisker) * (q[c][2] - q[c][0])),
            ("upper", q[c][2] + F.lit(whisker) * (q[c][2] - q[c][0])),
            ("median", q[c][1].cast("double")),
        ],
    )


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percentage (two decimals) of null or NaN cells."""
    kinds = dict(df.dtypes)

    def gone(c: str) -> Column:
        empty = F.col(c).isNull()
        return empty | F.isnan(c) if kinds[c] in ("double", "float") else empty

    return _long(
        df,
        columns,
        lambda c: [
            ("n_missing", F.count_if(gone(c))),
            ("pct_missing", F.round(F.count_if(gone(c)) * 100.0 / F.count("*"), 2)),
        ],
    )


def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every distinct non-null value of each column with its count, combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p.column", "p.value")
        .agg(F.count("*").alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; sketches instead of exact counts on request."""
    if approximate:
        return _long(df, columns, lambda c: [("n_distinct", F.approx_count_distinct(c))])
    return column_values(df, columns).groupBy("column").agg(F.count("*").alias("n_distinct"))


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, top value (smallest among ties) and its frequency."""
    ranked = column_values(df, columns).groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_unique"),
        F.max("n").alias("freq"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
    )
    return ranked.select("column", "n", "n_unique", "top", "freq")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct full row."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates")
    )


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population skewness m3 / m2^1.5."""
    return _long(df, columns, lambda c: [("skewness", F.skewness(finite(c)))])


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair a < b (by position) over the rows that have both; null where a side does not vary.

    Tasks multiply their rows as matrices, presence masks among them, and send one row of sums per pair; columns are
    shifted by their means first, so that sums stay small. However many columns, there are two passes.
    """
    width = len(columns)
    x = [finite(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    means = df.select(*x).agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(width)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    upper = np.triu_indices(width, 1)

    def kernel(batches):
        total = np.zeros((6, width, width))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - shift
            seen = ~np.isnan(values)
            values, mask = np.where(seen, values, 0.0), seen.astype(float)
            squares = values * values
            total += np.stack([mask.T @ mask, values.T @ mask, mask.T @ values, squares.T @ mask, mask.T @ squares, values.T @ values])
        cells = [pa.array(i.astype(np.int32)) for i in upper] + [pa.array(np.ascontiguousarray(t[upper])) for t in total]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "n", "sa", "sb", "qa", "qb", "ab"])

    parts = gathered(df.select(*x)).mapInArrow(kernel, "i int, j int, n double, sa double, sb double, qa double, qb double, ab double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")])
    n = F.col("n")
    spread = [F.greatest(n * F.col(q) - F.col(s) * F.col(s), F.lit(0.0)) for q, s in (("qa", "sa"), ("qb", "sb"))]
    r = F.try_divide(n * F.col("ab") - F.col("sa") * F.col("sb"), F.sqrt(spread[0]) * F.sqrt(spread[1]))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))


def correlated_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.75) -> DataFrame:
    """Pairs with signed r at or above the threshold."""
    return correlation_pairs(df, columns).where(F.col("r") >= threshold)


def redundant_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.75) -> list[str]:
    """Second member of each correlated pair, unless a member is already dropped.

    The pair table has at most len(columns)^2 rows, so the walk runs on the driver.
    """
    place = {c: i for i, c in enumerate(columns)}
    pairs = [(r["a"], r["b"]) for r in correlated_pairs(df, columns, threshold).collect()]
    dropped: list[str] = []
    for a, b in sorted(pairs, key=lambda p: (place[p[0]], place[p[1]])):
        if a not in dropped and b not in dropped:
            dropped.append(b)
    return dropped


def column_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.min(finite(c)).cast("double").alias(f"lo_{c}") for c in columns],
        *[F.max(finite(c)).cast("double").alias(f"hi_{c}") for c in columns],
    ).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def _binned(df: DataFrame, columns: Sequence[str], bins: int, keep: Sequence[str] = ()) -> DataFrame:
    """Long (column, bin, lo, hi) view over equal-width bins of each column's range."""
    ranges = column_ranges(df, columns)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                bin_index(finite(c).cast("double"), F.lit(lo), F.lit(hi), bins).alias("bin"),
                F.lit(lo).alias("lo"),
                F.lit(hi).alias("hi"),
                finite(c).isNotNull().alias("known"),
            )
            for c, (lo, hi) in ranges.items()
            if lo is not None
        ]
    )
    return df.select(F.explode(cells).alias("e"), *keep).where("e.known").select("e.*", *keep).drop("known")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Non-empty equal-width bins per column with their edges."""
    counted = _binned(df, columns, bins).groupBy("column", "bin", "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return counted.select(
        "column",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
    )


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of each column with the label.

    All sums run over the (column, bin, label) counts, whose number is bounded by the
    argument sizes and the classes.
    """
    joint = _binned(df, columns, bins, [label]).groupBy("column", "bin", label).agg(F.count("*").alias("n"))
    joint = durable(joint, "joint")
    per_column = F.sum("n").over(Window.partitionBy("column"))
    per_bin = F.sum("n").over(Window.partitionBy("column", "bin"))
    per_label = F.sum("n").over(Window.partitionBy("column", label))
    term = F.col("n") / per_column * F.ln(F.col("n") * per_column / (per_bin * per_label))
    return joint.withColumn("_t", term).groupBy("column").agg(F.sum("_t").alias("mi"))


def split_statistics(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows per (split, label) with per-split and grand totals (null marks a total)."""
    return df.rollup(split, label).agg(F.count("*").alias("n"))


def explained_variance(df: DataFrame, features: str, k: int) -> DataFrame:
    """PCA share of variance per component and its running total.

    The covariance is a distributed sum; only the k ratios come back to the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    ratios = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors).explainedVariance.toArray().tolist()
    total = reduce(lambda acc, r: acc + [(acc[-1] if acc else 0.0) + r], ratios, [])
    rows = [(i + 1, float(r), float(t)) for i, (r, t) in enumerate(zip(ratios, total))]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")
