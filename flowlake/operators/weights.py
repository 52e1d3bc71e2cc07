"""Class counts, imbalance measures and class weights; all math runs on one row per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.encode import class_weights_join
from flowlake.sources.durable import durable

# Beta of the effective-number weights, and the guard added to counts.
EFFECTIVE_BETA = 0.9999
COUNT_GUARD = 1e-8


def _classes():
    """Window over the class table: one row per class."""
    return Window.partitionBy(F.lit(0))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count, frequency, imbalance ratio and entropy, the last two repeated per class."""
    counts = class_counts(df, label).withColumn("frequency", F.col("n") / F.sum("n").over(_classes()))
    return counts.withColumn("imbalance_ratio", F.max("n").over(_classes()) / F.min("n").over(_classes())).withColumn(
        "entropy", -F.sum(F.col("frequency") * F.ln(F.col("frequency") + F.lit(COUNT_GUARD))).over(_classes())
    )


def _raw_weight(method: str, n: Column) -> Column:
    if method == "balanced":
        return F.sum("n").over(_classes()) / (F.count("*").over(_classes()) * n)
    if method == "inverse":
        return F.lit(1.0) / (n + F.lit(COUNT_GUARD))
    if method == "sqrt_inverse":
        return F.lit(1.0) / F.sqrt(n + F.lit(COUNT_GUARD))
    if method == "log_inverse":
        return F.lit(1.0) / F.ln(n + F.lit(1.0))
    if method == "effective_number":
        return F.lit(1.0 - EFFECTIVE_BETA) / (F.lit(1.0) - F.pow(F.lit(EFFECTIVE_BETA), n))
    raise ValueError(f"unknown weighting {method}")


def class_weights(df: DataFrame, label: str, method: str = "balanced", power: float = 0.5) -> DataFrame:
    """One weight per observed class, raised to ``power`` and scaled to sum to the class count."""
    counts = class_counts(df, label)
    raised = counts.withColumn("_w", F.pow(_raw_weight(method, F.col("n")), F.lit(power)))
    return raised.withColumn(
        "weight", F.col("_w") * F.count("*").over(_classes()) / F.sum("_w").over(_classes())
    ).drop("_w")


def balanced_sample_weights(df: DataFrame, label: str, out: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """Row weight n / (K * n_class), of the whole table or inside each ``by`` group (a client, say).

    One pass counts rows per (group, class) into a small written table, whose size decides the join. Rows without label have no
    weight and are left out; a null group is a group.
    """
    by = list(by)
    counts = durable(df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n")), "class-counts")
    group = Window.partitionBy(*by) if by else _classes()
    weight = F.sum("n").over(group) / (F.count("*").over(group) * F.col("n"))
    weights = counts.select(*by, label, weight.alias("weight"))
    return class_weights_join(df, weights, label, out, by, counts)


def focal_recommendation(df: DataFrame, label: str) -> DataFrame:
    """Focal gamma from the imbalance ratio, alpha from the balanced class weights."""
    ratio = F.max("n").over(_classes()) / F.min("n").over(_classes())
    gamma = F.when(ratio < 2, 1.0).when(ratio < 5, 2.0).when(ratio < 10, 3.0).otherwise(4.0)
    return (
        class_weights(df, label)
        .withColumn("imbalance_ratio", ratio)
        .withColumn("gamma", gamma)
        .withColumnRenamed("weight", "alpha")
    )
