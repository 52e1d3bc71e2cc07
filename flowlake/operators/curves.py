"""One-vs-rest ROC and precision-recall curves.

Scores are first counted per (class, score); the cumulative counts come from a range
layout, so neither a class nor the table is sorted in one task. Areas are sums over rows
that carry the counts before and after them, which needs no neighbour row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.ordering import running_sum


def threshold_counts(
    df: DataFrame, probs: str, label: str, classes: int, digits: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Per class (and ``by`` group) and distinct score, best first: rows, positives and their running totals.

    ``digits`` rounds scores first, which bounds the number of thresholds.
    """
    score: Column = F.col("e.score")
    if digits is not None:
        score = F.round(score, digits)
    cells = (
        df.select(
            *by,
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.lit(classes - 1)),
                    lambda k: F.struct(
                        k.alias("class"),
                        F.get(F.col(probs), k).alias("score"),
                        (k == F.col(label)).cast("bigint").alias("hit"),
                    ),
                )
            ).alias("e"),
        )
        .groupBy(*by, F.col("e.class").alias("class"), score.alias("score"))
        .agg(F.sum("e.hit").alias("pos"), F.count("*").alias("rows"))
    )
    return running_sum(cells, {"cum_pos": "pos", "cum_rows": "rows"}, [F.desc("score")], [*by, "class"])


def _with_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    totals = counts.groupBy(*by, "class").agg(F.sum("pos").alias("all_pos"), F.sum("rows").alias("all_rows"))
    # one row per class and group
    return counts.join(F.broadcast(totals), [*by, "class"])


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def roc_points(counts: DataFrame) -> DataFrame:
    c = _with_totals(counts)
    return c.select(
        "class",
        "score",
        _share(F.col("cum_rows") - F.col("cum_pos"), F.col("all_rows") - F.col("all_pos")).alias("fpr"),
        _share(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )


def roc_auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under each class's ROC curve."""
    c = _with_totals(counts, by)
    neg = F.col("rows") - F.col("pos")
    mid = F.col("cum_pos") - F.col("pos") / 2.0
    return c.groupBy(*by, "class").agg(
        _share(F.sum(neg * mid), F.first("all_pos") * (F.first("all_rows") - F.first("all_pos"))).alias("auc")
    )


def pr_points(counts: DataFrame) -> DataFrame:
    c = _with_totals(counts)
    return c.select(
        "class",
        "score",
        (F.col("cum_pos") / F.col("cum_rows")).alias("precision"),
        _share(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )


def pr_area(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under each class's precision-recall curve, starting at (0, 1)."""
    c = _with_totals(counts, by)
    before_rows, before_pos = F.col("cum_rows") - F.col("rows"), F.col("cum_pos") - F.col("pos")
    earlier = F.when(before_rows > 0, before_pos / before_rows).otherwise(F.lit(1.0))
    height = (F.col("cum_pos") / F.col("cum_rows") + earlier) / 2.0
    return c.groupBy(*by, "class").agg(
        F.sum(_share(F.col("pos"), F.col("all_pos")) * height).alias("pr_area")
    )
