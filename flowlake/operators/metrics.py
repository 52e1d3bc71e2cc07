"""Multiclass evaluation. The data is aggregated once to (true, predicted) cells; every
measure after that runs on at most K*K rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import scores as S


def confusion(df: DataFrame, true: str, pred: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of every (true, predicted) pair in 0..classes-1, zeros kept, per ``by`` group.

    A null or other value counts as a class without number: such rows keep cells of their own,
    with null for the side that lies outside, so they stay in every denominator and count as wrong.
    """
    sides = [F.when(F.col(c).cast("int").between(0, classes - 1), F.col(c).cast("int")) for c in (true, pred)]
    counts = df.groupBy(*by, sides[0].alias("t"), sides[1].alias("p")).agg(F.count("*").alias("n"))
    inside = F.col("t").isNotNull() & F.col("p").isNotNull()
    # spread the cells of a group over the full grid without a join
    cells = counts.groupBy(*by).agg(
        F.map_from_entries(
            F.collect_list(F.when(inside, F.struct(F.col("t") * classes + F.col("p"), F.col("n"))))
        ).alias("cells"),
        F.collect_list(F.when(~inside, F.struct("t", "p", "n"))).alias("outside"),
    )
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(classes * classes - 1)),
        lambda c: F.struct(
            F.floor(c / classes).cast("int").alias("t"),
            (c % classes).cast("int").alias("p"),
            F.coalesce(F.try_element_at("cells", c), F.lit(0)).cast("bigint").alias("n"),
        ),
    )
    rows = cells.select(*by, F.explode(F.concat(grid, "outside")).alias("cell"))
    return rows.select(
        *by, F.col("cell.t").alias("true_class"), F.col("cell.p").alias("pred_class"), F.col("cell.n").alias("n")
    )


def _zero_safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1 and support of each class (0 where undefined)."""
    sides = F.explode(
        F.array(
            F.struct(
                F.col("true_class").alias("class"),
                F.col("n").alias("support"),
                F.lit(0).cast("bigint").alias("predicted"),
                F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
            ),
            F.struct(
                F.col("pred_class").alias("class"),
                F.lit(0).cast("bigint").alias("support"),
                F.col("n").alias("predicted"),
                F.lit(0).cast("bigint").alias("hit"),
            ),
        )
    ).alias("s")
    sums = (
        cells.select(*by, sides)
        .groupBy(*by, "s.class")
        .agg(
            F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hit").alias("hit")
        )
    )
    hit, support, predicted = F.col("hit"), F.col("support"), F.col("predicted")
    return sums.select(
        *by,
        "class",
        _zero_safe(hit, predicted).alias("precision"),
        _zero_safe(hit, support).alias("recall"),
        _zero_safe(2 * hit, support + predicted).alias("f1"),
        "support",
    )


def summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, error rate and support-weighted precision, recall and f1."""
    classes = per_class(cells, by)
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _zero_safe(F.sum(F.col(c) * F.col("support")), total).alias(c)

    # weighted recall is the accuracy
    return (
        classes.groupBy(*by)
        .agg(weighted("precision"), weighted("recall"), weighted("f1"), total.alias("n"))
        .withColumn("accuracy", F.col("recall"))
        .withColumn("error_rate", 1.0 - F.col("recall"))
    )


def report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Classification report: one row per class plus macro and weighted averages.

    Classes that neither occur nor are predicted are left out; rows outside the grid are the row ``other``.
    """
    number = F.coalesce(F.col("class"), F.lit(-1)).alias("class")
    used = cells.where("n > 0").select(*by, F.explode(F.array("true_class", "pred_class")).alias("class"))
    measured = per_class(cells, by).select(*by, number, "precision", "recall", "f1", "support")
    classes = measured.join(used.select(*by, number).distinct(), [*by, "class"], "left_semi")
    name = F.when(F.col("class") < 0, F.lit("other")).otherwise(F.col("class").cast("string"))
    rows = classes.select(*by, name.alias("row"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    macro = classes.groupBy(*by).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        total.alias("support"),
    )
    weighted = classes.groupBy(*by).agg(
        *[_zero_safe(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    return rows.unionByName(macro.withColumn("row", F.lit("macro avg"))).unionByName(
        weighted.withColumn("row", F.lit("weighted avg"))
    )


def log_loss(df: DataFrame, probs: str, label: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean clipped log loss; null when any row's array has the wrong length."""
    loss = S.row_log_loss(probs, label, classes)
    return df.groupBy(*by).agg(
        F.when(F.count(loss) == F.count("*"), F.avg(loss)).alias("log_loss"), F.count("*").alias("n")
    )


def hard_log_loss(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(F.avg(S.row_hard_log_loss(pred, label)).alias("log_loss"))


def focal_loss(df: DataFrame, logits: str, label: str, gamma: float, alpha: str | None = None) -> DataFrame:
    """Mean and sum of the focal loss; ``alpha`` names a row weight column."""
    loss = S.focal(logits, label, gamma, F.col(alpha) if alpha else None)
    return df.agg(F.avg(loss).alias("mean_loss"), F.sum(loss).alias("sum_loss"))


def smoothing_loss(df: DataFrame, logits: str, label: str, classes: int, epsilon: float = 0.1) -> DataFrame:
    """Label-smoothing cross entropy; the mean is over rows times classes."""
    loss = S.smoothed_cross_entropy(logits, label, classes, epsilon)
    return df.agg((F.sum(loss) / (F.count("*") * classes)).alias("mean_loss"), F.sum(loss).alias("sum_loss"))


def class_totals(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Rows per class, as truth and as prediction."""
    return (
        df.select(F.explode(F.array(
            F.struct(F.col(true).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
            F.struct(F.col(pred).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
        )).alias("s"))
        .groupBy("s.class")
        .agg(F.sum("s.t").alias("n_true"), F.sum("s.p").alias("n_pred"))
    )


def true_class_histogram(df: DataFrame, probs: str, label: str, bins: int = 50) -> DataFrame:
    """Histogram of p[true] on [0, 1] per true class, right edge in the last bin."""
    p = S.at_class(probs, label)
    return (
        df.select(F.col(label).alias("class"), F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("class", "bin")
        .agg(F.count("*").alias("n"))
    )


def true_class_mean(df: DataFrame, probs: str, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(
        F.avg(S.at_class(probs, label)).alias("mean_p"), F.count("*").alias("n")
    )


def prediction_summary(df: DataFrame, pred: str, score: str) -> DataFrame:
    """Rows and score range per predicted class."""
    return df.groupBy(pred).agg(
        F.count("*").alias("n"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )


def learning_curves(history: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long (source, metric, round, value) series from a wide history table, in round order."""
    return history.unpivot(["source", "round"], list(metrics), "metric", "value").orderBy("source", "metric", "round")


