"""Stopping rules over metric histories (one row per round)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def converged(
    history: DataFrame, by: Sequence[str] = (), loss: str = "loss", patience: int = 3, min_delta: float = 0.001
) -> DataFrame:
    """Per round: have the last ``patience`` consecutive improvements all been below ``min_delta``?

    False until ``patience + 1`` rounds exist; a missing loss counts as infinite.
    """
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("round")
    value = F.coalesce(F.col(loss), F.lit(float("inf")))
    gain = F.lag(value).over(w) - value
    # inf - inf is NaN, which is not below the threshold
    big = F.when(gain.isNull(), F.lit(0)).otherwise((F.isnan(gain) | (gain >= min_delta)).cast("int"))
    recent = w.rowsBetween(-(patience - 1), 0)
    return (
        history.withColumn("_big", big)
        .withColumn("_round_no", F.row_number().over(w))
        .withColumn("converged", (F.col("_round_no") > patience) & (F.sum("_big").over(recent) == 0))
        .drop("_big", "_round_no")
    )


def early_stop(history: DataFrame, by: Sequence[str] = (), loss: str = "loss", patience: int = 10) -> DataFrame:
    """Rounds since the loss last fell strictly below its best, and whether that reaches ``patience``."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("round")
    best_before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    improved = best_before.isNull() | (F.col(loss) < best_before)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        history.withColumn("_no", F.row_number().over(w))
        .withColumn("_improved", improved)
        .withColumn("stale_rounds", F.col("_no") - F.max(F.when(F.col("_improved"), F.col("_no"))).over(upto))
        .withColumn("best_loss", F.min(loss).over(upto))
        .withColumn("stop", F.col("stale_rounds") >= patience)
        .drop("_no", "_improved")
    )


class Patience:
    """The ``early_stop`` rule for running loops of many learners: who has gone ``rounds`` rounds without a new best loss."""

    def __init__(self, rounds: int):
        self.rounds = rounds
        self.best: dict = {}

    def spent(self, key, loss: float, number: int) -> bool:
        """Take the learner's loss of round ``number``; is its patience at an end?"""
        least, at = self.best.get(key, (float("inf"), number))
        if loss < least:
            self.best[key] = loss, number
            return False
        self.best[key] = least, at
        return number - at >= self.rounds
