"""Combine client results: weighted metrics, matrices, parameters, client selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.splits import cut_segments
from flowlake.sources.durable import durable


def _weighted(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def aggregate_metrics(
    clients: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), weight: str = "n"
) -> DataFrame:
    """Example-weighted mean per metric; 0 when any client lacks the metric."""
    return clients.groupBy(*by).agg(
        *[F.when(F.count(m) == F.count("*"), _weighted(m, weight)).otherwise(F.lit(0.0)).alias(m) for m in metrics],
        F.sum(weight).alias("n"),
    )


def aggregate_confusion(cells: DataFrame, by: Sequence[str] = (), weight: str = "examples") -> DataFrame:
    """Cell counts averaged over clients, weighted by their examples, and the plain sums.

    The weighted form multiplies counts by client size again, as the metric is defined;
    ``n_sum`` is the ordinary combined matrix.
    """
    return cells.groupBy(*by, "true_class", "pred_class").agg(
        _weighted("n", weight).alias("n_weighted"), F.sum("n").alias("n_sum")
    )


def aggregate_per_class(classes: DataFrame, by: Sequence[str] = (), weight: str = "examples") -> DataFrame:
    """Per-class precision, recall and f1 weighted by client examples; supports add up.

    A client without a class contributes nothing to it, but its examples stay in the weight total.
    """
    clients = classes.select(*by, "client", weight).distinct()
    totals = clients.groupBy(*by).agg(F.sum(weight).alias("_total"))
    if by:
        joined = classes.join(totals, list(by))
    else:
        joined = classes.withColumn("_total", F.lit(totals.first()["_total"]))
    share = F.col(weight) / F.col("_total")
    return joined.groupBy(*by, "class").agg(
        *[F.sum(F.col(m) * share).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )


def average_parameters(params: DataFrame, weights: str = "weights", n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Row-weighted mean of parameter vectors: (pos, value) per ``by`` group.

    Partial sums per position combine before the shuffle.
    """
    cells = params.select(*by, F.col(n).alias("_n"), F.posexplode(weights).alias("pos", "_v"))
    return cells.groupBy(*by, "pos").agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("value"))


def select_clients(clients: DataFrame, rounds: Sequence[int], fraction: float, minimum: int = 1) -> DataFrame:
    """Clients drawn per round: ``max(minimum, floor(fraction * available))`` in md5 order.

    With fewer clients than the minimum a round selects nobody. ``clients`` holds a
    ``client`` column. The hash a round ends at is found from counts of leading hash digits, so clients are
    placed by comparing their own hash and a round is never gathered.
    """
    each = F.explode(F.array(*[F.lit(r) for r in rounds])).alias("round")
    pairs = durable(clients.select("client").distinct(), "clients").select("client", each)

    def ends(n: Column) -> Column:
        wanted = F.greatest(F.lit(minimum), F.floor(F.lit(fraction) * n))
        return F.array(F.when(n >= minimum, wanted).otherwise(F.lit(0)).cast("bigint"))

    drawn = cut_segments(pairs, "client", ends, ["round"], "_segment", salt=F.col("round"))
    return drawn.where("_segment = 0").select("round", "client")


def client_of_round(clients: int, round_number: int) -> int:
    """Cyclic training order."""
    return round_number % clients
