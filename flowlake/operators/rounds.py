"""Federated boosting rounds over one table: clients are a column, never separate jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.boost import BoostData, BoostParams, Trainer, track_scores, validate
from flowlake.operators.convergence import converged
from flowlake.operators.federate import aggregate_metrics, client_of_round, select_clients
from flowlake.operators.model import BoostModel

METRICS = ("precision", "recall", "f1", "accuracy", "mlogloss")
# Fixed value: local rounds a client goes on without a new best validation loss.
LOCAL_PATIENCE = 10


def federated_rounds(
    data: BoostData,
    params: BoostParams,
    clients: int,
    rounds: int,
    mode: str = "bagging",
    local_rounds: int = 1,
    fraction: float = 1.0,
    patience: int | None = None,
    min_delta: float = 0.001,
    local_patience: int | None = LOCAL_PATIENCE,
) -> tuple[BoostModel, DataFrame]:
    """Train, combine, evaluate. Returns the model and a long history table.

    bagging: the drawn clients train from the global model at once and all their trees are
    appended. cyclic: one client per round continues the model. A client ends its local rounds
    early when its own validation loss has not improved for ``local_patience`` of them. Every round the validation
    rows are judged once; the history holds each client's scores, their weighted
    combination ("distributed") and the scores over all rows ("central").
    The loop really stops once the combined loss has converged.
    """
    if mode not in ("bagging", "cyclic"):
        raise ValueError(f"unknown mode {mode}")
    spark = data.rows.sparkSession
    trainer = Trainer(data, {0: params})
    drawn: dict[int, list[int]] = {}
    if mode == "bagging" and fraction >= 1:
        drawn = {number: list(range(clients)) for number in range(1, rounds + 1)}
    elif mode == "bagging":
        ids = spark.range(clients).select(F.col("id").cast("int").alias("client"))
        for row in select_clients(ids, range(1, rounds + 1), fraction).collect():
            drawn.setdefault(row["round"], []).append(row["client"])
    # a round leaves at most clients * classes^2 cells
    cells: list[tuple] = []
    losses: list[tuple] = []
    # patience that a round cannot use up needs no judging
    local = local_patience if local_patience is not None and local_patience < local_rounds else None
    for number in range(1, rounds + 1):
        active = sorted(drawn[number]) if mode == "bagging" else [client_of_round(clients, number - 1)]
        trainer.round(active, local_rounds, patience=local)
        if trainer.failed:
            raise ArithmeticError(f"round {number} left the finite numbers; lower eta")
        found = validate(trainer.data, [0]).collect()
        cells += [(number, *r) for r in found]
        losses.append((number, sum(r["loss"] for r in found) / max(sum(r["n"] for r in found), 1)))
        if patience is not None and number > patience:
            table = spark.createDataFrame(losses, "round int, loss double")
            if converged(table, patience=patience, min_delta=min_delta).where(f"round = {number}").first()["converged"]:
                break
    return trainer.model(), _history(spark.createDataFrame(cells, f"round int, {_CELL_SCHEMA}"))


_CELL_SCHEMA = "track int, client int, true_class int, pred_class int, n bigint, loss double"


def _history(cells: DataFrame) -> DataFrame:
    """Scores per round of each client, of their weighted combination, and of all rows."""
    per_client = track_scores(cells, ["round", "client"])
    combined = aggregate_metrics(per_client, METRICS, ["round"]).withColumn("source", F.lit("distributed"))
    central = track_scores(cells, ["round"]).withColumn("source", F.lit("central"))
    own = per_client.withColumn("source", F.concat(F.lit("client_"), F.col("client")))
    wide = [part.select("source", "round", *METRICS) for part in (combined, central, own)]
    return wide[0].unionByName(wide[1]).unionByName(wide[2]).unpivot(["source", "round"], list(METRICS), "metric", "value")
