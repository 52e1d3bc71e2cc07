"""Turn model output into labelled predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions import scores as S
from flowlake.functions.numeric import finite
from flowlake.operators import curves, metrics
from flowlake.operators.clean import null_extremes
from flowlake.operators.encode import CLASS_NAMES, class_name
from flowlake.operators.model import BoostModel, Tree, leaf_sums, list_array, matrix_of, predict, softmax_rows
from flowlake.sources.durable import durable


def decide(df: DataFrame, raw: str, names: Mapping[int, str] = CLASS_NAMES) -> DataFrame:
    """Predicted label and its name, by the shape of the model output.

    An array column is a class distribution (its width comes with the data); numbers all in
    [0, 1] are binary scores; any other numbers are class ids, rounded.
    """
    if isinstance(df.schema[raw].dataType, T.ArrayType):
        label = S.argmax(raw)
        return (
            df.withColumn("predicted_label", label)
            .withColumn("prediction_type", class_name("predicted_label", names))
            .withColumn("prediction_score", S.confidence(raw))
        )
    span = df.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")).first()
    if span["lo"] is not None and span["lo"] >= 0.0 and span["hi"] <= 1.0:
        return (
            df.withColumn("predicted_label", S.binary_decision(raw))
            .withColumn("prediction_type", S.binary_name(raw))
            .withColumn("prediction_score", F.col(raw))
        )
    # halves go to the even class, as numeric rounding does
    return df.withColumn("predicted_label", F.bround(raw, 0).cast("int")).withColumn(
        "prediction_type", class_name("predicted_label", names)
    )


def score_table(
    df: DataFrame,
    model: BoostModel,
    label: str | None = None,
    keep: Sequence[str] = (),
    names: Mapping[int, str] = CLASS_NAMES,
) -> DataFrame:
    """Predictions of a saved model: label, name, confidence, probabilities and, if known, the truth.

    Unlabelled tables are cleaned first (infinite and extreme values become missing).
    """
    rows = df if label else null_extremes(df, model.features)
    scored = decide(predict(rows, model, "probs"), "probs", names)
    columns = [*keep, "predicted_label", "prediction_type", "prediction_score", "probs"]
    if label:
        scored = scored.withColumn("true_label", F.col(label).cast("int"))
        columns.append("true_label")
    return scored.select(*columns)


def evaluate_scored(scored: DataFrame, classes: int) -> dict[str, DataFrame]:
    """All evaluation tables of one scored, labelled table, which is written once and read by each."""
    rows = durable(scored, "scored")
    cells = metrics.confusion(rows, "true_label", "predicted_label", classes)
    counts = curves.threshold_counts(rows, "probs", "true_label", classes, digits=6)
    return {
        "confusion": cells,
        "summary": metrics.summary(cells),
        "per_class": metrics.per_class(cells),
        "report": metrics.report(cells),
        "log_loss": metrics.log_loss(rows, "probs", "true_label", classes),
        "roc_auc": curves.roc_auc(counts),
        "pr_area": curves.pr_area(counts),
        "class_totals": metrics.class_totals(rows, "true_label", "predicted_label"),
        "true_class_histogram": metrics.true_class_histogram(rows, "probs", "true_label"),
    }


def _turns(model: BoostModel, every: int) -> list[tuple[list[Tree], int | None]]:
    """Trees of each turn, with the number of the round that is looked at after it, if one is; turn 0 is round 1."""
    by_turn: dict[int, list[Tree]] = {}
    for tree in model.trees:
        by_turn.setdefault(tree.turn, []).append(tree)
    return [(by_turn[t], t + 1 if t % every == 0 else None) for t in sorted(by_turn)]


def _features(df: DataFrame, model: BoostModel) -> Column:
    return F.array(*[finite(c).cast("double") for c in model.features])


def score_rounds(
    df: DataFrame, model: BoostModel, label: str | None = None, keep: Sequence[str] = (), every: int = 1, names: Mapping[int, str] = CLASS_NAMES
) -> DataFrame:
    """Predictions after each turn of the model, as ``score_table`` with a ``round``: every tree is walked once a row."""
    turns, classes, width = _turns(model, every), model.classes, len(model.features)

    @F.arrow_udf("array<struct<round:int,probs:array<double>>>")
    def score(x: pa.Array) -> pa.Array:
        values = matrix_of(x, width)
        margins, numbers, probs = np.zeros((len(values), classes)), [], []
        for trees, number in turns:
            margins += leaf_sums(trees, classes, values, raw=True)
            if number is not None:
                numbers.append(number)
                probs.append(softmax_rows(margins))
        stacked = np.stack(probs, axis=1).reshape(-1, classes)
        each = pa.StructArray.from_arrays([pa.array(np.tile(np.array(numbers, np.int32), len(values))), list_array(stacked)], ["round", "probs"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(numbers)), each)

    rows = df if label else null_extremes(df, model.features)
    scored = rows.withColumn("_round", F.explode(score(_features(rows, model))))
    scored = decide(scored.withColumn("probs", F.col("_round.probs")).withColumn("round", F.col("_round.round")), "probs", names)
    columns = ["round", *keep, "predicted_label", "prediction_type", "prediction_score", "probs"]
    if label:
        scored = scored.withColumn("true_label", F.col(label).cast("int"))
        columns.append("true_label")
    return scored.select(*columns)


def round_cells(df: DataFrame, model: BoostModel, label: str, every: int = 1) -> DataFrame:
    """Cells (round, true_class, pred_class, n, loss) after each turn of the model, from one pass over the rows.

    Margins are carried from turn to turn inside the task; ``loss`` is the summed clipped log loss, and a label
    outside the classes has neither class nor loss.
    """
    turns, classes, width = _turns(model, every), model.classes, len(model.features)

    def kernel(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix_of(batch.column(0), width)
            true = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            true = np.where((true >= 0) & (true < classes), true, classes)
            margins = np.zeros((len(values), classes))
            for trees, number in turns:
                margins += leaf_sums(trees, classes, values, raw=True)
                if number is None:
                    continue
                p = np.clip(softmax_rows(margins), S.CLIP, 1 - S.CLIP)
                loss = -np.log(p[np.arange(len(true)), np.minimum(true, classes - 1)])
                cell = true * classes + margins.argmax(axis=1)
                size = (classes + 1) * classes
                total[number] = total.get(number, 0.0) + np.array([np.bincount(cell, w, minlength=size) for w in (None, loss)])
        for number, (n, loss) in total.items():
            at = np.flatnonzero(n)
            outside = at // classes == classes
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), number, np.int32)),
                    pa.array((at // classes).astype(np.int32), mask=outside),
                    pa.array((at % classes).astype(np.int32)),
                    pa.array(n[at].astype(np.int64)),
                    pa.array(loss[at], mask=outside),
                ],
                names=["round", "true_class", "pred_class", "n", "loss"],
            )

    rows = df.select(_features(df, model).alias("x"), F.col(label).cast("int").alias("label"))
    parts = rows.mapInArrow(kernel, "round int, true_class int, pred_class int, n bigint, loss double")
    return parts.groupBy("round", "true_class", "pred_class").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def evaluate_rounds(df: DataFrame, model: BoostModel, label: str, every: int = 1, curves_too: bool = False) -> dict[str, DataFrame]:
    """Central evaluation after each turn of the model, every table with a ``round``; the untrained model is skipped.

    All tables but the curves come from one small table of cells. ``curves_too`` adds areas under the curves, for which the
    scores of every round are written.
    """
    cells = durable(round_cells(df, model, label, every), "round-cells")
    whole = F.count("loss") == F.count("*")
    tables = {
        "confusion": cells.drop("loss"),
        "summary": metrics.summary(cells, ["round"]),
        "per_class": metrics.per_class(cells, ["round"]),
        "report": metrics.report(cells, ["round"]),
        "log_loss": cells.groupBy("round").agg(F.when(whole, F.sum("loss") / F.sum("n")).alias("log_loss"), F.sum("n").alias("n")),
    }
    if curves_too:
        rows = durable(score_rounds(df, model, label, every=every).select("round", "probs", "true_label"), "round-scores")
        counts = curves.threshold_counts(rows, "probs", "true_label", model.classes, by=["round"])
        tables |= {"roc_auc": curves.roc_auc(counts, ["round"]), "pr_area": curves.pr_area(counts, ["round"])}
    return tables
