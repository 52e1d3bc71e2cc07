import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.functions import scores as S
from flowlake.operators import convergence, curves, federate, metrics, profile, weights


def _history(spark, losses):
    return spark.createDataFrame(list(enumerate(losses)), "round int, loss double")


def test_convergence_rule(spark):
    cases = {
        # 1.0 - 0.999 exceeds 0.001 in binary arithmetic
        (1.0, 0.999, 0.9989, 0.9988): False,
        (1.0, 0.9995, 0.9990, 0.9988): True,
        tuple(1.5 - i * 0.0001 for i in range(5)): True,
        (1.0, 0.9, 0.8, 0.7): False,
        (1.0, 0.9999): False,
        (1.0, 1.2, 1.3, 1.4): True,
    }
    for losses, want in cases.items():
        last = convergence.converged(_history(spark, losses)).orderBy(F.desc("round")).first()
        assert last["converged"] is want, losses


def test_early_stop_counts_from_the_last_strict_best(spark):
    got = convergence.early_stop(_history(spark, [1.0, 0.9, 0.9, 0.95, 0.8, 0.81]), patience=2).orderBy("round").collect()
    assert [r["stale_rounds"] for r in got] == [0, 0, 1, 2, 0, 1]
    assert [r["stop"] for r in got] == [False, False, False, True, False, False]


def test_patience_of_running_loops_is_the_same_rule(spark):
    losses = [1.0, 0.9, 0.9, 0.95, 0.8, 0.81, 0.8, 0.9]
    table = convergence.early_stop(_history(spark, losses), patience=2).orderBy("round").collect()
    stop = convergence.Patience(2)
    assert [stop.spent("a", loss, i) for i, loss in enumerate(losses)] == [r["stop"] for r in table]
    # learners do not share their bests
    assert not stop.spent("b", 5.0, 7)


def test_a_metric_missing_at_one_client_becomes_zero(spark):
    clients = spark.createDataFrame([(0, 10, 0.5, 1.0), (1, 30, 0.9, None)], "client int, n int, f1 double, mlogloss double")
    got = federate.aggregate_metrics(clients, ["f1", "mlogloss"]).first()
    assert math.isclose(got["f1"], 0.8) and got["mlogloss"] == 0.0 and got["n"] == 40


def test_hand_computed_losses(spark):
    df = spark.createDataFrame([([2.0, 0.0, -1.0], 0), ([0.5, 0.5, 0.0], 2)], "z array<double>, y int")
    z, y = np.array([[2.0, 0.0, -1.0], [0.5, 0.5, 0.0]]), np.array([0, 2])
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    lt = logp[[0, 1], y]
    focal = metrics.focal_loss(df, "z", "y", 2.0).first()
    assert math.isclose(focal["mean_loss"], float(((1 - np.exp(lt)) ** 2 * -lt).mean()))
    target = 0.9 * np.eye(3)[y] + 0.1 / 3
    smooth = metrics.smoothing_loss(df, "z", "y", 3).first()
    assert math.isclose(smooth["mean_loss"], float((-target * logp).mean()))
    probs = df.withColumn("p", S.softmax("z"))
    assert math.isclose(metrics.log_loss(probs, "p", "y", 3).first()["log_loss"], float(-lt.mean()))
    assert metrics.log_loss(probs, "p", "y", 4).first()["log_loss"] is None


def test_auc_of_a_perfect_and_a_reversed_ranking(spark):
    rows = [([1 - i / 10, i / 10], int(i >= 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "p array<double>, y int")
    counts = curves.threshold_counts(df, "p", "y", 2)
    assert {r["class"]: r["auc"] for r in curves.roc_auc(counts).collect()} == {0: 1.0, 1: 1.0}
    flipped = curves.threshold_counts(df.withColumn("y", 1 - F.col("y")), "p", "y", 2)
    assert {r["class"]: r["auc"] for r in curves.roc_auc(flipped).collect()} == {0: 0.0, 1: 0.0}


def test_all_weightings_sum_to_the_class_count(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 0).when(F.col("id") < 950, 1).otherwise(5).alias("y"))
    for method in ("balanced", "inverse", "sqrt_inverse", "log_inverse", "effective_number"):
        got = {r["y"]: r["weight"] for r in weights.class_weights(df, "y", method).collect()}
        assert set(got) == {0, 1, 5} and math.isclose(sum(got.values()), 3.0)
        assert got[0] < got[1] < got[5]


def test_focal_gamma_follows_the_imbalance(spark):
    for small, gamma in ((60, 1.0), (30, 2.0), (15, 3.0), (5, 4.0)):
        df = spark.range(100 + small).select((F.col("id") < small).cast("int").alias("y"))
        assert weights.focal_recommendation(df, "y").first()["gamma"] == gamma


def test_redundant_columns_walk(spark):
    df = spark.range(200).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 2.0 + 1).alias("b"), (F.col("id") * -1.0).alias("c"),
        (F.col("id") * 3.0).alias("d"), ((F.col("id") * 7919) % 13).cast("double").alias("e"),
    )
    # c runs against a: the threshold is signed
    assert profile.redundant_columns(df, list("abcde")) == ["b", "d"]


def test_explained_variance_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [3, 2, 1, 0.1]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    got = [r["ratio"] for r in profile.explained_variance(df, "v", 4).orderBy("component").collect()]
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    np.testing.assert_allclose(got, want / want.sum(), atol=1e-9)


def test_rows_outside_the_grid_count_as_wrong(spark):
    rows = [(0, 0), (1, 1), (1, 0), (-1, 1), (None, 0), (2, 7), (7, 7), (2, 2)]
    df = spark.createDataFrame(rows, "t int, p int")
    cells = metrics.confusion(df, "t", "p", 3)
    got = metrics.summary(cells).first()
    assert got["n"] == len(rows) and got["accuracy"] == 3 / 8
    assert sum(r["n"] for r in cells.collect()) == len(rows)
    report = {r["row"]: r["support"] for r in metrics.report(cells).collect()}
    assert report["other"] == 3 and report["weighted avg"] == len(rows)


def test_training_refuses_unseen_labels(spark):
    from flowlake.operators.encode import require_labels

    df = spark.createDataFrame([(0,), (-1,), (None,), (5,)], "label int")
    with pytest.raises(ValueError, match="3 rows"):
        require_labels(df, "label", 5)
    assert require_labels(df.where("label >= 0"), "label").count() == 2
