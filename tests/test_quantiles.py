import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import quantiles


@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "ints"])
def test_narrowing_is_exact(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=20000),
        "ties": np.where(rng.random(20000) < 0.4, 3.0, rng.normal(size=20000)),
        "constant": np.full(1000, 2.5),
        "ints": rng.integers(0, 20, 5000).astype(float),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = quantiles.narrowed_quantiles(df, ["v"], probs, candidates=50)["v"]
    np.testing.assert_allclose(got, np.quantile(values, probs), rtol=0, atol=1e-12)


@pytest.mark.parametrize("accuracy", [3, 40])
def test_poor_sketches_and_many_candidates_stay_exact(spark, accuracy, monkeypatch):
    """Wide brackets are searched by sub-brackets, missed ones widened."""
    monkeypatch.setattr(quantiles, "_PARTS", 8)
    rng = np.random.default_rng(9)
    values = np.r_[rng.normal(size=3000), np.full(900, 0.25), rng.lognormal(3, 2, 1000)]
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "v double, w double").repartition(3)
    probs = [0.001, 0.3, 0.5, 0.777]
    got = quantiles.narrowed_quantiles(df, ["v", "w"], probs, candidates=5, accuracy=accuracy)
    np.testing.assert_allclose(got["v"], np.quantile(values, probs), rtol=0, atol=1e-12)
    np.testing.assert_allclose(got["w"], np.quantile(-values, probs), rtol=0, atol=1e-12)


def test_a_bracket_that_misses_is_widened(spark):
    clean = spark.range(1000).select(F.col("id").cast("double").alias("c0"))
    proved = quantiles._proved(clean, [1000], {(0, 500): (10.0, 20.0)}, 1000)
    low, high, below, inside = proved[0, 500]
    assert low <= 500 <= high and below <= 500 < below + inside
    assert quantiles._values(clean, proved, 3) == {(0, 500): 500.0}


def test_missing_and_infinite_values_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "v double")
    q = quantiles.quantile_columns(df, ["v"], [0.5])
    assert df.agg(q["v"][0].alias("m")).first()["m"] == 2.0


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.narrowed_quantiles(df, ["v"], [0.5])["v"] == [None]
    assert df.agg(F.max(F.lit(1))).first()[0] == 1
