import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowlake.operators import ordering, partition


def test_windows_give_the_remainder_to_the_last(spark):
    df = spark.range(1003)
    got = ordering.positional_windows(df, ["id"]).groupBy("window").count().orderBy("window").collect()
    assert [r["count"] for r in got] == [100] * 9 + [103]


def test_rank_with_heavy_ties_and_many_slices(spark):
    # a third of all rows share one order value; the unique key splits them over slices
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    got = ordering.with_rank(df, ["k", "id"], slices=16).toPandas().sort_values(["k", "id"])
    assert (got["rank"].to_numpy() == np.arange(3000)).all()


def test_many_slices_rank_by_join(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_LITERAL_SLICES", 3)
    got = ordering.with_rank(spark.range(500).select((F.lit(1000) - F.col("id")).alias("k")), ["k"], slices=12, size="n")
    rows = got.toPandas().sort_values("k")
    assert (rows["rank"].to_numpy() == np.arange(500)).all() and (rows["n"] == 500).all()


def test_group_rank_of_a_hot_group(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, "hot").otherwise("cold").alias("g"))
    got = ordering.with_rank(df, [F.desc("id")], ["g"], slices=8, size="n").toPandas()
    for group, n in (("hot", 1500), ("cold", 500)):
        part = got[got.g == group].sort_values("id", ascending=False)
        assert (part["rank"].to_numpy() == np.arange(n)).all()
        assert (part["n"] == n).all()


def test_rank_plan_has_no_window_and_no_single_task(spark):
    ranked = ordering.with_rank(spark.range(100), ["id"])
    plan = ranked._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_forward_fill_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(500), "g": rng.integers(0, 3, 500), "v": rng.normal(size=500)})
    pdf.loc[rng.random(500) < 0.6, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = ordering.forward_fill(df, ["v"], ["id"], slices=20).toPandas().sort_values("id")
    np.testing.assert_array_equal(got["v"].to_numpy(), pdf["v"].ffill().to_numpy())
    by = ordering.forward_fill(df, ["v"], ["id"], ["g"], slices=20).toPandas().sort_values("id")
    np.testing.assert_array_equal(by["v"].to_numpy(), pdf.groupby("g")["v"].ffill().to_numpy())


def test_running_sum_over_slices(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4).alias("g"), (F.col("id") * 2).alias("v"))
    got = ordering.running_sum(df, {"total": "v"}, ["id"], ["g"], slices=9).toPandas().sort_values("id")
    pdf = df.toPandas().sort_values("id")
    assert (got["total"].to_numpy() == pdf.groupby("g")["v"].cumsum().to_numpy()).all()


def test_client_sizes_follow_the_law(spark):
    for law, sizes in {"linear": [10, 20, 30, 40], "square": [3, 13, 30, 54]}.items():
        got = partition.assign_clients(spark.range(100), ["id"], 4, law).groupBy("client").count().orderBy("client").collect()
        assert [r["count"] for r in got] == sizes
