import pytest
from pyspark.sql import functions as F

from flowlake.operators import splits


@pytest.fixture(scope="module")
def flows(spark):
    """Eleven classes; class 2 sits in a narrow time band, class 0 holds a third of all rows."""
    label = F.when(F.col("id") % 3 == 0, 0).when((F.col("id") >= 5000) & (F.col("id") < 5600), 2)
    other = (F.col("id") * 7919) % 11
    return spark.range(11000).select(
        F.col("id"), F.col("id").cast("double").alias("stime"),
        label.otherwise(F.when(other == 2, 3).otherwise(other)).cast("int").alias("label"),
    ).cache()


def test_temporal_split_keeps_every_class_on_both_sides(flows):
    got = splits.covered_split(flows, "id", "label", ["stime", "id"]).cache()
    assert got.count() == flows.count()
    classes = {s: {r["label"] for r in got.where(F.col("split") == s).select("label").distinct().collect()} for s in ("train", "test")}
    assert classes["train"] == classes["test"] == set(range(11))
    share = got.where("split = 'train'").count() / got.count()
    assert 0.75 <= share <= 0.85
    span = got.groupBy("split").agg((F.max("stime") - F.min("stime")).alias("s")).collect()
    assert all(r["s"] > 10000 for r in span)


def test_unstratifiable_window_splits_by_time(spark):
    # one row of class 9 in the first window of ten
    df = spark.range(100).select("id", F.when(F.col("id") == 3, 9).otherwise(F.col("id") % 2).alias("label"))
    got = {r["id"]: r["split"] for r in splits.temporal_stratified_split(df, "id", "label", ["id"]).collect()}
    assert [got[i] for i in range(10)] == ["train"] * 8 + ["test"] * 2


def test_falls_back_to_a_global_split(spark):
    # the only rows of class 5 are at the end of one window, so time order would lose them
    df = spark.range(100).select("id", F.when(F.col("id").isin(9, 19), 5).otherwise(F.col("id") % 2).alias("label"))
    temporal = splits.temporal_stratified_split(df, "id", "label", ["id"])
    assert [tuple(r) for r in splits.missing_classes(temporal, "label").select("split", "label").collect()] == [("train", 5)]
    covered = splits.covered_split(df, "id", "label", ["id"])
    assert covered.where("label = 5").count() == 2 and covered.count() == 100


def test_quota_is_exact_for_any_cell_width(flows):
    sizes = {r["label"]: r["count"] for r in flows.groupBy("label").count().collect()}
    picked = []
    for digits in (1, 2, 3):
        cut = splits.cut_segments(flows, "id", lambda n: F.array(F.round(n * 0.2).cast("bigint")), ["label"], digits=digits)
        test = cut.where("segment = 0")
        assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {
            k: int(n * 0.2 + 0.5) for k, n in sizes.items()
        }
        picked.append({r["id"] for r in test.select("id").collect()})
    assert picked[0] == picked[1] == picked[2]


@pytest.mark.parametrize("ranked", [1, 7, 200])
def test_wide_cells_are_refined_until_few_rows_are_ranked(flows, ranked, monkeypatch):
    """Any bound on ranked rows gives the same cut, and no ranked cell is larger than it."""
    want = {r["id"] for r in splits.undersample(flows, "id", "label", 250).select("id").collect()}
    sizes = []
    plain = splits._cut_marks
    monkeypatch.setattr(splits, "_cut_marks", lambda h, cuts, *more: sizes.append(cuts.where("rest > 0").agg(F.max("size")).first()[0]) or plain(h, cuts, *more))
    ends = lambda n: F.array(F.lit(250).cast("bigint"))
    cut = splits.cut_segments(flows, "id", ends, ["label"], digits=1, ranked=ranked)
    assert {r["id"] for r in cut.where("segment = 0").select("id").collect()} == want
    assert (sizes[0] or 0) <= ranked
    whole = splits.cut_segments(flows, "id", lambda n: F.array(F.lit(100).cast("bigint"), F.lit(100).cast("bigint"), n - 3), digits=1, ranked=ranked)
    assert {r["segment"]: r["count"] for r in whole.groupBy("segment").count().collect()} == {0: 100, 2: 11000 - 103, 3: 3}


def test_drawn_clients_are_the_first_by_hash(spark):
    from flowlake.operators.federate import select_clients

    clients = spark.range(5000).select(F.col("id").alias("client"))
    got = select_clients(clients.union(clients), [1, 2, 3], 0.1)
    assert {r["round"]: r["count"] for r in got.groupBy("round").count().collect()} == {1: 500, 2: 500, 3: 500}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert select_clients(clients.limit(2), [1], 0.1, minimum=3).count() == 0
    assert select_clients(clients.limit(4), [1], 0.1, minimum=3).count() == 3


def test_a_split_is_a_projection_with_one_small_join(flows):
    plan = splits.stratified_split(flows, "id", "label")._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Union" not in plan
    assert plan.count("BroadcastHashJoin") == 1


def test_clients_hold_every_class_equally(flows):
    got = splits.stratified_clients(flows, "id", "label", 3).groupBy("label", "client").count().collect()
    sizes: dict = {}
    for r in got:
        sizes.setdefault(r["label"], {})[r["client"]] = r["count"]
    for per_client in sizes.values():
        assert set(per_client) == {0, 1, 2}
        assert per_client[0] == per_client[1] <= per_client[2] <= per_client[0] + 2


def test_null_labels_are_a_stratum(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, "a").alias("label"))
    got = splits.stratified_split(df, "id", "label")
    assert got.where("label is null and split = 'test'").count() == 10
