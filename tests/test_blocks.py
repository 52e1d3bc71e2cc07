"""Training tables are read in blocks: what a pass moves does not follow the rows one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import boost, mlp
from flowlake.operators.model import Tree

NAMES = ["a", "b"]
PLAIN = boost.BoostParams(eta=0.5, max_depth=2, rounds=2, subsample=1.0, colsample_bytree=1.0)


def _flows(spark, n=6000, clients=(0, 1, 2)):
    """Two features, one with gaps; the label follows the other. Every fifth row is held out."""
    rows = [(i, float(i % 7) if i % 11 else None, float(i % 13), int(i % 13 > 5), clients[i % len(clients)], i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, label int, client int, held boolean").repartition(3)


def _prepared(df, **more):
    edges = [[float(v) for v in range(6)], [float(v) for v in range(12)]]
    return boost.prepare(df, NAMES, "label", 2, "id", client="client", validation=F.col("held"), edges=edges, **more)


def _watched(module, monkeypatch):
    read, plain = [], module.gathered
    monkeypatch.setattr(module, "gathered", lambda df: read.append(df.count()) or plain(df))
    return read


def test_boosting_passes_read_blocks(spark, monkeypatch):
    read = _watched(boost, monkeypatch)
    data = _prepared(_flows(spark))
    _, history = boost.fit(data, PLAIN, patience=9)
    # a growing pass and a judging pass per round; before, they read 4,800 and 1,200 rows
    assert len(read) == 4 and max(read) <= 10
    assert history[-1]["accuracy"] == 1.0


def test_blocks_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(boost, "_BLOCK_BYTES", 1600)
    data = _prepared(_flows(spark), tracks=2)
    blocks = data.blocks.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.max(F.length("margin") / F.col("n")).alias("bytes")).first()
    assert (blocks["most"], blocks["n"], blocks["bytes"]) == (50, 6000, 32.0)
    got = {r["row_id"]: r for r in data.rows.collect()}
    assert len(got) == 6000
    for r in _flows(spark).withColumn("row_id", F.xxhash64("id")).collect():
        found = got[r["row_id"]]
        assert (found["label"], found["client"], found["is_val"], found["weight"]) == (r["label"], r["client"], r["held"], 1.0)
        assert list(found["bins"]) == [0 if r["a"] is None else int(r["a"]) + 1 if r["a"] < 6 else 7, min(int(r["b"]) + 1, 13)]


def test_block_size_changes_no_tree(spark, monkeypatch):
    nodes = []
    for size in (1 << 17, 160):
        monkeypatch.setattr(boost, "_BLOCK_BYTES", size)
        monkeypatch.setattr(boost, "_SLICE_ROWS", 16_384 if size > 160 else 33)
        trainer = boost.Trainer(_prepared(_flows(spark)), {0: PLAIN})
        trainer.round(range(3), local_rounds=2)
        nodes.append([(t.client, t.turn, t.cls, {n: s[:2] for n, s in t.splits.items()}) for t in trainer.trees])
    assert nodes[0] == nodes[1]


def test_rows_of_no_client_or_side_stay_apart(spark):
    """Rows without client train with nobody and are judged as a group of their own; rows of no side do neither."""
    df = _flows(spark, clients=(0, 1, None)).withColumn("held", F.when(F.col("id") % 17 > 0, F.col("held")))
    data = _prepared(df)
    trainer = boost.Trainer(data, {0: PLAIN})
    trainer.round(range(2), local_rounds=2)
    judged = boost.validate(trainer.data, [0]).groupBy("client").agg(F.sum("n").alias("n"))
    want = df.where("held").groupBy("client").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in judged.collect()} == {tuple(r) for r in want.collect()}
    assert data.rows.where("is_val is null").count() == df.where("held is null").count() > 0


def test_labels_outside_are_counted(spark):
    df = _flows(spark).withColumn("label", F.when(F.col("id") % 100 > 0, F.col("label") + F.when(F.col("id") < 50, 2).otherwise(0)))
    with pytest.raises(ValueError, match="109 rows have a label in label"):
        _prepared(df)


def test_rows_walk_alike_however_they_lie():
    rng = np.random.default_rng(1)
    tree = Tree(0, 0, 0, 0)
    tree.split(1, 1, 4, 4.0, True, 1.0)
    tree.split(2, 0, 2, 2.0, False, 1.0)
    tree.leaves.update({3: 0.3, 4: 0.4, 5: 0.5})
    bins = rng.integers(-1, 9, (500, 2))
    want = [0.3 if b > 4 else 0.4 if 0 <= a <= 2 else 0.5 for a, b in bins]
    for values in (bins, np.asfortranarray(bins)):
        assert tree.outputs()[tree.place(values)].tolist() == want
    assert tree.outputs()[tree.place(np.where(bins < 0, np.nan, bins), raw=True)].tolist() == want


def test_epochs_read_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    df = spark.createDataFrame([(x[i].tolist(), int(x[i, 0] > 0)) for i in range(3000)], "x array<double>, label int").repartition(4)
    train, held = mlp.prepare_rows(df.where("x[1] < 0"), "x", "label"), mlp.prepare_rows(df.where("x[1] >= 0"), "x", "label")
    sizes = [train.count(), held.count()]
    read = _watched(mlp, monkeypatch)
    spec = mlp.MlpSpec(2, 2, (8,), rate=0.02)
    _, history = mlp.fit_mlp(train, spec, epochs=3, validation=held)
    # the rows are read once; before, every epoch read them again
    assert read[:2] == sizes and len(read) == 8 and max(read[2:]) <= 100
    assert history[-1]["val_loss"] < history[0]["val_loss"]
    # one epoch is not worth a table of blocks, and is the same training
    once = mlp.fit_mlp(train, spec, epochs=1, validation=held)[1]
    assert once == history[:1] or abs(once[0]["val_loss"] - history[0]["val_loss"]) < 1e-9


def test_blocks_and_rows_train_alike_by_client(spark):
    rng = np.random.default_rng(5)
    rows = [(rng.normal(size=3).tolist(), int(rng.integers(0, 2)), [0, 1, None][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "x array<double>, label int, client int")
    train = mlp.prepare_rows(df, "x", "label", client="client")
    spec = mlp.MlpSpec(3, 2, (4,), rate=0.1, loss="focal")
    first, one = mlp.federated_average(train, spec, [0, 1], rounds=1, local_steps=2, batch_rows=16)
    _, two = mlp.federated_average(train, spec, [0, 1], rounds=2, local_steps=2, batch_rows=16, validation=train)
    assert abs(one[0]["loss"] - two[0]["loss"]) < 1e-12 and two[0]["n"] == 600
    # rows of no client are in no score
    assert two[1]["validation"]["all"]["n"] == 600 and set(two[1]["validation"]) == {"client_0", "client_1", "all"}
    assert first.shape == mlp.start_weights(spec).shape
