from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.functions import scores as S
from flowlake.operators import boost, metrics, mlp, neighbours, rounds, score, search
from flowlake.operators.model import BoostModel, leaf_sums, predict, top_features
from flowlake.plans.inputs import FLOW_CLASSES, FLOW_FEATURES, flows
from flowlake.sources.durable import fresh_path

PARAMS = boost.BoostParams(eta=0.5, max_depth=4, rounds=4, subsample=0.9, colsample_bytree=1.0)


@pytest.fixture(scope="module")
def table(spark):
    return flows(spark, "/root/testdata/sf0.001").cache()


@pytest.fixture(scope="module")
def data(table):
    return boost.prepare(
        table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", client="client", validation=F.col("held_out"), tracks=2
    )


@pytest.fixture(scope="module")
def fitted(table, data):
    own = boost.prepare(
        table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"), edges=data.edges
    )
    return boost.fit(own, PARAMS, patience=10)


def _accuracy(scored):
    return metrics.summary(metrics.confusion(scored, "true_label", "predicted_label", FLOW_CLASSES)).first()["accuracy"]


def test_loss_falls_and_beats_the_majority(table, fitted):
    model, history = fitted
    losses = [h["mlogloss"] for h in history]
    assert losses == sorted(losses, reverse=True) and losses[0] < np.log(FLOW_CLASSES)
    held = table.where("held_out")
    majority = held.groupBy("label").count().agg(F.max("count")).first()[0] / held.count()
    got = _accuracy(score.score_table(held, model, "label"))
    assert got > majority + 0.3
    # bins and raw thresholds place rows alike: training loop and scoring agree
    assert abs(got - history[-1]["accuracy"]) < 1e-9


def test_same_seed_same_nodes(table, data, fitted):
    again = boost.prepare(
        table.repartition(5), FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"),
        edges=data.edges,
    )
    model, _ = boost.fit(again, PARAMS)
    key = lambda m: [(t.turn, t.cls, {n: s[:2] for n, s in t.splits.items()}) for t in m.trees]
    assert key(model) == key(fitted[0])


def test_partial_sums_handed_on_early_give_the_same_trees(table, data, fitted, monkeypatch):
    monkeypatch.setattr(boost, "_HELD_CELLS", 100)
    again = boost.prepare(
        table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"), edges=data.edges
    )
    model, _ = boost.fit(again, replace(PARAMS, rounds=1))
    first = [t for t in fitted[0].trees if t.turn == 0]
    assert [{n: s[:2] for n, s in t.splits.items()} for t in model.trees] == [
        {n: s[:2] for n, s in t.splits.items()} for t in first
    ]


def test_split_gain_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (400, 2)).astype(float)
    y = ((x[:, 0] > 2) ^ (rng.random(400) < 0.1)).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, a double, b double, label int")
    edges = [[0.0, 1.0, 2.0, 3.0, 4.0]] * 2
    prepared = boost.prepare(df, ["a", "b"], "label", 2, "id", edges=edges)
    p = boost.BoostParams(eta=1.0, max_depth=1, subsample=1.0, colsample_bytree=1.0, rounds=1, reg_lambda=0.5, reg_alpha=1.0)
    tree = boost.fit(prepared, p)[0].trees[0]
    g, h = 0.5 - (y == 0), np.full(400, 0.5)

    def part(m):
        return max(abs(g[m].sum()) - 1.0, 0) ** 2 / (h[m].sum() + 0.5)

    gains = {
        (f, b): 0.5 * (part(x[:, f] <= e) + part(x[:, f] > e) - part(np.ones(400, bool)))
        for f in range(2)
        for b, e in enumerate(edges[f])
    }
    best = max(gains, key=lambda k: (round(gains[k], 9), -k[0], -k[1]))
    assert tree.splits[1][:2] == best
    assert abs(tree.splits[1][4] - gains[best]) < 1e-6


def test_missing_values_take_the_better_side(spark):
    rows = [(i, float(i % 10) if i % 4 else None, int(i % 10 >= 5 or i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, label int")
    prepared = boost.prepare(df, ["a"], "label", 2, "id", edges=[[float(v) for v in range(9)]])
    model, _ = boost.fit(prepared, boost.BoostParams(eta=1.0, max_depth=1, subsample=1.0, rounds=1, colsample_bytree=1.0))
    feat, bin_, threshold, miss_left, _ = model.trees[1].splits[1]
    assert (threshold, miss_left) == (4.0, False)
    scored = predict(df, model).withColumn("pred", S.argmax("probs"))
    assert scored.where("pred <> label").count() == 0


def test_leaf_wise_growth_respects_the_leaf_limit(table):
    own = boost.prepare(table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id")
    p = replace(PARAMS, grow_policy="lossguide", max_leaves=5, max_depth=0, rounds=1)
    trees = boost.fit(own, p)[0].trees
    assert all(t.leaf_count() <= 5 for t in trees) and any(t.leaf_count() == 5 for t in trees)


def test_early_stop_ends_before_all_rounds(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=10)), int(rng.integers(0, 10))) for i in range(1000)]
    names = [f"f{i}" for i in range(10)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", label int")
    own = boost.prepare(df, names, "label", 10, "id", validation=F.col("id") >= 800)
    _, history = boost.fit(own, boost.BoostParams(eta=0.5, max_depth=3, rounds=30), patience=2)
    assert len(history) < 30


def test_save_load_and_force(spark, table, fitted):
    model, _ = fitted
    path = fresh_path(spark, "model")
    model.save(spark, path)
    with pytest.raises(Exception, match="already exists"):
        model.save(spark, path)
    model.save(spark, path, force=True)
    again = BoostModel.load(spark, path)
    assert again.node_rows() == model.node_rows()
    x = np.random.default_rng(1).normal(size=(50, len(FLOW_FEATURES))) * 1000
    np.testing.assert_array_equal(
        leaf_sums(again.trees, FLOW_CLASSES, x, raw=True), leaf_sums(model.trees, FLOW_CLASSES, x, raw=True)
    )
    top = top_features(boost.model_frame(spark, again), again.features, 3).collect()
    assert {"l_extendedprice", "l_quantity"} <= {r["feature"] for r in top}


def test_probabilities_have_one_column_per_class(table, fitted):
    sizes = predict(table, fitted[0]).select(F.size("probs").alias("k"), F.aggregate("probs", F.lit(0.0), lambda a, v: a + v).alias("s"))
    row = sizes.agg(F.min("k"), F.max("k"), F.min("s"), F.max("s")).first()
    assert row[0] == row[1] == FLOW_CLASSES and abs(row[2] - 1) < 1e-9 and abs(row[3] - 1) < 1e-9


def test_warm_start_continues_the_margins(table, fitted):
    model, history = fitted
    more = boost.prepare(
        table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"), start=model
    )
    grown, later = boost.fit(more, replace(PARAMS, rounds=2), patience=5, start=model)
    assert later[0]["mlogloss"] < history[-1]["mlogloss"]
    assert len(grown.trees) == len(model.trees) + 2 * FLOW_CLASSES
    assert {t.turn for t in grown.last_turns(1).trees} == {max(t.turn for t in grown.trees)}


def test_bagging_appends_every_clients_trees(data):
    model, history = rounds.federated_rounds(data, replace(PARAMS, eta=0.2), 5, 2, "bagging")
    assert len(model.trees) == 2 * 5 * FLOW_CLASSES
    central = {(r["round"], r["metric"]): r["value"] for r in history.where("source = 'central'").collect()}
    assert central[(2, "mlogloss")] < central[(1, "mlogloss")]
    spread = {(r["round"], r["metric"]): r["value"] for r in history.where("source = 'distributed'").collect()}
    # rows are shared out, so the weighted client losses are the loss of all rows
    assert abs(spread[(1, "mlogloss")] - central[(1, "mlogloss")]) < 1e-9


def test_cyclic_trains_one_client_per_round(data):
    model, _ = rounds.federated_rounds(data, PARAMS, 5, 3, "cyclic", local_rounds=2)
    assert [sorted({t.client for t in model.trees if t.turn == n}) for n in range(6)] == [[0], [0], [1], [1], [2], [2]]


def test_rounds_really_stop_on_convergence(data):
    _, history = rounds.federated_rounds(data, replace(PARAMS, eta=1e-6), 5, 8, "cyclic", patience=2)
    assert history.agg(F.max("round")).first()[0] == 3


def test_sampled_trials_follow_the_space(spark):
    got = search.sample_trials(spark, 200).toPandas()
    assert got["max_depth"].between(2, 19).all() and got["num_boost_round"].between(10, 999).all()
    assert got["eta"].between(0.001, 0.8).all() and set(got["grow_policy"]) == {"depthwise", "lossguide"}
    assert set(got["max_delta_step"]) == {0, 1, 2, 5, 10}
    assert (np.log(got["eta"]).median() > np.log(0.01)) and (np.log(got["eta"]).median() < np.log(0.08))


def test_halving_keeps_the_better_trial(data, table):
    trials = {0: replace(PARAMS, eta=0.5, rounds=4), 1: replace(PARAMS, eta=1e-4, max_depth=1, rounds=4)}
    results = search.successive_halving(data, trials, grace=1, factor=2)
    got = {r["trial"]: r for r in results.collect()}
    assert got[0]["rounds"] == 4 and got[1]["rounds"] == 1
    assert search.best_trial(results).first()["trial"] == 0
    # the refit starts from fresh margins
    model = search.refit_best(data, trials, results)
    assert len(model.trees) == 4 * FLOW_CLASSES


def test_margins_carry_every_finished_tree(data, table):
    """After any rounds the stored margins are the model's, and only the new trees were walked."""
    trainer = boost.Trainer(data, {0: replace(PARAMS, rounds=3, eta=0.05)})
    for _ in range(3):
        trainer.round(range(5), local_rounds=2)
    assert "own" not in trainer.data.rows.columns and trainer.data.tracks == (0,)
    fitted = trainer.model()
    assert len(fitted.trees) == 3 * 2 * 5 * FLOW_CLASSES
    judged = boost.cell_scores(boost.validate(trainer.data, [0]).collect(), FLOW_CLASSES)
    tables = score.evaluate_rounds(table.where("held_out"), fitted, "label")
    last = tables["log_loss"].where("round = 6").first()
    assert abs(last["log_loss"] - judged["mlogloss"]) < 1e-9


def test_clients_continue_their_own_trees_within_a_round(data):
    """Local rounds of several clients give what each client trained alone gives."""
    together = boost.Trainer(data, {0: PARAMS})
    together.round(range(5), local_rounds=3)
    for client in (0, 3):
        alone = boost.Trainer(data, {0: PARAMS})
        alone.round([client], local_rounds=3)
        key = lambda trees: [(t.turn, t.cls, {n: s[:2] for n, s in t.splits.items()}) for t in trees if t.client == client]  # noqa: E731, B023
        assert key(together.trees) == key(alone.trees)


def test_a_client_stops_alone(data):
    trainer = boost.Trainer(data, {0: replace(PARAMS, eta=2.0, subsample=1.0)})
    trainer.round(range(5), local_rounds=6, patience=1)
    turns = {c: max(t.turn for t in trainer.trees if t.client == c) for c in range(5)}
    assert len(set(turns.values())) > 1
    for c, last in turns.items():
        losses = [loss for _, _, client, loss in trainer.local_losses if client == c]
        assert len(losses) == last + 1
        assert all(b < a for a, b in zip(losses[:-1], losses[1:-1])) and (last == 5 or losses[-1] >= losses[-2])


def test_failed_trials_score_zero_and_others_go_on(table):
    wide = boost.prepare(
        table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"), tracks=4
    )
    fine = replace(PARAMS, rounds=3)
    trials = {0: fine, 1: replace(fine, colsample_bytree=0.0), 2: replace(fine, eta=1.7e308), 3: replace(fine, eta=0.1)}
    got = {r["trial"]: r for r in search.successive_halving(wide, trials, grace=9).collect()}
    assert [got[t]["rounds"] for t in range(4)] == [3, 0, 1, 3]
    for t in (1, 2):
        assert got[t]["objective"] == got[t]["f1"] == got[t]["accuracy"] == 0 and got[t]["mlogloss"] == float("inf")
    own = boost.prepare(
        table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"), edges=wide.edges
    )
    # what a trial reports does not depend on the others
    for t in (0, 3):
        _, history = boost.fit(own, trials[t], patience=99)
        assert abs(got[t]["mlogloss"] - history[-1]["mlogloss"]) < (1e-9 if t == 0 else 1e9)
    with pytest.raises(ValueError, match="colsample_bytree"):
        boost.fit(own, trials[1])
    with pytest.raises(ArithmeticError):
        boost.fit(own, trials[2])


def test_dropped_trials_leave_the_rows(table):
    wide = boost.prepare(
        table, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"), tracks=4
    )

    def bytes_a_row(data):
        return data.rows.agg(F.max(F.length("margin"))).first()[0]

    trainer = boost.Trainer(wide, {t: replace(PARAMS, eta=0.1 * (t + 1)) for t in range(4)})
    trainer.round()
    assert bytes_a_row(trainer.data) == 4 * FLOW_CLASSES * 8
    before = boost.client_losses(boost.validate(trainer.data, [1, 3]))
    trainer.drop([0, 2])
    trainer.round()
    assert trainer.data.tracks == (1, 3) and bytes_a_row(trainer.data) == 2 * FLOW_CLASSES * 8
    after = boost.client_losses(boost.validate(trainer.data, [1, 3]))
    assert all(after[k] < before[k] for k in before) and {t.track for t in trainer.trees} == {1, 3}


def test_a_round_costs_the_same_however_many_went_before(data, monkeypatch):
    """Every kernel is built for the trees of its own round only."""
    walked = []
    plain = boost._adder
    monkeypatch.setattr(boost, "_adder", lambda layout, trees, *more: walked.append(len(trees)) or plain(layout, trees, *more))
    trainer = boost.Trainer(data, {0: replace(PARAMS, max_depth=1, eta=0.1)})
    for _ in range(6):
        trainer.round()
    assert walked == [FLOW_CLASSES] * 6 and len(trainer.trees) == 6 * FLOW_CLASSES


def test_round_tables_agree_with_single_scoring(table, fitted):
    model, _ = fitted
    held = table.where("held_out")
    tables = score.evaluate_rounds(held, model, "label", every=2, curves_too=True)
    assert sorted(r["round"] for r in tables["summary"].collect()) == [1, 3]
    part = BoostModel(model.features, model.classes, [t for t in model.trees if t.turn <= 2])
    one = score.evaluate_scored(score.score_table(held, part, "label"), FLOW_CLASSES)
    at = {n: f.where("round = 3").drop("round") for n, f in tables.items()}
    for name, digits in (("summary", 9), ("log_loss", 9), ("per_class", 9)):
        columns = sorted(one[name].columns)
        rows = [sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in f.select(columns).collect()) for f in (one[name], at[name])]
        assert rows[0] == rows[1], name
    for name in ("roc_auc", "pr_area"):
        a, b = ({r["class"]: r[1] for r in f.select("class", f.columns[-1]).collect()} for f in (one[name], at[name]))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 for k in a)
    rows = score.score_rounds(held, model, "label", keep=["flow_id"])
    assert rows.count() == 4 * held.count() and rows.columns[:2] == ["round", "flow_id"]


def test_labels_outside_the_classes_stay_in_the_round_tables(spark, table, fitted):
    model, _ = fitted
    odd = table.where("held_out").limit(50).withColumn("label", F.lit(None).cast("int"))
    tables = score.evaluate_rounds(odd, model, "label")
    assert {r["accuracy"] for r in tables["summary"].collect()} == {0.0}
    assert {r["log_loss"] for r in tables["log_loss"].collect()} == {None}


def test_weights_balance_inside_each_client(spark):
    from flowlake.operators.weights import balanced_sample_weights

    rows = [(0, 0), (0, 0), (0, 0), (0, 1), (1, 2), (None, 1), (None, 1), (None, 0), (1, None)]
    df = spark.createDataFrame(rows, "client int, label int")
    got = {(r["client"], r["label"]): r["weight"] for r in balanced_sample_weights(df, "label", by=["client"]).collect()}
    assert got == {(0, 0): 4 / 6, (0, 1): 2.0, (1, 2): 1.0, (None, 1): 0.75, (None, 0): 1.5}


def test_mlp_gradient_is_numerically_right():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(12, 3)), rng.integers(0, 4, 12), rng.random(12)
    for loss in ("cross_entropy", "focal", "smoothing"):
        spec = mlp.MlpSpec(3, 4, (5,), loss=loss)
        flat = mlp.start_weights(spec) + 0.05
        _, g = mlp.loss_and_gradient(flat, x, y, w, spec)
        for i in rng.choice(len(flat), 8, replace=False):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            up, down = (mlp.loss_and_gradient(flat + s * step, x, y, w, spec)[0] for s in (1, -1))
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_mlp_learns_and_averages(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    rows = [(int(i % 3), x[i].tolist(), int(x[i, 0] > 0) + 2 * int(x[i, 1] > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "client int, x array<double>, label int")
    spec = mlp.MlpSpec(2, 4, (8,), rate=0.1)
    train = mlp.prepare_rows(df, "x", "label", client="client")
    flat, history = mlp.federated_average(train, spec, range(3), rounds=8, local_steps=2)
    assert history[-1]["loss"] < history[0]["loss"] * 0.6
    scored = score.decide(mlp.predict_mlp(df, "x", flat, spec), "probs").withColumn("true_label", F.col("label"))
    right = scored.where("true_label = predicted_label").count() / 600
    assert right > 0.8


def _ring(spark, n=3000, parts=4):
    """Two rings inside each other: no plane divides them."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1 + label + rng.normal(scale=0.1, size=n)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    rows = [(i % 3, x[i].tolist(), int(label[i])) for i in range(n)]
    return spark.createDataFrame(rows, "client int, x array<double>, label int").repartition(parts)


def test_mini_batches_learn_in_one_pass_an_epoch(spark, monkeypatch):
    passes = []
    plain = mlp._local
    monkeypatch.setattr(mlp, "_local", lambda *args: passes.append(args[2]) or plain(*args))
    df = _ring(spark)
    train, held = (mlp.prepare_rows(df.where(f"{sign} client = 2"), "x", "label", classes=2) for sign in ("not", ""))
    flat, history = mlp.fit_mlp(train, mlp.MlpSpec(2, 2, (16,), rate=0.02), epochs=20, validation=held, batch_rows=32)
    assert passes == list(range(20)) and len(history) == 20
    assert set(history[0]) == {"epoch", *[f"{s}_{m}" for s in ("train", "val") for m in mlp.METRICS]}
    assert history[-1]["val_accuracy"] > 0.97 > history[0]["train_accuracy"]
    one = mlp.fit_mlp(train, mlp.MlpSpec(2, 2, (16,), rate=0.02), epochs=1, batch_rows=None)[1]
    assert history[1]["train_loss"] < one[0]["train_loss"]
    scored = score.decide(mlp.predict_mlp(held, "x", flat, mlp.MlpSpec(2, 2, (16,))), "probs").withColumn("true_label", F.col("label"))
    want = metrics.summary(metrics.confusion(scored, "true_label", "predicted_label", 2)).first()
    got = mlp.evaluate_mlp(held, flat, mlp.MlpSpec(2, 2, (16,)))
    for m in ("accuracy", "precision", "recall", "f1"):
        assert abs(got["all"][m] - want[m]) < 1e-12
    assert got["client_0"]["n"] == got["all"]["n"] == held.count()


def test_training_stops_after_epochs_without_a_better_loss(spark):
    rng = np.random.default_rng(8)
    rows = [(rng.normal(size=4).tolist(), int(rng.integers(0, 3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, label int")
    train, held = mlp.prepare_rows(df.limit(200), "x", "label"), mlp.prepare_rows(df.subtract(df.limit(200)), "x", "label")
    _, history = mlp.fit_mlp(train, mlp.MlpSpec(4, 3, (16,), rate=0.05), epochs=40, validation=held, patience=2, batch_rows=16)
    best = min(range(len(history)), key=lambda e: history[e]["val_loss"])
    assert len(history) < 40 and len(history) - 1 - best == 2


def test_averaged_clients_are_judged_each(spark):
    df = _ring(spark)
    rows = mlp.prepare_rows(df, "x", "label", client="client", classes=2)
    spec = mlp.MlpSpec(2, 2, (16,), rate=0.02)
    _, history = mlp.federated_average(rows, spec, [0, 1], rounds=6, local_steps=2, validation=rows, batch_rows=32)
    last = history[-1]
    assert set(last["clients"]) == {0, 1} and set(last["validation"]) == {"client_0", "client_1", "client_2", "all"}
    assert last["n"] == sum(c["n"] for c in last["clients"].values()) == 2000
    assert last["validation"]["client_2"]["accuracy"] > 0.9 and last["loss"] < history[0]["loss"]


def test_labels_beyond_the_classes_are_refused(spark):
    df = spark.createDataFrame([([1.0], 0), ([2.0], 3)], "x array<double>, label int")
    with pytest.raises(ValueError, match="1 rows"):
        mlp.prepare_rows(df, "x", "label", classes=3)


def test_neighbours_over_many_blocks_are_exact(spark):
    rng = np.random.default_rng(6)
    x, label = rng.normal(size=(120, 3)), rng.integers(0, 2, 120)
    x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id int, v array<double>, y int")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.same_class_neighbours(df, "id", "y", "v", 4, block_rows=10).collect()}
    for i in range(120):
        same = [j for j in range(120) if label[j] == label[i] and j != i]
        near = sorted(same, key=lambda j: (((x[i] - x[j]) ** 2).sum() ** 0.5, j))[:4]
        assert [got[(i, r)] for r in range(1, 5)] == near


def _plain_neighbours(ids, x, label, k):
    out = {}
    for i in range(len(ids)):
        same = [j for j in range(len(ids)) if label[j] == label[i] and j != i]
        gap = np.sqrt(((x[same] - x[i]) ** 2).sum(axis=1)) if same else []
        near = sorted(zip(gap, (ids[j] for j in same)))[:k]
        out.update({(ids[i], r): n for r, (_, n) in enumerate(near, 1)})
    return out


@pytest.mark.parametrize("ids", ["int", "text"])
def test_neighbours_with_pivots_are_exact(spark, ids):
    """Clusters, noise, a hot group of equal vectors, a lone row and rows without label."""
    rng = np.random.default_rng(12)
    centres = rng.normal(scale=20, size=(9, 4))
    x = np.vstack([centres[rng.integers(0, 9, 300)] + rng.normal(size=(300, 4)), rng.normal(size=(60, 4)), np.full((90, 4), 3.0), [[50.0] * 4]])
    label = [*rng.integers(0, 2, 300).tolist(), *[None] * 60, *[0] * 90, 7]
    names = [i if ids == "int" else f"row {i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, v.tolist(), c) for n, v, c in zip(names, x, label)], f"id {'int' if ids == 'int' else 'string'}, v array<double>, y int")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.same_class_neighbours(df, "id", "y", "v", 4, block_rows=25).collect()}
    assert got == _plain_neighbours(names, x, label, 4)


def test_clustered_rows_visit_few_units(spark, monkeypatch):
    """What is sent to other units stays a small multiple of the table."""
    rng = np.random.default_rng(13)
    centres = rng.normal(scale=30, size=(40, 8))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id bigint, v array<double>, y int")
    sent = []
    plain = neighbours._visits
    monkeypatch.setattr(neighbours, "_visits", lambda *args: (lambda f: sent.append(f.count()) or f)(plain(*args)))
    got = neighbours.same_class_neighbours(df, "id", "y", "v", 5, block_rows=100)
    assert got.count() == 5 * 4000
    assert sent[0] < 8 * 4000
    first = {r["id"]: r["neighbour"] for r in got.where("rank = 1 and id < 200").collect()}
    assert all(first[i] == np.argsort(((x - x[i]) ** 2).sum(axis=1))[1] for i in range(200))


def test_rebalance_reaches_the_target(spark):
    rng = np.random.default_rng(7)
    label = [0] * 60 + [1] * 9 + [2] * 1
    df = spark.createDataFrame([(i, rng.normal(size=2).tolist(), c) for i, c in enumerate(label)], "id int, v array<double>, y int")
    got = neighbours.rebalance(df, "id", "y", "v", 30)
    counts = {(r["y"], r["synthetic"]): r["count"] for r in got.groupBy("y", "synthetic").count().collect()}
    assert counts == {(0, False): 30, (1, False): 9, (1, True): 21, (2, False): 1, (2, True): 29}
    box = df.where("y = 1").agg(F.min(F.col("v")[0]), F.max(F.col("v")[0])).first()
    made = got.where("y = 1 and synthetic").agg(F.min(F.col("v")[0]), F.max(F.col("v")[0])).first()
    assert box[0] <= made[0] and made[1] <= box[1]
