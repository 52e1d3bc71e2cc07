"""Training, search, scoring and rebalancing queries over line items and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import boost, metrics, mlp, model, neighbours, rounds, score, search
from flowlake.plans.inputs import FLOW_CLASSES, FLOW_FEATURES, FLOW_LABEL, flows
from flowlake.plans.registry import query, r6, table
from flowlake.sources.durable import fresh_path

# ---- rebalancing ---------------------------------------------------------------------------

_NEAR_SQL = """with cell as (select vec_id, label, unnest(range(64)) as pos, unnest(embedding)::double as v from embeddings),
gap as (
  select a.vec_id as id, b.vec_id as neighbour, sqrt(sum((a.v - b.v) * (a.v - b.v))) as distance
  from cell a join cell b on a.label = b.label and a.pos = b.pos and a.vec_id <> b.vec_id group by 1, 2),
near as (select *, row_number() over (partition by id order by distance, neighbour) as rank from gap)
"""


@query("same_class_neighbours", _NEAR_SQL + "select id, cast(rank as int) as rank, neighbour, round(distance, 6) as distance from near where rank <= 5")
def same_class_neighbours(spark, folder):
    near = neighbours.same_class_neighbours(table(spark, folder, "embeddings"), "vec_id", "label", "embedding")
    return near.select("id", "rank", "neighbour", r6("distance").alias("distance"))


_SMOTE_SQL = (
    _NEAR_SQL
    + """, counts as (select label, count(*) as n from embeddings group by label),
target as (select max(n) as t from counts),
seat as (
  select e.vec_id, e.label, c.n, t - c.n as extra, row_number() over (partition by e.label order by md5(cast(e.vec_id as varchar)), e.vec_id) - 1 as seat
  from embeddings e join counts c on c.label = e.label, target where c.n < t),
dealt as (select *, cast(floor(extra / n) as bigint) + case when seat < extra % n then 1 else 0 end as copies from seat),
made as (
  select vec_id as seed, label, unnest(range(cast(copies as bigint))) as copy, least(n - 1, 5) as k from dealt),
drawn as (
  select *, cast(floor(('0x' || substr(md5('near|' || cast(seed as varchar) || '|' || cast(copy as varchar)), 1, 8))::bigint / 4294967296.0 * k) as int) + 1 as pick,
         ('0x' || substr(md5('step|' || cast(seed as varchar) || '|' || cast(copy as varchar)), 1, 8))::bigint / 4294967296.0 as step
  from made)
"""
)


@query(
    "smote_rows",
    _SMOTE_SQL
    + """select d.seed, cast(d.copy as int) as copy, d.label, round(sum(a.v + d.step * (b.v - a.v)), 4) as total, round(max(a.v + d.step * (b.v - a.v)), 4) as top
from drawn d join near on near.id = d.seed and near.rank = d.pick
join cell a on a.vec_id = d.seed join cell b on b.vec_id = near.neighbour and b.pos = a.pos
group by d.seed, d.copy, d.label""",
)
def smote_rows(spark, folder):
    vectors = table(spark, folder, "embeddings")
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0]
    made = neighbours.smote(vectors, "vec_id", "label", "embedding", largest)
    return made.select(
        "seed",
        "copy",
        "label",
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
        F.round(F.array_max("embedding"), 4).alias("top"),
    )


@query(
    "rebalance_classes",
    """with c as (select label, count(*) as n from embeddings group by 1), t as (select cast(floor(avg(n)) as bigint) as goal from c)
select label, least(n, goal) as n_kept, greatest(goal - n, 0) as n_made from c, t""",
)
def rebalance_classes(spark, folder):
    vectors = table(spark, folder, "embeddings")
    goal = int(vectors.groupBy("label").count().agg(F.floor(F.avg("count"))).first()[0])
    even = neighbours.rebalance(vectors, "vec_id", "label", "embedding", goal)
    return even.groupBy("label").agg(
        F.count_if(~F.col("synthetic")).alias("n_kept"), F.count_if("synthetic").alias("n_made")
    )


# ---- boosted trees -------------------------------------------------------------------------

_EDGES = {"l_quantity": [10.0, 20.0, 24.5, 30.0, 40.0], "l_discount": [0.02, 0.05, 0.08], "l_linenumber": [1.0, 3.0, 5.0]}


def _stump_sql() -> str:
    bins = "\nunion all\n".join(
        f"select label, {i} as feat, " + " + ".join(f"(case when {c} > {e} then 1 else 0 end)" for e in edges) + " as bin from f"
        for i, (c, edges) in enumerate(_EDGES.items())
    )
    return f"""with f as (select *, {FLOW_LABEL} as label from lineitem),
b as ({bins}),
k as (select cast(i as int) as k from range(5) t(i)),
cell as (select k, feat, bin, sum(0.2 - case when label = k then 1.0 else 0.0 end)::double as g, sum(0.32)::double as h from b, k group by all),
pre as (
  select k, feat, bin, sum(g) over u as gl, sum(h) over u as hl, sum(g) over w as ga, sum(h) over w as ha from cell
  window w as (partition by k, feat), u as (partition by k, feat order by bin)),
scored as (
  select *, round(0.5 * (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)), 9) as gain
  from pre where hl >= 1 and ha - hl >= 1),
best as (select *, row_number() over (partition by k order by gain desc, feat, bin) as rn from scored)
select k as class, feat, bin, round(gain, 4) as gain, round(-0.3 * gl / (hl + 1), 6) as left_leaf, round(-0.3 * (ga - gl) / (ha - hl + 1), 6) as right_leaf
from best where rn = 1"""


@query("boost_stump", _stump_sql())
def boost_stump(spark, folder):
    """First round, one level: the chosen split and leaves of every class."""
    names = list(_EDGES)
    data = boost.prepare(
        flows(spark, folder), names, "label", FLOW_CLASSES, "flow_id", edges=[_EDGES[n] for n in names]
    )
    params = boost.BoostParams(eta=0.3, max_depth=1, subsample=1.0, colsample_bytree=1.0, rounds=1)
    nodes = boost.model_frame(spark, boost.fit(data, params)[0])
    tree = nodes.groupBy("class")
    return tree.agg(
        F.max("feat").alias("feat"),
        F.max("bin").alias("bin"),
        F.round(F.max("gain"), 4).alias("gain"),
        r6(F.max(F.when(F.col("node") == 2, F.col("leaf")))).alias("left_leaf"),
        r6(F.max(F.when(F.col("node") == 3, F.col("leaf")))).alias("right_leaf"),
    )


_PARAMS = boost.BoostParams(eta=0.3, max_depth=3, rounds=3)


def _prepared(spark, folder, **more):
    df = flows(spark, folder)
    return df, boost.prepare(
        df, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", client="client", validation=F.col("held_out"), **more
    )


def _single(spark, folder, params=_PARAMS, **kwargs):
    df = flows(spark, folder)
    data = boost.prepare(df, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"))
    fitted, history = boost.fit(data, params, **kwargs)
    return df, data, fitted, history


@query("boost_fit_history")
def boost_fit_history(spark, folder):
    """Validation loss and scores per round, with class-balanced weights and early stopping."""
    from flowlake.operators.weights import balanced_sample_weights

    df = balanced_sample_weights(flows(spark, folder), "label")
    data = boost.prepare(
        df, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", weight="weight", validation=F.col("held_out")
    )
    _, history = boost.fit(data, _PARAMS, patience=10)
    rows = [(h["round"], h["mlogloss"], h["accuracy"], h["f1"]) for h in history]
    return spark.createDataFrame(rows, "round int, mlogloss double, accuracy double, f1 double")


@query("boost_predict")
def boost_predict(spark, folder):
    df, _, fitted, _ = _single(spark, folder)
    scored = score.score_table(df, fitted, "label")
    return metrics.summary(metrics.confusion(scored, "true_label", "predicted_label", FLOW_CLASSES))


@query("boost_warm_start")
def boost_warm_start(spark, folder):
    """Two rounds, then one more on top of them: tree counts per turn."""
    from dataclasses import replace

    df, data, fitted, _ = _single(spark, folder, replace(_PARAMS, rounds=2))
    more = boost.prepare(df, FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", start=fitted, edges=data.edges)
    grown, _ = boost.fit(more, replace(_PARAMS, rounds=1), start=fitted)
    return boost.model_frame(spark, grown).groupBy("turn").agg(F.count_distinct("class").alias("n_trees"))


@query("boost_last_turns")
def boost_last_turns(spark, folder):
    _, _, fitted, _ = _single(spark, folder)
    return boost.model_frame(spark, fitted.last_turns(1)).select("turn", "class", "node", "feat", "threshold", "leaf")


@query("boost_model_info")
def boost_model_info(spark, folder):
    """Saved, loaded again and summarised: split counts per feature."""
    _, _, fitted, _ = _single(spark, folder)
    path = fresh_path(spark, "model")
    fitted.save(spark, path)
    again = model.BoostModel.load(spark, path)
    return model.top_features(boost.model_frame(spark, again), again.features)


@query("score_unlabelled")
def score_unlabelled(spark, folder):
    df, _, fitted, _ = _single(spark, folder)
    scored = score.score_table(df.drop("label"), fitted, keep=["flow_id"])
    return scored.select("flow_id", "predicted_label", "prediction_type", "prediction_score")


@query("central_evaluation")
def central_evaluation(spark, folder):
    """Scores of the model after each of its turns, over the held-out rows."""
    df, _, fitted, _ = _single(spark, folder)
    tables = score.evaluate_rounds(df.where("held_out"), fitted, "label")
    return tables["summary"].join(tables["log_loss"].drop("n"), "round")


@query("federated_bagging")
def federated_bagging(spark, folder):
    _, data = _prepared(spark, folder)
    return rounds.federated_rounds(data, _PARAMS, 5, 2, "bagging")[1]


@query("federated_cyclic")
def federated_cyclic(spark, folder):
    _, data = _prepared(spark, folder)
    return rounds.federated_rounds(data, _PARAMS, 5, 3, "cyclic")[1]


_NARROW_SPACE = {
    **search.SEARCH_SPACE,
    "eta": ("loguniform", 0.1, 0.5),
    "max_depth": ("randint", 2, 4),
    "num_boost_round": ("randint", 2, 5),
    "reg_alpha": ("loguniform", 1e-10, 1.0),
    "reg_lambda": ("loguniform", 1e-3, 10.0),
    "max_leaves": ("randint", 4, 8),
}


def _searched(spark, folder):
    trials = search.trial_params(search.sample_trials(spark, 4, space=_NARROW_SPACE))
    data = boost.prepare(
        flows(spark, folder), FLOW_FEATURES, "label", FLOW_CLASSES, "flow_id", validation=F.col("held_out"),
        tracks=len(trials),
    )
    return data, trials, search.successive_halving(data, trials, grace=1, factor=2)


@query("search_trials")
def search_trials(spark, folder):
    return _searched(spark, folder)[2]


@query("search_best_refit")
def search_best_refit(spark, folder):
    data, trials, results = _searched(spark, folder)
    fitted = search.refit_best(data, trials, results)
    best = search.best_trial(results)
    return best.withColumn("n_trees", F.lit(len(fitted.trees)))


@query(
    "best_trial",
    """with t as (select l_suppkey as trial, avg(l_quantity) as objective from lineitem group by 1)
select round(max(objective), 6) as objective, (select trial from t order by objective desc, trial limit 1) as trial from t""",
)
def best_trial(spark, folder):
    results = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg(
        F.avg("l_quantity").alias("objective")
    )
    return search.best_trial(results).withColumn("objective", r6("objective"))


# ---- perceptron ----------------------------------------------------------------------------


@query(
    "mlp_gradient",
    """with cell as (select label, unnest(range(64)) as j, unnest(embedding)::double as v from embeddings),
k as (select cast(i as int) as k from range(10) t(i)),
total as (select count(*) as n from embeddings),
w as (select cast(j * 10 + k as int) as pos, round(sum(v * (0.1 - case when label = k then 1.0 else 0.0 end)) / max(n), 6) as value from cell, k, total group by j, k),
b as (select cast(640 + k as int) as pos, round(sum(0.1 - case when label = k then 1.0 else 0.0 end) / max(n), 6) as value from embeddings, k, total group by k)
select * from w union all select * from b""",
)
def mlp_gradient(spark, folder):
    """Gradient of a network without hidden layers at zero weights."""
    import numpy as np

    spec = mlp.MlpSpec(64, 10, hidden=())
    rows = mlp.prepare_rows(table(spark, folder, "embeddings"), "embedding", "label")
    gradient = mlp.gradient_step(rows, {0: np.zeros(650)}, spec)[0][0]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(gradient)], "pos int, value double").select(
        "pos", r6("value").alias("value")
    )


def _fixed_weights() -> tuple[str, list[float]]:
    """Weights of a network without hidden layers: SQL in j and k, and the same numbers."""
    values = [((j * 7 + k * 3) % 11 - 5) * 0.4 for j in range(64) for k in range(10)] + [((k * 5) % 7 - 3) * 0.1 for k in range(10)]
    return "case when j < 64 then ((j * 7 + k * 3) % 11 - 5) * 0.4 else ((k * 5) % 7 - 3) * 0.1 end", values


_FIXED = f"""with cell as (select vec_id, label, unnest(range(64)) as j, unnest(embedding)::double as v from embeddings
  union all select vec_id, label, 64, 1.0 from embeddings),
k as (select cast(i as int) as k from range(10) t(i)),
z as (select vec_id, label, k, sum(v * ({_fixed_weights()[0]})) as z from cell, k group by all),
d as (select *, z - max(z) over (partition by vec_id) as d from z),
p as (select *, exp(d) / sum(exp(d)) over (partition by vec_id) as p from d),
row_ as (select vec_id, label, vec_id % 3 as client, arg_max(k, d) as pred, ln(sum(exp(d))) - max(d) filter (k = label) as loss from d group by all)
"""
_SCORES_OF = """select {client} as client, sum(n) as n, round(sum(loss) / sum(n), 6) as loss, round(sum(hit) / sum(n), 6) as accuracy,
  round(sum(n * case when predicted > 0 then hit / predicted else 0 end) / sum(n), 6) as precision, round(sum(hit) / sum(n), 6) as recall,
  round(sum(n * case when n + predicted > 0 then 2 * hit / (n + predicted) else 0 end) / sum(n), 6) as f1
from (select {client} as client, k, count(*) filter (label = k) as n, count(*) filter (pred = k) as predicted,
        count(*) filter (label = k and pred = k) as hit, coalesce(sum(loss) filter (label = k), 0) as loss from row_, k group by 1, 2) group by 1"""


def _vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn("client", (F.col("vec_id") % 3).cast("int"))
    return mlp.prepare_rows(vectors, "embedding", "label", client="client", classes=10)


@query(
    "mlp_evaluation",
    _FIXED + _SCORES_OF.format(client="'client_' || client").replace("select 'client_' || client as client, sum", "select client, sum", 1)
    + " union all " + _SCORES_OF.format(client="'all'").replace("select 'all' as client, sum", "select client, sum", 1),
)
def mlp_evaluation(spark, folder):
    """Loss and scores of a network with given weights, per client and together."""
    import numpy as np

    found = mlp.evaluate_mlp(_vectors(spark, folder), np.array(_fixed_weights()[1]), mlp.MlpSpec(64, 10, hidden=()))
    rows = [(name, s["n"], *[float(s[m]) for m in mlp.METRICS]) for name, s in found.items()]
    scored = spark.createDataFrame(rows, "client string, n bigint, " + ", ".join(f"{m} double" for m in mlp.METRICS))
    return scored.select("client", "n", *[r6(m).alias(m) for m in mlp.METRICS])


@query(
    "mlp_federated_step",
    """with cell as (select label, unnest(range(64)) as j, unnest(embedding)::double as v from embeddings
  union all select label, 64, 1.0 from embeddings),
k as (select cast(i as int) as k from range(10) t(i)),
total as (select count(*) as n from embeddings)
select cast(j * 10 + k as int) as pos, round(w0 - 0.5 * g, 6) as value
from (select j, k, sum(v * (0.1 - case when label = k then 1.0 else 0.0 end)) / max(n) as g, 0.0 as w0 from cell, k, total group by j, k)""",
)
def mlp_federated_step(spark, folder):
    """One round of three clients with one gradient step each: the mean of their weights."""
    import numpy as np

    spec = mlp.MlpSpec(64, 10, hidden=(), rate=0.5, optimizer="sgd")
    flat, _ = mlp.federated_average(_vectors(spark, folder), spec, range(3), rounds=1, batch_rows=None, start=np.zeros(650))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(flat)], "pos int, value double").select("pos", r6("value").alias("value"))


def _network_rows(spark, folder):
    from flowlake.operators.features import fit_scale, scale

    df = flows(spark, folder)
    scaled = scale(df, fit_scale(df.where("not held_out"), FLOW_FEATURES))
    return scaled.select("flow_id", "label", "client", "held_out", F.array(*FLOW_FEATURES).alias("x"))


@query("mlp_fit_history")
def mlp_fit_history(spark, folder):
    """Focal-loss training with validation and patience."""
    rows = _network_rows(spark, folder)
    spec = mlp.MlpSpec(len(FLOW_FEATURES), FLOW_CLASSES, (16,), loss="focal", rate=0.05)
    train = mlp.prepare_rows(rows.where("not held_out"), "x", "label", classes=FLOW_CLASSES)
    held = mlp.prepare_rows(rows.where("held_out"), "x", "label", classes=FLOW_CLASSES)
    _, history = mlp.fit_mlp(train, spec, epochs=20, validation=held, patience=3)
    names = [f"{side}_{m}" for side in ("train", "val") for m in mlp.METRICS]
    return spark.createDataFrame(
        [(h["epoch"], *[float(h[n]) for n in names]) for h in history], "epoch int, " + ", ".join(f"{n} double" for n in names)
    )


@query("mlp_federated")
def mlp_federated(spark, folder):
    """FedAvg over five clients; the averaged network's scores on the held-out rows."""
    rows = _network_rows(spark, folder)
    spec = mlp.MlpSpec(len(FLOW_FEATURES), FLOW_CLASSES, (16,), rate=0.05)
    train = mlp.prepare_rows(rows.where("not held_out"), "x", "label", client="client", classes=FLOW_CLASSES)
    flat, _ = mlp.federated_average(train, spec, range(5), rounds=3, local_steps=2)
    scored = score.decide(mlp.predict_mlp(rows.where("held_out"), "x", flat, spec), "probs")
    return metrics.summary(metrics.confusion(scored, "label", "predicted_label", FLOW_CLASSES))


@query("mlp_pipeline")
def mlp_pipeline(spark, folder):
    """Standardise, fit and evaluate with Spark's own perceptron."""
    df = flows(spark, folder)
    fitted = mlp.pipeline_mlp(df.where("not held_out"), FLOW_FEATURES, "label", [8], FLOW_CLASSES, steps=20)
    scored = fitted.transform(df.where("held_out"))
    return metrics.summary(metrics.confusion(scored, "label", "pred", FLOW_CLASSES))
