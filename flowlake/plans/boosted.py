"""Boosting, federated rounds, early stops and search against the same work written in SQL.

With fixed bin edges and no sampling every number of a run is determined, so whole runs have SQL twins: gradients from
margins, histograms per node, best splits, leaves and new margins, one common table each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators import boost, metrics, model, rounds, score, search
from flowlake.operators.weights import balanced_sample_weights
from flowlake.plans.inputs import FLOW_CLASSES, FLOW_ID, FLOW_LABEL, flows
from flowlake.plans.registry import query, r6
from flowlake.sources.durable import durable, fresh_path

EDGES = {"l_quantity": [8.0, 16.0, 24.5, 33.0, 42.0], "l_discount": [0.02, 0.05, 0.08], "l_extendedprice": [15000.0, 25000.0, 40000.0, 60000.0]}
CLIENTS = 5


@dataclass(frozen=True)
class Run:
    """One training run as SQL knows it."""

    name: str = "a"
    rounds: int = 3
    depth: int = 2
    eta: float = 0.3
    # rows of one owner train together; without clients all rows have one
    clients: bool = False
    # local rounds per round
    local: int = 1
    # the client that trains in a round, if only one does
    cyclic: bool = False


_COUNT = "(case when {c} > {e} then 1 else 0 end)"


def _rows_sql() -> str:
    """Binned rows with a balanced weight inside each (client, part)."""
    bins = ", ".join(" + ".join(_COUNT.format(c=c, e=e) for e in edges) + f" as b{i}" for i, (c, edges) in enumerate(EDGES.items()))
    return f"""flow as materialized (
  select row_number() over () as id, {FLOW_LABEL} as label, cast(l_suppkey % {CLIENTS} as int) as client,
    substr(md5({FLOW_ID}), 1, 1) < '3' as held, {bins} from lineitem),
tally as (select client, held, label, count(*) as n from flow group by all),
share as (select client, held, label, sum(n) over (partition by client, held) / (count(*) over (partition by client, held) * n) as w from tally),
row_ as materialized (select flow.*, w from flow join share using (client, held, label)),
class as (select cast(i as int) as k from range({FLOW_CLASSES}) t(i))"""


def _grown_sql(run: Run, turn: int, before: str, who: str) -> str:
    """Trees of one turn from the margins ``before`` (id, k, z): split_* per level and all nodes' values."""
    at, owner = f"{run.name}_{turn}", "client" if run.clients else "0"
    parts = [
        f"""g_{at} as materialized (
  select id, {owner} as c, k, w * (p - case when label = k then 1.0 else 0.0 end) as g, w * greatest(2 * p * (1 - p), 1e-16) as h
  from (select id, k, exp(z - max(z) over (partition by id)) / sum(exp(z - m)) over (partition by id) as p
        from (select *, max(z) over (partition by id) as m from {before})) join row_ using (id)
  where not held and {who}),
n_{at}_1 as materialized (select id, c, k, 1 as node, g, h from g_{at})"""
    ]
    bin_of = "case s.feat " + " ".join(f"when {i} then b{i}" for i in range(len(EDGES))) + " end"
    for level in range(1, run.depth + 1):
        if level > 1:
            parts.append(
                f"""n_{at}_{level} as materialized (
  select n.id, n.c, n.k, n.node * 2 + case when {bin_of} <= s.bin then 0 else 1 end as node, n.g, n.h
  from n_{at}_{level - 1} n join s_{at}_{level - 1} s on s.c = n.c and s.k = n.k and s.node = n.node join row_ using (id))"""
            )
        cells = "\n  union all ".join(f"select c, k, node, {i} as feat, b{i} as bin, g, h from n_{at}_{level} join row_ using (id)" for i in range(len(EDGES)))
        parts.append(
            f"""h_{at}_{level} as materialized (select c, k, node, feat, bin, sum(g) as g, sum(h) as h from ({cells}) group by all),
s_{at}_{level} as materialized (
  select * exclude (rn) from (
    select *, row_number() over (partition by c, k, node order by gain desc, feat, bin) as rn from (
      select c, k, node, feat, bin, gl, hl, ga - gl as gr, ha - hl as hr,
        round(0.5 * (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)), 9) as gain
      from (select *, sum(g) over u as gl, sum(h) over u as hl, sum(g) over w as ga, sum(h) over w as ha from h_{at}_{level}
            window w as (partition by c, k, node, feat), u as (partition by c, k, node, feat order by bin))
      where hl >= 1 and ha - hl >= 1))
  where rn = 1 and gain > 0)"""
        )
    values = [f"select c, k, 1 as node, -{run.eta} * sum(g) / (sum(h) + 1) as v from g_{at} group by all"]
    for level in range(1, run.depth + 1):
        values += [f"select c, k, node * 2 + {side}, -{run.eta} * {g} / ({h} + 1) from s_{at}_{level}" for side, g, h in ((0, "gl", "hl"), (1, "gr", "hr"))]
    parts.append(f"v_{at} as materialized ({' union all '.join(values)})")
    return ",\n".join(parts)


def _applied_sql(run: Run, turn: int, own: bool) -> str:
    """Sum of the leaf values of a turn's trees per row and class: of its own client's trees, or of all."""
    at = f"{run.name}_{turn}"
    mine = " and c = client" if own and run.clients else ""
    parts = [f"w_{at}_0 as (select id, c, k, 1 as node from row_ join (select distinct c, k from v_{at}) on true{mine})"]
    bin_of = "case s.feat " + " ".join(f"when {i} then b{i}" for i in range(len(EDGES))) + " end"
    for level in range(1, run.depth + 1):
        parts.append(
            f"""w_{at}_{level} as (
  select a.id, a.c, a.k, case when s.bin is null then a.node else a.node * 2 + case when {bin_of} <= s.bin then 0 else 1 end end as node
  from w_{at}_{level - 1} a join row_ using (id) left join s_{at}_{level} s on s.c = a.c and s.k = a.k and s.node = a.node)"""
        )
    name = f"{'o' if own else 'd'}_{at}"
    parts.append(f"{name} as materialized (select id, k, sum(v) as v from w_{at}_{run.depth} join v_{at} using (c, k, node) group by all)")
    return ",\n".join(parts)


def _added(name: str, base: str, deltas: list[str]) -> str:
    every = " union all ".join([f"select id, k, z as v from {base}", *[f"select id, k, v from {d}" for d in deltas]])
    return f"{name} as materialized (select id, k, sum(v) as z from ({every}) group by all)"


def run_sql(run: Run) -> str:
    """Common tables of a run: z_<name>_<round> holds the shared margins after each round (0: before the first)."""
    parts = [f"z_{run.name}_0 as materialized (select id, k, 0.0::double as z from row_, class)"]
    for number in range(1, run.rounds + 1):
        base, current = f"z_{run.name}_{number - 1}", f"z_{run.name}_{number - 1}"
        turns = [(number - 1) * run.local + i for i in range(run.local)]
        who = f"client = {(number - 1) % CLIENTS}" if run.cyclic else "true"
        for i, turn in enumerate(turns):
            parts.append(_grown_sql(run, turn, current, who))
            if i < run.local - 1:
                parts.append(_applied_sql(run, turn, own=not run.cyclic))
                current = f"l_{run.name}_{turn}"
                parts.append(_added(current, base, [f"{'d' if run.cyclic else 'o'}_{run.name}_{t}" for t in turns[: i + 1]]))
        for i, turn in enumerate(turns):
            if not (run.cyclic and i < run.local - 1):
                # the walk of a turn whose own trees were applied before has its names taken
                parts.append(_applied_sql(replace(run, name=run.name), turn, own=False).replace(f"w_{run.name}_{turn}_", f"x_{run.name}_{turn}_"))
        parts.append(_added(f"z_{run.name}_{number}", base, [f"d_{run.name}_{t}" for t in turns]))
    return ",\n".join(parts)


def judged_sql(run: Run, number: int, margins: str | None = None) -> str:
    """Held-out rows after a round: (id, label, client, pred, loss)."""
    z = margins or f"z_{run.name}_{number}"
    return f"""select id, label, client, {number} as round, arg_max(k, d) as pred, ln(sum(exp(d))) - max(d) filter (k = label) as loss
  from (select id, label, client, k, z - max(z) over (partition by id) as d from {z} join row_ using (id) where held) group by all"""


def scores_sql(judged: str, by: str) -> str:
    """Loss, accuracy and support-weighted scores of judged rows per group."""
    return f"""select {by}, sum(n) as n, sum(loss) / sum(n) as mlogloss, sum(hit) / sum(n) as accuracy,
  sum(n * case when predicted > 0 then hit / predicted else 0 end) / sum(n) as precision, sum(hit) / sum(n) as recall,
  sum(n * case when n + predicted > 0 then 2 * hit / (n + predicted) else 0 end) / sum(n) as f1
from (select {by}, k, count(*) filter (label = k) as n, count(*) filter (pred = k) as predicted,
        count(*) filter (label = k and pred = k) as hit, coalesce(sum(loss) filter (label = k), 0) as loss
      from ({judged}), class group by {by}, k) group by {by}"""


def _with(*tables: str) -> str:
    return "with " + ",\n".join([_rows_sql(), *tables]) + "\n"


# ---- the Spark side ------------------------------------------------------------------------


def rows(spark, folder) -> DataFrame:
    return balanced_sample_weights(flows(spark, folder), "label", by=["client", "held_out"])


def prepared(spark, folder, **more) -> boost.BoostData:
    names = list(EDGES)
    return boost.prepare(
        rows(spark, folder), names, "label", FLOW_CLASSES, "flow_id", weight="weight",
        validation=F.col("held_out"), edges=[EDGES[n] for n in names], **more,
    )


def params(run: Run) -> boost.BoostParams:
    return boost.BoostParams(eta=run.eta, max_depth=run.depth, rounds=run.rounds, subsample=1.0, colsample_bytree=1.0)


RUN = Run()


def nodes_sql(run: Run, turns: list[int]) -> str:
    """Node table of a run without clients, as (turn, class, node, feat, bin, gain, leaf)."""
    parts = []
    for turn in turns:
        at = f"{run.name}_{turn}"
        splits = " union all ".join(f"select k, node, feat, bin, gain from s_{at}_{level}" for level in range(1, run.depth + 1))
        parts.append(f"select {turn} as turn, k as class, node, feat, bin, gain, null::double as leaf from ({splits})")
        parts.append(f"select {turn}, v.k, v.node, null, null, null, v.v from v_{at} v anti join ({splits}) s on s.k = v.k and s.node = v.node")
    return f"""select cast(turn as int) as turn, class, cast(node as bigint) as node, cast(feat as int) as feat, cast(bin as int) as bin,
  round(gain, 4) as gain, round(leaf, 6) as leaf from ({' union all '.join(parts)})"""


def _nodes(frame: DataFrame) -> DataFrame:
    return frame.select("turn", "class", "node", "feat", "bin", F.round("gain", 4).alias("gain"), r6("leaf").alias("leaf"))


@query("boost_nodes", _with(run_sql(RUN)) + nodes_sql(RUN, [0, 1, 2]))
def boost_nodes(spark, folder):
    """Every node of a weighted run of several rounds, saved and loaded again."""
    fitted, _ = boost.fit(prepared(spark, folder), params(RUN))
    path = fresh_path(spark, "model")
    fitted.save(spark, path)
    return _nodes(boost.model_frame(spark, model.BoostModel.load(spark, path)))


_ALL_ROUNDS = " union all ".join(judged_sql(RUN, n) for n in (1, 2, 3))
_SCORES = ("mlogloss", "accuracy", "precision", "recall", "f1")
_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in _SCORES)


@query("boost_losses", _with(run_sql(RUN)) + f"select cast(round - 1 as int) as round, round(mlogloss, 6) as mlogloss, round(accuracy, 6) as accuracy, round(f1, 6) as f1 from ({scores_sql(_ALL_ROUNDS, 'round')})")
def boost_losses(spark, folder):
    """Validation loss and scores after each round."""
    _, history = boost.fit(prepared(spark, folder), params(RUN), patience=10)
    found = [(h["round"], h["mlogloss"], h["accuracy"], h["f1"]) for h in history]
    table = spark.createDataFrame(found, "round int, mlogloss double, accuracy double, f1 double")
    return table.select("round", *[r6(c).alias(c) for c in ("mlogloss", "accuracy", "f1")])


@query("boost_continued", _with(run_sql(RUN)) + nodes_sql(RUN, [2]))
def boost_continued(spark, folder):
    """Two rounds, then one on top of them: the last turn is that of a run of three."""
    first, _ = boost.fit(prepared(spark, folder), params(replace(RUN, rounds=2)))
    grown, _ = boost.fit(prepared(spark, folder, start=first), params(replace(RUN, rounds=1)), start=first)
    return _nodes(boost.model_frame(spark, grown.last_turns(1)))


_JUDGED = judged_sql(RUN, 3)


@query("boost_scored", _with(run_sql(RUN)) + f"select label, cast(pred as int) as predicted_label, count(*) as n, round(sum(exp(-loss)), 4) as p_true from ({_JUDGED}) group by all")
def boost_scored(spark, folder):
    """Predictions of the held-out rows from raw features: counts and summed probability of the truth."""
    fitted, _ = boost.fit(prepared(spark, folder), params(RUN))
    scored = score.score_table(flows(spark, folder).where("held_out"), fitted, "label")
    return scored.groupBy(F.col("true_label").alias("label"), "predicted_label").agg(
        F.count("*").alias("n"), F.round(F.sum(F.get("probs", F.col("true_label"))), 4).alias("p_true")
    )


@query(
    "boost_top_features",
    _with(run_sql(RUN))
    + f"select list_extract({list(EDGES)}, feat + 1) as feature, count(*) as n_splits, round(sum(gain), 3) as gain, {RUN.rounds * FLOW_CLASSES} as n_trees from ("
    + nodes_sql(RUN, [0, 1, 2])
    + ") where feat is not null group by feat",
)
def boost_top_features(spark, folder):
    """Features of the model by how often they split."""
    fitted, _ = boost.fit(prepared(spark, folder), params(RUN))
    nodes = _nodes(boost.model_frame(spark, fitted)).withColumns({c: F.lit(0) for c in ("track", "client")})
    return model.top_features(nodes, fitted.features).withColumn("gain", F.round("gain", 3))


@query("evaluation_by_round", _with(run_sql(RUN)) + f"select cast(round as int) as round, n, {_ROUNDED} from ({scores_sql(_ALL_ROUNDS, 'round')})")
def evaluation_by_round(spark, folder):
    """Central evaluation after each turn, margins carried through one pass."""
    fitted, _ = boost.fit(prepared(spark, folder), params(RUN))
    tables = score.evaluate_rounds(flows(spark, folder).where("held_out"), fitted, "label")
    joined = tables["summary"].join(tables["log_loss"].select("round", F.col("log_loss").alias("mlogloss")), "round")
    return joined.select("round", F.col("n").cast("bigint").alias("n"), *[r6(c).alias(c) for c in _SCORES])


# ---- federated ------------------------------------------------------------------------------

BAGGED = Run("f", rounds=2, clients=True, local=2)
CYCLED = Run("y", rounds=3, clients=True, local=2, cyclic=True)


def _history_sql(run: Run) -> str:
    every = " union all ".join(judged_sql(run, n) for n in range(1, run.rounds + 1))
    mean = ", ".join(f"sum(n * {c}) / sum(n) as {c}" for c in _SCORES)
    return f""", judged as materialized ({every}),
own as (select 'client_' || client as source, round, n, {', '.join(_SCORES)} from ({scores_sql('select * from judged', 'round, client')})),
central as (select 'central' as source, round, n, {', '.join(_SCORES)} from ({scores_sql('select * from judged', 'round')})),
wide as (select * from own union all select * from central union all select 'distributed', round, sum(n), {mean} from own group by round)
select source, cast(round as int) as round, metric, round(value, 6) as value
from (unpivot (select source, round, {', '.join(_SCORES)} from wide) on {', '.join(_SCORES)} into name metric value value)"""


def _federated(spark, folder, run: Run, mode: str, **more):
    return rounds.federated_rounds(prepared(spark, folder, client="client"), params(run), CLIENTS, run.rounds, mode, run.local, **more)


@query("federated_bagging_history", _with(run_sql(BAGGED)) + _history_sql(BAGGED))
def federated_bagging_history(spark, folder):
    """Two rounds of five clients with two local rounds each, weights balanced inside each client."""
    return _federated(spark, folder, BAGGED, "bagging")[1].withColumn("value", r6("value"))


@query("federated_cyclic_history", _with(run_sql(CYCLED)) + _history_sql(CYCLED))
def federated_cyclic_history(spark, folder):
    return _federated(spark, folder, CYCLED, "cyclic")[1].withColumn("value", r6("value"))


# a step so long that some clients' own losses rise again
STOPPED = Run("e", rounds=1, clients=True, local=5, eta=1.7)
_STOP_AFTER = 1


def _early_sql(run: Run) -> str:
    """Own loss of every client after each local round, up to the round that ends its patience."""
    own = []
    for turn in range(run.local):
        margins = f"l_{run.name}_{turn}"
        own.append(f"select client, {turn} as turn, loss from ({judged_sql(run, turn, margins)})")
    return f""", {_applied_sql(run, run.local - 1, own=True)},
{_added(f"l_{run.name}_{run.local - 1}", f"z_{run.name}_0", [f"o_{run.name}_{t}" for t in range(run.local)])},
losses as (select client, turn, avg(loss) as loss from ({' union all '.join(own)}) group by all),
best as (select *, min(loss) over (partition by client order by turn rows between unbounded preceding and 1 preceding) as before from losses),
since as (select *, turn - max(case when before is null or loss < before then turn end) over (partition by client order by turn) as stale from best),
ended as (select *, coalesce(max(case when stale >= {_STOP_AFTER} then 1 else 0 end) over (partition by client order by turn rows between unbounded preceding and 1 preceding), 0) as over_ from since)
select client, cast(turn as int) as turn, round(loss, 6) as loss, stale >= {_STOP_AFTER} as stopped from ended where over_ = 0"""


@query("local_early_stop", _with(run_sql(STOPPED)) + _early_sql(STOPPED))
def local_early_stop(spark, folder):
    """Each client's own validation loss per local round; a client whose loss rises stops, the others go on."""
    trainer = boost.Trainer(prepared(spark, folder, client="client"), {0: params(STOPPED)})
    trainer.round(range(CLIENTS), STOPPED.local, patience=_STOP_AFTER)
    table = spark.createDataFrame([(c, turn, loss) for turn, _, c, loss in trainer.local_losses], "client int, turn int, loss double")
    from flowlake.operators.convergence import early_stop

    stops = early_stop(table.withColumnRenamed("turn", "round"), ["client"], patience=_STOP_AFTER)
    return stops.select("client", F.col("round").alias("turn"), r6("loss").alias("loss"), F.col("stop").alias("stopped"))


@query(
    "sample_weights_by_client",
    """with f as (select l_suppkey % 5 as client, l_linenumber as k, l_orderkey, l_partkey from lineitem),
c as (select client, k, count(*) as n from f group by all),
w as (select client, k, sum(n) over (partition by client) / (count(*) over (partition by client) * n) as weight from c)
select cast(client as int) as client, l_orderkey, l_partkey, k as l_linenumber, round(weight, 9) as weight from f join w using (client, k)""",
)
def sample_weights_by_client(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    kept = lines.select((F.col("l_suppkey") % 5).cast("int").alias("client"), "l_orderkey", "l_partkey", "l_linenumber")
    return balanced_sample_weights(kept, "l_linenumber", by=["client"]).withColumn("weight", F.round("weight", 9))


# ---- search ---------------------------------------------------------------------------------

# three live trials and two that fail: one by its parameters, one by its numbers
TRIALS = [Run(f"t{i}", rounds=n, eta=eta, depth=depth) for i, (eta, depth, n) in enumerate([(0.5, 2, 3), (0.3, 2, 2), (0.02, 1, 3)])]
_GRACE = 2


def _trials_sql() -> str:
    found = []
    for i, run in enumerate(TRIALS):
        for number in range(1, run.rounds + 1):
            found.append(f"select {i} as trial, {number} as round, * exclude (round) from ({scores_sql(judged_sql(run, number), 'round')})")
    last = {i: run.rounds for i, run in enumerate(TRIALS)}
    ends = " ".join(f"when {i} then {n}" for i, n in last.items())
    return f""", report as materialized ({' union all '.join(found)}),
rung as (select trial, row_number() over (order by f1 desc, trial) as place, count(*) over () as running from report where round = {_GRACE}),
kept as (select trial, case when place <= greatest(1, running // 2) then case trial {ends} end else {_GRACE} end as rounds from rung)
select r.trial, cast(k.rounds as int) as rounds, round(f1, 6) as objective, round(mlogloss, 6) as mlogloss, round(accuracy, 6) as accuracy, round(f1, 6) as f1
from report r join kept k on k.trial = r.trial and k.rounds = r.round
union all select 3, 0, 0, 'infinity'::double, 0, 0 union all select 4, 1, 0, 'infinity'::double, 0, 0"""


@query("search_halving", _with(*[run_sql(run) for run in TRIALS]) + _trials_sql())
def search_halving(spark, folder):
    """Five trials of which two fail: the failed score 0, the better half goes on past the rung."""
    trials = {i: params(run) for i, run in enumerate(TRIALS)}
    trials[3] = replace(trials[0], subsample=0.0)
    trials[4] = replace(trials[0], eta=1.7e308)
    found = search.successive_halving(prepared(spark, folder, tracks=len(trials)), trials, grace=_GRACE)
    return found.select("trial", "rounds", *[r6(c).alias(c) for c in ("objective", "mlogloss", "accuracy", "f1")])
