"""Evaluation, class-weight and client-aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import scores as S
from flowlake.operators import convergence, curves, encode, federate, metrics, weights
from flowlake.plans.inputs import CLASSES, ROUNDS_SQL, SCORED_SQL, classified_events, scored_vectors
from flowlake.plans.registry import query, r9, table

_GRID = """, grid as (select cast(t.i as int) as t, cast(p.i as int) as p from range(10) t(i), range(10) p(i)),
cells as (select g.t as true_class, g.p as pred_class, count(pred.vec_id) as n
  from grid g left join pred on pred.label = g.t and pred.pred = g.p group by g.t, g.p),
cls as (
  select k, cast(support as bigint) as support, case when predicted > 0 then hit / predicted else 0 end as "precision",
         case when support > 0 then hit / support else 0 end as recall,
         case when support + predicted > 0 then 2 * hit / (support + predicted) else 0 end as f1, predicted
  from (select cast(r.k as int) as k, sum(n) filter (true_class = k) as support, sum(n) filter (pred_class = k) as predicted,
               sum(n) filter (true_class = k and pred_class = k) as hit from cells, range(10) r(k) group by 1))
"""


def _cells(spark, folder):
    return metrics.confusion(scored_vectors(spark, folder), "label", "pred", CLASSES)


@query("confusion_matrix", SCORED_SQL + _GRID + "select * from cells")
def confusion_matrix(spark, folder):
    return _cells(spark, folder)


@query(
    "weighted_scores",
    SCORED_SQL
    + _GRID
    + """select round(sum("precision" * support) / sum(support), 9) as "precision", round(sum(recall * support) / sum(support), 9) as recall,
  round(sum(f1 * support) / sum(support), 9) as f1, (select round(avg(case when pred = label then 1.0 else 0.0 end), 9) from pred) as accuracy,
  (select round(avg(case when pred = label then 0.0 else 1.0 end), 9) from pred) as error_rate, cast(sum(support) as bigint) as n from cls""",
)
def weighted_scores(spark, folder):
    got = metrics.summary(_cells(spark, folder))
    return got.select(*[r9(c).alias(c) for c in ("precision", "recall", "f1", "accuracy", "error_rate")], "n")


@query(
    "class_scores",
    SCORED_SQL + _GRID + 'select k as class, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1, support from cls',
)
def class_scores(spark, folder):
    got = metrics.per_class(_cells(spark, folder))
    return got.select("class", r9("precision").alias("precision"), r9("recall").alias("recall"), r9("f1").alias("f1"), "support")


@query(
    "classification_report",
    SCORED_SQL
    + _GRID
    + """, used as (select * from cls where support > 0 or predicted > 0)
select cast(k as varchar) as row, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1, support from used
union all select 'macro avg', round(avg("precision"), 9), round(avg(recall), 9), round(avg(f1), 9), cast(sum(support) as bigint) from used
union all select 'weighted avg', round(sum("precision" * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1 * support) / sum(support), 9), cast(sum(support) as bigint) from used""",
)
def classification_report(spark, folder):
    got = metrics.report(_cells(spark, folder))
    return got.select("row", r9("precision").alias("precision"), r9("recall").alias("recall"), r9("f1").alias("f1"), "support")


@query(
    "log_loss",
    SCORED_SQL
    + "select round(avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 9) as log_loss, count(*) as n from prob where k = label",
)
def log_loss(spark, folder):
    return metrics.log_loss(scored_vectors(spark, folder), "probs", "label", CLASSES).withColumn("log_loss", r9("log_loss"))


@query(
    "hard_log_loss",
    SCORED_SQL + "select round(avg(-ln(case when pred = label then 1 - 1e-15 else 1e-15 end)), 9) as log_loss from pred",
)
def hard_log_loss(spark, folder):
    return metrics.hard_log_loss(scored_vectors(spark, folder), "pred", "label").withColumn("log_loss", r9("log_loss"))


@query(
    "pseudo_probabilities",
    SCORED_SQL
    + """, shifted as (select vec_id, pred * 2 - 5 as pred from pred)
select vec_id, round(case when pred not between 0 and 9 then 0.1 else 0.9 end, 9) as top,
  round(case when pred not between 0 and 9 then 0.1 else 0.1 / 9 end, 9) as low, 10 as width from shifted""",
)
def pseudo_probabilities(spark, folder):
    hard = scored_vectors(spark, folder).select("vec_id", (F.col("pred") * 2 - 5).alias("pred"))
    p = hard.withColumn("probs", S.pseudo_probabilities("pred", CLASSES))
    return p.select(
        "vec_id", r9(F.array_max("probs")).alias("top"), r9(F.array_min("probs")).alias("low"), F.size("probs").alias("width")
    )


_CURVE_SQL = """, counted as (
  select k as class, round(p, 6) as score, sum(case when label = k then 1 else 0 end) as pos, count(*) as rows from prob group by 1, 2),
c as (
  select class, score, pos, rows, sum(pos) over w as cp, sum(rows) over w as cr,
         sum(pos) over (partition by class) as ap, sum(rows) over (partition by class) as ar
  from counted window w as (partition by class order by score desc)),
steps as (
  select *, coalesce(lag(cp) over w, 0) as bp, coalesce(lag(cr) over w, 0) as br from c window w as (partition by class order by score desc))
"""


def _counts(spark, folder):
    rounded = scored_vectors(spark, folder).withColumn("probs", F.transform("probs", lambda p: F.round(p, 6)))
    return curves.threshold_counts(rounded, "probs", "label", CLASSES)


@query(
    "roc_points",
    SCORED_SQL + _CURVE_SQL + "select class, score, round((cr - cp) / (ar - ap), 9) as fpr, round(cp / ap, 9) as tpr from c",
)
def roc_points(spark, folder):
    got = curves.roc_points(_counts(spark, folder))
    return got.select("class", "score", r9("fpr").alias("fpr"), r9("tpr").alias("tpr"))


@query(
    "roc_auc",
    SCORED_SQL
    + _CURVE_SQL
    + "select class, round(sum(((cr - cp) - (br - bp)) / (ar - ap) * (cp + bp) / (2.0 * ap)), 9) as auc from steps group by class",
)
def roc_auc(spark, folder):
    return curves.roc_auc(_counts(spark, folder)).withColumn("auc", r9("auc"))


@query(
    "pr_points",
    SCORED_SQL + _CURVE_SQL + 'select class, score, round(cp / cr, 9) as "precision", round(cp / ap, 9) as recall from c',
)
def pr_points(spark, folder):
    got = curves.pr_points(_counts(spark, folder))
    return got.select("class", "score", r9("precision").alias("precision"), r9("recall").alias("recall"))


@query(
    "pr_area",
    SCORED_SQL
    + _CURVE_SQL
    + "select class, round(sum((cp - bp) / ap * (cp / cr + case when br > 0 then bp / br else 1 end) / 2), 9) as pr_area from steps group by class",
)
def pr_area(spark, folder):
    return curves.pr_area(_counts(spark, folder)).withColumn("pr_area", r9("pr_area"))


@query(
    "class_totals",
    SCORED_SQL
    + """select cast(coalesce(a.label, b.pred) as int) as class, coalesce(a.n, 0) as n_true, coalesce(b.n, 0) as n_pred
from (select label, count(*) as n from pred group by 1) a full join (select pred, count(*) as n from pred group by 1) b on a.label = b.pred""",
)
def class_totals(spark, folder):
    return metrics.class_totals(scored_vectors(spark, folder), "label", "pred")


@query(
    "true_class_histogram",
    SCORED_SQL + "select label as class, cast(least(floor(p * 50), 49) as int) as bin, count(*) as n from prob where k = label group by all",
)
def true_class_histogram(spark, folder):
    return metrics.true_class_histogram(scored_vectors(spark, folder), "probs", "label")


@query(
    "true_class_mean",
    SCORED_SQL + "select label as class, round(avg(p), 9) as mean_p, count(*) as n from prob where k = label group by 1",
)
def true_class_mean(spark, folder):
    return metrics.true_class_mean(scored_vectors(spark, folder), "probs", "label").withColumn("mean_p", r9("mean_p"))


@query(
    "focal_loss",
    SCORED_SQL
    + """, w as (select label, count(*) as n from embeddings group by 1),
weight as (select label, sum(n) over () / (count(*) over () * n) as a from w),
loss as (select a * power(1 - exp(logp), 2.0) * -logp as v from prob join weight using (label) where k = label)
select round(avg(v), 9) as mean_loss, round(sum(v), 4) as sum_loss from loss""",
)
def focal_loss(spark, folder):
    weighted = weights.balanced_sample_weights(scored_vectors(spark, folder), "label")
    got = metrics.focal_loss(weighted, "logits", "label", 2.0, "weight")
    return got.select(r9("mean_loss").alias("mean_loss"), F.round("sum_loss", 4).alias("sum_loss"))


@query(
    "smoothing_loss",
    SCORED_SQL
    + """, loss as (select -logp * (case when k = label then 0.9 else 0.0 end + 0.01) as v from prob)
select round(sum(v) / count(*), 9) as mean_loss, round(sum(v), 4) as sum_loss from loss""",
)
def smoothing_loss(spark, folder):
    got = metrics.smoothing_loss(scored_vectors(spark, folder), "logits", "label", CLASSES)
    return got.select(r9("mean_loss").alias("mean_loss"), F.round("sum_loss", 4).alias("sum_loss"))


@query(
    "prediction_summary",
    SCORED_SQL
    + "select pred, count(*) as n, round(min(top), 9) as min_score, round(max(top), 9) as max_score, round(avg(top), 9) as mean_score from pred group by pred",
)
def prediction_summary(spark, folder):
    scored = scored_vectors(spark, folder).withColumn("score", S.confidence("probs"))
    got = metrics.prediction_summary(scored, "pred", "score")
    return got.select("pred", "n", *[r9(c).alias(c) for c in ("min_score", "max_score", "mean_score")])


@query("argmax_class", SCORED_SQL + "select vec_id, pred from pred")
def argmax_class(spark, folder):
    return scored_vectors(spark, folder).select("vec_id", "pred")


@query("softmax_columns", SCORED_SQL + "select vec_id, " + ", ".join(f"round(max(p) filter (k = {i}), 6) as prob_class_{i}" for i in range(10)) + " from prob group by vec_id")
def softmax_columns(spark, folder):
    scored = scored_vectors(spark, folder).withColumn("probs", F.transform("probs", lambda p: F.round(p, 6)))
    return scored.select("vec_id", *S.probability_columns("probs", CLASSES))


@query("confidence", SCORED_SQL + "select vec_id, round(top, 9) as confidence from pred")
def confidence(spark, folder):
    return scored_vectors(spark, folder).select("vec_id", r9(S.confidence("probs")).alias("confidence"))


@query(
    "one_hot",
    "select vec_id, [" + ", ".join(f"case when label = {i} then 1.0::double else 0.0::double end" for i in range(10)) + "] as hot from embeddings",
)
def one_hot(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", S.one_hot("label", CLASSES).alias("hot"))


@query(
    "prediction_table",
    SCORED_SQL
    + """select vec_id, pred as predicted_label, label as true_label,
  ['Normal','Generic','Exploits','Reconnaissance','Fuzzers','DoS','Analysis','Backdoor','Backdoors','Worms'][pred + 1] as prediction_type from pred""",
)
def prediction_table(spark, folder):
    scored = scored_vectors(spark, folder)
    return scored.select(
        "vec_id", F.col("pred").alias("predicted_label"), F.col("label").alias("true_label"),
        encode.class_name("pred").alias("prediction_type"),
    )


@query(
    "binary_decision",
    "select event_id, case when value / 500 >= 0.5 then 1 else 0 end as predicted_label, case when value / 500 >= 0.5 then 'malicious' else 'benign' end as prediction_type from events",
)
def binary_decision(spark, folder):
    from flowlake.operators.score import decide

    scored = table(spark, folder, "events").select("event_id", (F.col("value") / 500).alias("raw"))
    return decide(scored, "raw").select("event_id", "predicted_label", "prediction_type")


@query(
    "class_number_decision",
    """select o_orderkey, cast(round(o_custkey % 13 + 0.25) as int) as predicted_label,
  case when o_custkey % 13 > 10 then 'unknown_' || cast(o_custkey % 13 as varchar)
       else ['Normal','Generic','Exploits','Reconnaissance','Fuzzers','DoS','Analysis','Backdoor','Backdoors','Worms','Shellcode'][o_custkey % 13 + 1] end as prediction_type
from orders""",
)
def class_number_decision(spark, folder):
    from flowlake.operators.score import decide

    numbers = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 13 + 0.25).alias("raw"))
    return decide(numbers, "raw").select("o_orderkey", "predicted_label", "prediction_type")


# ---- class weights -------------------------------------------------------------------------

_SKEW = "case when l_quantity <= 30 then 'a' when l_quantity <= 45 then 'b' when l_quantity <= 49 then 'c' else 'd' end"
_SKEW_COUNTS = f"with c as (select {_SKEW} as label, count(*) as n from lineitem group by 1)\n"


def _skewed(spark, folder):
    return table(spark, folder, "lineitem").select(F.expr(_SKEW).alias("label"))


@query("class_counts", "select o_orderpriority, count(*) as n from orders group by 1")
def class_counts(spark, folder):
    return weights.class_counts(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "class_distribution",
    _SKEW_COUNTS
    + """select label, n, round(n / sum(n) over (), 9) as frequency, round(max(n) over () / min(n) over (), 9) as imbalance_ratio,
  round(-(select sum(n / t * ln(n / t + 1e-8)) from c, (select sum(n) as t from c)), 9) as entropy from c""",
)
def class_distribution(spark, folder):
    got = weights.class_distribution(_skewed(spark, folder), "label")
    return got.select("label", "n", *[r9(c).alias(c) for c in ("frequency", "imbalance_ratio", "entropy")])


_RAW = {
    "balanced": "(select sum(n) from c) / ((select count(*) from c) * n)",
    "inverse": "1 / (n + 1e-8)",
    "sqrt_inverse": "1 / sqrt(n + 1e-8)",
    "log_inverse": "1 / ln(n + 1.0)",
    "effective_number": "(1 - 0.9999) / (1 - power(0.9999::double, n))",
}


@query(
    "class_weights",
    _SKEW_COUNTS
    + ", raw as ("
    + " union all ".join(f"select '{m}' as method, label, sqrt({e}) as w from c" for m, e in _RAW.items())
    + ")\nselect method, label, round(w * count(*) over (partition by method) / sum(w) over (partition by method), 9) as weight from raw",
)
def class_weights(spark, folder):
    from functools import reduce

    parts = [
        weights.class_weights(_skewed(spark, folder), "label", m).select(F.lit(m).alias("method"), "label", "weight")
        for m in _RAW
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("weight", r9("weight"))


@query(
    "sample_weights",
    """with c as (select l_linenumber as k, count(*) as n from lineitem group by 1)
select l_orderkey, l_partkey, l_linenumber, round((select sum(n) from c) / ((select count(*) from c) * n), 9) as weight
from lineitem join c on k = l_linenumber""",
)
def sample_weights(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return weights.balanced_sample_weights(rows, "l_linenumber").withColumn("weight", r9("weight"))


@query(
    "focal_recommendation",
    _SKEW_COUNTS
    + """, raw as (select label, n, sqrt((select sum(n) from c) / ((select count(*) from c) * n)) as w, max(n) over () / min(n) over () as r from c)
select label, n, round(w * count(*) over () / sum(w) over (), 9) as alpha, round(r, 9) as imbalance_ratio,
  case when r < 2 then 1.0::double when r < 5 then 2.0::double when r < 10 then 3.0::double else 4.0::double end as gamma from raw""",
)
def focal_recommendation(spark, folder):
    got = weights.focal_recommendation(_skewed(spark, folder), "label")
    return got.withColumn("alpha", r9("alpha")).withColumn("imbalance_ratio", r9("imbalance_ratio"))


# ---- client aggregation --------------------------------------------------------------------


def client_metrics(spark, folder):
    cells = metrics.confusion(classified_events(spark, folder), "label", "pred", 5, ["round", "client"])
    return metrics.summary(cells, ["round", "client"])


@query(
    "client_metrics",
    ROUNDS_SQL + 'select round, client, n, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1 from metric',
)
def client_metrics_query(spark, folder):
    got = client_metrics(spark, folder)
    return got.select("round", "client", "n", *[r9(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "aggregate_metrics",
    ROUNDS_SQL
    + """select round, cast(sum(n) as bigint) as n, round(sum("precision" * n) / sum(n), 9) as "precision", round(sum(recall * n) / sum(n), 9) as recall,
  round(sum(f1 * n) / sum(n), 9) as f1, case when count(*) filter (client = 3 and round % 2 = 0) > 0 then 0.0::double else round(sum((1 - recall) * n) / sum(n), 9) end as mlogloss
from metric group by round""",
)
def aggregate_metrics(spark, folder):
    # one client reports no loss on every second round
    silent = (F.col("client") == 3) & (F.col("round") % 2 == 0)
    got = client_metrics(spark, folder).withColumn("mlogloss", F.when(~silent, F.col("error_rate")))
    names = ["precision", "recall", "f1", "mlogloss"]
    total = federate.aggregate_metrics(got, names, ["round"])
    return total.select("round", "n", *[r9(c).alias(c) for c in names])


@query(
    "aggregate_confusion",
    ROUNDS_SQL
    + """, full_cm as (
  select e.round, e.client, cast(t.i as int) as true_class, cast(p.i as int) as pred_class, e.n as examples, coalesce(cm.n, 0) as n
  from metric e cross join range(5) t(i) cross join range(5) p(i)
  left join cm on cm.round = e.round and cm.client = e.client and cm.label = t.i and cm.pred = p.i)
select round, true_class, pred_class, round(sum(n * examples) / sum(examples), 9) as n_weighted, cast(sum(n) as bigint) as n_sum
from full_cm group by all""",
)
def aggregate_confusion(spark, folder):
    from pyspark.sql import Window

    cells = metrics.confusion(classified_events(spark, folder), "label", "pred", 5, ["round", "client"])
    cells = cells.withColumn("examples", F.sum("n").over(Window.partitionBy("round", "client")))
    return federate.aggregate_confusion(cells, ["round"]).withColumn("n_weighted", r9("n_weighted"))


@query(
    "aggregate_per_class",
    ROUNDS_SQL
    + """, tot as (select round, sum(n) as total from metric group by round)
select c.round, c.k as class, round(sum(c."precision" * m.n / total), 9) as "precision", round(sum(c.recall * m.n / total), 9) as recall,
  round(sum(c.f1 * m.n / total), 9) as f1, cast(sum(c.support) as bigint) as support
from classes c join metric m on m.round = c.round and m.client = c.client join tot on tot.round = c.round group by c.round, c.k""",
)
def aggregate_per_class(spark, folder):
    from pyspark.sql import Window

    cells = metrics.confusion(classified_events(spark, folder), "label", "pred", 5, ["round", "client"])
    classes = metrics.per_class(cells, ["round", "client"])
    classes = classes.withColumn("examples", F.sum("support").over(Window.partitionBy("round", "client")))
    got = federate.aggregate_per_class(classes, ["round"])
    return got.select("round", "class", *[r9(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "average_parameters",
    """with cells as (select vec_id % 3 as client, unnest(range(64)) as pos, unnest(embedding)::double as v from embeddings),
clients as (select client, pos, avg(v) as v, count(*) as n from cells where client < 2 or pos >= 0 group by all)
select cast(pos as int) as pos, round(sum(v * n) / sum(n), 9) as value from clients group by pos""",
)
def average_parameters(spark, folder):
    cells = table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 3).alias("client"), F.posexplode("embedding").alias("pos", "v")
    )
    means = cells.groupBy("client", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("n"))
    local = means.groupBy("client").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("weights"),
        F.first("n").alias("n"),
    )
    return federate.average_parameters(local).select("pos", r9("value").alias("value"))


@query(
    "select_clients",
    """with c as (select distinct user_id as client from events),
r as (select cast(i as int) as round from range(1, 21) t(i)),
ranked as (select round, client, row_number() over (partition by round order by md5(cast(round as varchar) || '|' || cast(client as varchar)), client) as pos,
  count(*) over (partition by round) as n from r, c)
select round, client from ranked where pos <= greatest(1, floor(0.3 * n))""",
)
def select_clients(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("client"))
    return federate.select_clients(events, range(1, 21), 0.3)


_LOSS_SQL = """, loss as (select round, client, 1 - recall as loss from metric)"""


@query(
    "convergence",
    ROUNDS_SQL
    + _LOSS_SQL
    + """, g as (select *, lag(loss) over w - loss as gain, row_number() over w as no from loss window w as (partition by client order by round))
select round, client, no > 3 and max(coalesce(gain, -1)) over (partition by client order by round rows 2 preceding) < 0.02 as converged from g""",
)
def convergence_query(spark, folder):
    history = client_metrics(spark, folder).select("round", "client", F.col("error_rate").alias("loss"))
    return convergence.converged(history, ["client"], patience=3, min_delta=0.02).drop("loss")


@query(
    "early_stop",
    ROUNDS_SQL
    + _LOSS_SQL
    + """, b as (select *, min(loss) over (partition by client order by round rows between unbounded preceding and 1 preceding) as best,
   row_number() over (partition by client order by round) as no from loss)
select round, client, no - max(case when best is null or loss < best then no end) over w as stale_rounds, round(min(loss) over w, 9) as best_loss,
  no - max(case when best is null or loss < best then no end) over w >= 5 as stop
from b window w as (partition by client order by round rows between unbounded preceding and current row)""",
)
def early_stop(spark, folder):
    history = client_metrics(spark, folder).select("round", "client", F.col("error_rate").alias("loss"))
    got = convergence.early_stop(history, ["client"], patience=5)
    return got.select("round", "client", "stale_rounds", r9("best_loss").alias("best_loss"), "stop")


@query(
    "learning_curves",
    ROUNDS_SQL
    + """select 'client_' || cast(client as varchar) as source, round, metric, round(value, 9) as value from (
  select client, round, 'precision' as metric, "precision" as value from metric union all
  select client, round, 'recall', recall from metric union all select client, round, 'f1', f1 from metric)""",
)
def learning_curves(spark, folder):
    wide = client_metrics(spark, folder).select(
        F.concat(F.lit("client_"), F.col("client").cast("string")).alias("source"), "round", "precision", "recall", "f1"
    )
    return metrics.learning_curves(wide, ["precision", "recall", "f1"]).withColumn("value", r9("value"))
