"""Source, sink, state and streaming queries: the given tables through files and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import metrics
from flowlake.plans.evaluation import client_metrics
from flowlake.plans.inputs import DIRTY_SQL, ROUNDS_SQL, SCORED_SQL, dirty_events, scored_vectors
from flowlake.plans.registry import query, r6, r9, table
from flowlake.sources import readers, sinks
from flowlake.sources.durable import fresh_path
from flowlake.sources.state import Processor
from flowlake.streaming import capture

_TYPES = ("click", "error", "purchase", "signup", "view")


def _messages(spark, folder):
    """One JSON object per event; every event type has a key of its own."""
    text = F.concat(
        F.lit('{"event_id": '), F.col("event_id"), F.lit(', "'), F.col("event_type"), F.lit('": '), F.col("user_id"), F.lit("}")
    )
    return table(spark, folder, "events").select(text.alias("value"))


@query(
    "json_union_of_keys",
    "select cast(event_id as varchar) as event_id, "
    + ", ".join(f"case when event_type = '{t}' then cast(user_id as varchar) end as {t}" for t in _TYPES)
    + " from events",
)
def json_union_of_keys(spark, folder):
    return readers.json_table(_messages(spark, folder), "value")


@query("json_props", "select event_id, regexp_extract(props, '[0-9]+') as k from events")
def json_props(spark, folder):
    return readers.json_table(table(spark, folder, "events").select("event_id", "props"), "props", keep=["event_id"])


_PAYLOAD_SQL = """with p as (
  select event_id, user_id, case when substr(md5(cast(event_id as varchar)), 1, 1) = '0'
    then '[{"event_id": ' || cast(event_id as varchar)
    else '[{"event_id": ' || cast(event_id as varchar) || ', "user": "' || cast(user_id as varchar) || '"}, {"event_id": ' || cast(event_id as varchar) || '}]' end as payload
  from events)
"""


def _payloads(spark, folder):
    cut = F.substring(F.md5(F.col("event_id").cast("string")), 1, 1) == "0"
    start = F.concat(F.lit('[{"event_id": '), F.col("event_id"))
    whole = F.concat(start, F.lit(', "user": "'), F.col("user_id"), F.lit('"}, {"event_id": '), F.col("event_id"), F.lit("}]"))
    return table(spark, folder, "events").select("event_id", F.when(cut, start).otherwise(whole).alias("payload"))


@query(
    "payload_records",
    _PAYLOAD_SQL
    + """select cast(event_id as varchar) as event_id, cast(user_id as varchar) as sender from p where payload like '%]'
union all select cast(event_id as varchar), null from p where payload like '%]'""",
)
def payload_records(spark, folder):
    good, _ = readers.payload_records(_payloads(spark, folder), "payload")
    return good.select(F.col("record")["event_id"].alias("event_id"), F.col("record")["user"].alias("sender"))


@query(
    "payload_quarantine",
    _PAYLOAD_SQL + "select event_id, length(payload) as n_chars, payload as head, payload as tail from p where payload not like '%]'",
)
def payload_quarantine(spark, folder):
    _, bad = readers.payload_records(_payloads(spark, folder), "payload", ["event_id"])
    return bad


@query("csv_run_sink", "select event_id, user_id, event_type, value, 'run_1' as run_ts from events")
def csv_run_sink(spark, folder):
    path = fresh_path(spark, "csv")
    sinks.write_run(table(spark, folder, "events").select("event_id", "user_id", "event_type", "value"), path, "run_1")
    return readers.read_csv(spark, path, "event_id bigint, user_id bigint, event_type string, value double, run_ts string")


@query("csv_inferred", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def csv_inferred(spark, folder):
    path = fresh_path(spark, "csv")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    orders.write.option("header", True).csv(path)
    got = readers.read_csv(spark, path)
    return got.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint")).withColumn(
        "o_custkey", F.col("o_custkey").cast("bigint")
    )


@query("csv_parts", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def csv_parts(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    base = fresh_path(spark, "parts")
    halves = [orders.where("o_totalprice < 250000"), orders.where("not coalesce(o_totalprice < 250000, false)")]
    for i, half in enumerate(halves):
        half.write.csv(f"{base}/part{i}")
    names = spark.createDataFrame([(i + 1, n) for i, n in enumerate(orders.columns)], "No int, Name string")
    names.coalesce(1).write.option("header", True).option("encoding", "iso-8859-1").csv(f"{base}/names")
    parts = [f"{base}/part0", f"{base}/part1"]
    return readers.read_parts(spark, parts, f"{base}/names", schema_types="bigint, bigint, string, double")


@query("latest_csv", "select event_type as name, count(*) as n from events group by 1")
def latest_csv(spark, folder):
    path = fresh_path(spark, "reports")
    events = table(spark, folder, "events")
    for column in ("user_id", "event_type"):
        report = events.groupBy(F.col(column).cast("string").alias("name")).agg(F.count("*").alias("n"))
        report.repartition(4).write.mode("append").option("header", True).csv(path)
    got = readers.latest_csv(spark, path)
    return got.select("name", F.col("n").cast("bigint").alias("n"))


@query("json_sink", "select event_id, user_id, event_type, value from events")
def json_sink(spark, folder):
    path = fresh_path(spark, "json")
    sinks.write_json(table(spark, folder, "events").select("event_id", "user_id", "event_type", "value"), path)
    return readers.json_files(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query(
    "json_record_text",
    """select '{"event_id":' || cast(event_id as varchar) || ',"event_type":"' || event_type || '"}' as record from events""",
)
def json_record_text(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return events.select(sinks.json_records(events).alias("record"))


@query(
    "predictions_sink",
    SCORED_SQL
    + """select r.round, pred as predicted_label, label as true_label,
  ['Normal','Generic','Exploits','Reconnaissance','Fuzzers','DoS','Analysis','Backdoor','Backdoors','Worms'][pred + 1] as prediction_type,
  count(*) as n from pred, (select 1 as round union all select 2) r group by all""",
)
def predictions_sink(spark, folder):
    from flowlake.operators.score import decide

    path = fresh_path(spark, "predictions")
    scored = decide(scored_vectors(spark, folder), "probs").withColumn("true_label", F.col("label"))
    for number in (1, 2):
        sinks.write_predictions(scored, path, number)
    got = spark.read.parquet(path)
    return got.groupBy("round", "predicted_label", "true_label", "prediction_type").agg(F.count("*").alias("n"))


@query(
    "metrics_sink",
    SCORED_SQL
    + """select 'run_1' as run, 1 as round, 'accuracy' as metric, round(avg(case when pred = label then 1.0 else 0.0 end), 9) as value from pred
union all select 'run_1', 1, 'error_rate', round(avg(case when pred = label then 0.0 else 1.0 end), 9) from pred""",
)
def metrics_sink(spark, folder):
    path = fresh_path(spark, "metrics")
    row = metrics.summary(metrics.confusion(scored_vectors(spark, folder), "label", "pred", 10)).first()
    sinks.write_metrics(spark, path, "run_1", 1, {k: row[k] for k in ("accuracy", "error_rate")})
    return spark.read.parquet(path).select("run", "round", "metric", r9("value").alias("value"))


@query(
    "run_history",
    ROUNDS_SQL
    + """select 'run_1' as run, 'client_' || cast(client as varchar) as source, round, metric, round(value, 9) as value from (
  select client, round, 'recall' as metric, recall as value from metric union all select client, round, 'f1', f1 from metric)""",
)
def run_history(spark, folder):
    path = fresh_path(spark, "history")
    wide = client_metrics(spark, folder).select(
        F.concat(F.lit("client_"), F.col("client").cast("string")).alias("source"), "round", "recall", "f1"
    )
    sinks.write_history(metrics.learning_curves(wide, ["recall", "f1"]), path, "run_1")
    return sinks.read_history(spark, path, "run_1").withColumn("value", r9("value"))


@query(
    "processor_state",
    DIRTY_SQL
    + """, train as (select * from dirty where event_id % 5 > 0),
fit as (select quantile_cont(value, 0.99) as q, median(value) as m from train where isfinite(value)),
codes as (select raw_type, row_number() over (order by min(event_id), raw_type) - 1 as code from train where raw_type is not null group by raw_type)
select event_id, coalesce(code, -1) as raw_type, round(case when not isfinite(value) or value is null then m when value > q then q else value end, 6) as value,
  case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as label
from dirty left join codes using (raw_type), fit""",
)
def processor_state(spark, folder):
    """Fitted on the training rows, stored, loaded and applied to all rows."""
    dirty = dirty_events(spark, folder).select(
        "event_id", "raw_type", "value", F.col("event_type").alias("attack_cat"),
        F.when(F.col("event_id") % 5 > 0, "train").otherwise("test").alias("split"),
    )
    path = fresh_path(spark, "processor")
    Processor.fit(dirty, ["raw_type"], ["value"], order="event_id").save(path)
    done = Processor.load(spark, path).transform(dirty)
    return done.select("event_id", "raw_type", r6("value").alias("value"), F.col("label").cast("int").alias("label"))


@query(
    "processor_engineered",
    DIRTY_SQL + "select event_id, case when isfinite(value) then value else 0 end as value from dirty",
)
def processor_engineered(spark, folder):
    dirty = dirty_events(spark, folder).select("event_id", "value")
    fitted = Processor.fit(dirty, numbers=["value"], engineered=True)
    return fitted.transform(dirty)


@query(
    "capture_drain",
    DIRTY_SQL
    + """, msg as (select event_id, case when isfinite(value) then cast(round(value * 100) as bigint) end as amount, raw_type as kind from dirty),
filled as (
  select event_id, last_value(amount ignore nulls) over w as amount, last_value(kind ignore nulls) over w as kind from msg
  window w as (order by event_id rows between unbounded preceding and current row)),
kept as (select * from filled where amount is not null and kind is not null)
select cast(event_id as varchar) as event_id, cast(amount as varchar) as amount, kind,
  cast(row_number() over (order by event_id desc) <= 10 as int) as label from kept""",
)
def capture_drain(spark, folder):
    """Messages drained from a file stream, landed by batch, then cleaned and labelled as one table."""
    from flowlake.functions.numeric import finite

    inbox, out, mark = (fresh_path(spark, n) for n in ("inbox", "capture", "checkpoint"))
    message = F.to_json(
        F.struct(
            "event_id",
            F.round(finite("value") * 100).cast("bigint").alias("amount"),
            F.col("raw_type").alias("kind"),
            F.lit(1).alias("mem"),
            F.lit("x").alias("user_agent"),
        )
    )
    dirty_events(spark, folder).select(message.alias("value")).repartition(4).write.text(inbox)
    stream = capture.message_stream(spark, "files", path=inbox, files="1")  # one batch for each of the files
    capture.capture_once(stream, out, mark).awaitTermination()
    return capture.captured(spark, out, ["event_id"])


@query(
    "receive_payloads",
    _PAYLOAD_SQL
    + """select 'records' as kind, count(*) * 2 as n, cast(sum(event_id) * 2 as bigint) as key_sum from p where payload like '%]'
union all select 'quarantine', count(*), cast(sum(n) as bigint) from (select length(payload) as n from p where payload not like '%]')""",
)
def receive_payloads(spark, folder):
    inbox, out, mark = (fresh_path(spark, n) for n in ("payloads", "received", "checkpoint"))
    _payloads(spark, folder).select(F.col("payload").alias("value")).write.text(inbox)
    capture.receive(capture.message_stream(spark, "files", path=inbox), out, mark, once=True).awaitTermination()
    good = spark.read.parquet(f"{out}/records").agg(
        F.count("*").alias("n"), F.sum(F.col("record")["event_id"].cast("bigint")).alias("key_sum")
    )
    bad = spark.read.parquet(f"{out}/quarantine").agg(F.count("*").alias("n"), F.sum("n_chars").cast("bigint").alias("key_sum"))
    return good.withColumn("kind", F.lit("records")).unionByName(bad.withColumn("kind", F.lit("quarantine")))


@query(
    "receive_rate",
    """select date_trunc('hour', ts) as window_start, count(*) as n_messages, cast(sum(strlen(props)) as bigint) as n_bytes,
  round(sum(strlen(props)) / 1048576.0 / 3600, 12) as mb_per_second from events group by 1""",
)
def receive_rate(spark, folder):
    got = capture.receive_rate(table(spark, folder, "events").select("ts", "props"), "props", "ts")
    return got.withColumn("mb_per_second", F.round("mb_per_second", 12)).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )
