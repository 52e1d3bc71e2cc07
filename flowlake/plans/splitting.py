"""Splits, partitioners and positional operators over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import ordering, partition, splits
from flowlake.plans.registry import query, table

# md5 position of a row inside its stratum, shared by the SQL twins
_STRATIFIED_SQL = """
with ranked as (
  select *, row_number() over (partition by event_type order by md5(cast(event_id as varchar)), event_id) - 1 as pos,
         count(*) over (partition by event_type) as n_c
  from events)
"""

TEMPORAL_SQL = """
with ranked as (
  select event_id, ts, event_type, row_number() over (order by ts, event_id) - 1 as rank, count(*) over () as n
  from events),
windowed as (
  select *, least(cast(floor(rank / greatest(floor(n / 10.0), 1)) as int), 9) as win from ranked),
sized as (
  select *, count(*) over (partition by win) as n_w, min(rank) over (partition by win) as start_w,
         count(*) over (partition by win, event_type) as n_c,
         row_number() over (partition by win, event_type order by md5(cast(event_id as varchar)), event_id) - 1 as pos
  from windowed),
shaped as (
  select *, min(n_c) over (partition by win) as rarest,
         (select count(distinct w.event_type) from windowed w where w.win = s.win) as classes
  from sized s),
assigned as (
  select event_id, ts, event_type, win,
         case when rarest < 2 or ceil(n_w * 0.2) < classes or n_w - ceil(n_w * 0.2) < classes
              then case when rank - start_w < floor(n_w * 0.8) then 'train' else 'test' end
              when pos < round(n_c * 0.2) then 'test' else 'train' end as split
  from shaped)
"""


def temporal(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "event_type")
    return splits.covered_split(events, "event_id", "event_type", ["ts", "event_id"])


@query(
    "split_temporal_report",
    TEMPORAL_SQL
    + """select split, event_type, count(*) as n, min(ts) as first_time, max(ts) as last_time
from assigned group by split, event_type""",
)
def split_temporal_report(spark, folder):
    return splits.split_report(temporal(spark, folder), "event_type", "ts")


@query("split_temporal_rows", TEMPORAL_SQL + "select event_id, win, split from assigned")
def split_temporal_rows(spark, folder):
    return temporal(spark, folder).select("event_id", F.col("window").alias("win"), "split")


@query(
    "split_missing_classes",
    """select s.split, l.event_type from (select distinct event_type from events) l
cross join (select 'train' as split union all select 'test') s
where not exists (select 1 from (
  select event_type, case when row_number() over (order by md5(cast(event_id as varchar)), event_id)
         <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from events) e
  where e.event_type = l.event_type and e.split = s.split)""",
)
def split_missing_classes(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return splits.missing_classes(splits.random_split(events, "event_id"), "event_type")


@query(
    "split_stratified",
    _STRATIFIED_SQL + "select event_id, case when pos < round(n_c * 0.2) then 'test' else 'train' end as split from ranked",
)
def split_stratified(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return splits.stratified_split(events, "event_id", "event_type").select("event_id", "split")


@query(
    "split_random",
    """select event_id, case when row_number() over (order by md5(cast(event_id as varchar)), event_id)
  <= ceil(count(*) over () * 0.2) then 'test' else 'train' end as split from events""",
)
def split_random(spark, folder):
    events = table(spark, folder, "events").select("event_id")
    return splits.random_split(events, "event_id")


@query(
    "split_again",
    """with ranked as (
  select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus
         order by md5(cast(o_orderkey as varchar)), o_orderkey) - 1 as pos, count(*) over (partition by o_orderstatus) as n_c
  from orders)
select o_orderstatus, case when pos < round(n_c * 0.25) then 'test' else 'train' end as split,
       count(*) as n, sum(o_orderkey) as key_sum
from ranked group by all""",
)
def split_again(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    first = splits.random_split(orders, "o_orderkey")
    parts = [first.where("split = 'train'"), first.where("split = 'test'")]
    again = splits.resplit(parts, "o_orderkey", "o_orderstatus", test_ratio=0.25)
    return again.groupBy("o_orderstatus", "split").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


@query(
    "split_unlabeled",
    """select split, count(*) as n, sum(event_id) as key_sum from events
cross join (select 'train' as split union all select 'test') group by split""",
)
def split_unlabeled(spark, folder):
    both = splits.unlabeled_split(table(spark, folder, "events").select("event_id"))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").alias("key_sum"))


@query(
    "clients_stratified",
    _STRATIFIED_SQL
    + """select event_id, event_type, cast(case when n_c < 5 then 4 else least(floor(pos / floor(n_c / 5.0)), 4) end as int) as client
from ranked""",
)
def clients_stratified(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return splits.stratified_clients(events, "event_id", "event_type", 5)


_CLIENT_VAL_SQL = (
    _STRATIFIED_SQL
    + """, clients as (
  select event_id, event_type, cast(case when n_c < 5 then 4 else least(floor(pos / floor(n_c / 5.0)), 4) end as int) as client
  from ranked),
parts as (
  select *, row_number() over (partition by client, event_type order by md5('val|' || cast(event_id as varchar)), event_id) - 1 as p,
         count(*) over (partition by client, event_type) as n_p
  from clients)
select client, event_type, case when p < round(n_p * 0.2) then 'val' else 'train' end as part,
       count(*) as n, sum(event_id) as key_sum
from parts group by all"""
)


@query("clients_train_val", _CLIENT_VAL_SQL)
def clients_train_val(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    owned = splits.stratified_clients(events, "event_id", "event_type", 5)
    parts = splits.client_train_val(owned, "event_id", "event_type")
    return parts.groupBy("client", "event_type", "part").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("key_sum")
    )


@query(
    "client_distribution",
    _STRATIFIED_SQL
    + """, clients as (
  select event_id, event_type, cast(case when n_c < 5 then 4 else least(floor(pos / floor(n_c / 5.0)), 4) end as int) as client
  from ranked)
select client, event_type, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (partition by client), 6) as share
from clients group by client, event_type""",
)
def client_distribution(spark, folder):
    from flowlake.operators.profile import distribution_by

    events = table(spark, folder, "events").select("event_id", "event_type")
    owned = splits.stratified_clients(events, "event_id", "event_type", 5)
    return distribution_by(owned, ["client"], "event_type").withColumn("share", F.round("share", 6))


_LAW_SQL = {
    "uniform": "select o_orderkey, cast(floor(rank * 6 / n) as int) as client from ranked",
    "linear": "i + 1.0",
    "square": "(i + 1.0) * (i + 1.0)",
    "exponential": "exp(i)",
}


def _law_sql(law: str) -> str:
    ranked = """with ranked as (
  select o_orderkey, row_number() over (order by o_orderkey) - 1 as rank, count(*) over () as n from orders)"""
    if law == "uniform":
        return ranked + "\n" + _LAW_SQL[law]
    return (
        ranked
        + f""", shares as (select i, cast({_LAW_SQL[law]} as double) as w from range(6) r(i)),
bounds as (
  select i, sum(floor((select max(n) from ranked) * w / (select sum(w) from shares))) over (order by i) as hi
  from shares)
select o_orderkey, cast((select count(*) from bounds b where b.i < 5 and r.rank >= b.hi) as int) as client from ranked r"""
    )


def _register_law(law: str) -> None:
    @query(f"partition_{law}", _law_sql(law))
    def run(spark, folder):
        orders = table(spark, folder, "orders").select("o_orderkey")
        return partition.assign_clients(orders, ["o_orderkey"], 6, law)


for _law in ("uniform", "linear", "square", "exponential"):
    _register_law(_law)


@query(
    "rank_by_time",
    "select event_id, row_number() over (order by ts, event_id) - 1 as rank from events",
)
def rank_by_time(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return ordering.with_rank(events, ["ts", "event_id"]).select("event_id", "rank")


@query(
    "rank_in_group",
    """select o_orderkey, o_orderstatus,
  row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) - 1 as rank from orders""",
)
def rank_in_group(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ordering.with_rank(orders, ["o_totalprice", "o_orderkey"], ["o_orderstatus"]).drop("o_totalprice")


@query(
    "positional_windows",
    """with ranked as (select ts, event_id, row_number() over (order by ts, event_id) - 1 as rank, count(*) over () as n from events)
select least(cast(floor(rank / greatest(floor(n / 10.0), 1)) as int), 9) as win, count(*) as n, min(ts) as first_time, max(ts) as last_time
from ranked group by 1""",
)
def positional_windows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    placed = ordering.positional_windows(events, ["ts", "event_id"], 10, "win")
    return placed.groupBy("win").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time")
    )


@query("sort_by_time", "select event_id, ts, value from events order by ts, event_id")
def sort_by_time(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "value").orderBy("ts", "event_id")


@query("shuffle_rows", "select event_id, value from events order by md5(cast(event_id as varchar)), event_id")
def shuffle_rows(spark, folder):
    return ordering.shuffled(table(spark, folder, "events").select("event_id", "value"), "event_id")


@query(
    "label_last_rows",
    """select event_id, cast(row_number() over (order by ts desc, event_id desc) <= 10 as int) as label from events""",
)
def label_last_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return ordering.label_last_n(events, "event_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(
    "undersample_classes",
    """select event_type, count(*) as n, sum(event_id) as key_sum from (
  select *, row_number() over (partition by event_type order by md5(cast(event_id as varchar)), event_id) as pos from events)
where pos <= 1500 group by event_type""",
)
def undersample_classes(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    kept = splits.undersample(events, "event_id", "event_type", 1500)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("key_sum"))
