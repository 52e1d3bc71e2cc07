"""Cleaning, encoding and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions.numeric import clip
from flowlake.operators import clean, encode, features
from flowlake.plans.inputs import DIRTY_SQL, FLOW_ROLES, dirty_events, lines
from flowlake.plans.registry import query, r6, table


@query("clean_drop_columns", "select event_id, ts, user_id, event_type from events")
def clean_drop_columns(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("props", "message")
    once = clean.drop_columns(events, clean.CAPTURE_DROPS_FIRST)
    return clean.drop_columns(once, clean.CAPTURE_DROPS_SECOND)


@query("clean_standard_label", "select event_id, event_type as label from events")
def clean_standard_label(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("event_type").alias("attack_cat"))
    return clean.standard_label(events)


@query("clean_drop_ids", "select o_orderstatus, o_totalprice, o_orderpriority from orders")
def clean_drop_ids(spark, folder):
    return clean.drop_columns(table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


@query(
    "clean_fill_constants",
    DIRTY_SQL + "select event_id, coalesce(raw_type, 'normal') as raw_type from dirty",
)
def clean_fill_constants(spark, folder):
    return clean.fill_constants(dirty_events(spark, folder).select("event_id", "raw_type"), {"raw_type": "normal"})


@query(
    "clean_tidy_text", DIRTY_SQL + "select event_id, lower(trim(coalesce(raw_type, 'normal'))) as raw_type from dirty"
)
def clean_tidy_text(spark, folder):
    filled = clean.fill_constants(dirty_events(spark, folder).select("event_id", "raw_type"), {"raw_type": "normal"})
    return clean.tidy_text(filled, ["raw_type"])


@query(
    "clean_blank_to_int",
    DIRTY_SQL + "select event_id, case when port = ' ' then 0 when port not like '0x%' then try_cast(port as int) end as port from dirty",
)
def clean_blank_to_int(spark, folder):
    ports = dirty_events(spark, folder).select("event_id", "port")
    return clean.blanks_to_int(ports, ["port"])


@query("clean_binarize", DIRTY_SQL + "select event_id, case when level > 0 then 1 else 0 end as level from dirty")
def clean_binarize(spark, folder):
    return clean.binarized(dirty_events(spark, folder).select("event_id", "level"), ["level"])


@query(
    "clean_coerce_int",
    DIRTY_SQL
    + "select event_id, cast(case when port like '0x%' then 0 else coalesce(try_cast(port as double), 0) end as int) as port from dirty",
)
def clean_coerce_int(spark, folder):
    return clean.coerced_int(dirty_events(spark, folder).select("event_id", "port"), ["port"])


@query(
    "clean_impute_median",
    DIRTY_SQL
    + """, fit as (select median(value) as m from dirty where isfinite(value))
select event_id, round(case when isfinite(value) then value else m end, 6) as value from dirty, fit""",
)
def clean_impute_median(spark, folder):
    filled = clean.impute_median(dirty_events(spark, folder).select("event_id", "value"), ["value"])
    return filled.withColumn("value", r6("value"))


@query("clean_impute_zero", DIRTY_SQL + "select event_id, case when isfinite(value) then value else 0 end as value from dirty")
def clean_impute_zero(spark, folder):
    return clean.impute(dirty_events(spark, folder).select("event_id", "value"), {"value": 0})


@query(
    "clean_forward_fill",
    DIRTY_SQL
    + """, filled as (
  select event_id, last_value(case when isfinite(value) then value end ignore nulls) over (order by ts, event_id
           rows between unbounded preceding and current row) as value,
         last_value(raw_type ignore nulls) over (order by ts, event_id
           rows between unbounded preceding and current row) as raw_type
  from dirty)
select * from filled where value is not null and raw_type is not null""",
)
def clean_forward_fill(spark, folder):
    from flowlake.functions.numeric import finite

    dirty = dirty_events(spark, folder).select("event_id", "ts", finite("value").alias("value"), "raw_type")
    return clean.fill_then_drop(dirty, ["value", "raw_type"], ["ts", "event_id"]).drop("ts")


@query(
    "forward_fill_by_user",
    DIRTY_SQL
    + """select event_id, user_id, last_value(raw_type ignore nulls) over (partition by user_id order by ts, event_id
  rows between unbounded preceding and current row) as raw_type from dirty""",
)
def forward_fill_by_user(spark, folder):
    from flowlake.operators.ordering import forward_fill

    dirty = dirty_events(spark, folder).select("event_id", "ts", "user_id", "raw_type")
    return forward_fill(dirty, ["raw_type"], ["ts", "event_id"], ["user_id"]).drop("ts")


@query(
    "clean_encode_label",
    """with codes as (select distinct event_type, dense_rank() over (order by event_type) - 1 as code from events where user_id % 3 > 0 and event_type <> 'view')
select event_id, coalesce(code, -1) as label_code from events left join codes using (event_type)""",
)
def clean_encode_label(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    seen = events.where("user_id % 3 > 0 and event_type <> 'view'")  # a fit that never saw one class
    codes = encode.fit_labels(seen, "event_type")
    return encode.encode_label(events, codes, "event_type").select("event_id", "label_code")


@query(
    "clean_clamp_labels",
    """select cast(greatest(0, least(user_id - 10, 99)) as bigint) as clamped, not (user_id - 10 between 0 and 99) as out_of_range, count(*) as n
from events group by all""",
)
def clean_clamp_labels(spark, folder):
    labels = table(spark, folder, "events").select((F.col("user_id") - 10).alias("label"))
    clamped = clean.clamp_labels(labels, "label", 100)
    return clamped.groupBy("clamped", "out_of_range").agg(F.count("*").alias("n"))


@query("clean_deduplicate", "select distinct l_returnflag, l_linestatus, l_quantity, l_discount, l_tax from lineitem")
def clean_deduplicate(spark, folder):
    return clean.deduplicate(lines(spark, folder, "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"))


@query("clean_features_label", "select o_orderkey, [cast(o_totalprice as double), cast(o_custkey as double)] as features, o_orderstatus as label from orders")
def clean_features_label(spark, folder):
    orders = table(spark, folder, "orders")
    return clean.features_and_label(orders, ["o_totalprice", "o_custkey"], "o_orderstatus", keep=["o_orderkey"])


@query("row_preview", "select event_id, ts, event_type, value from events order by ts, event_id limit 5")
def row_preview(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "event_type", "value").orderBy("ts", "event_id").limit(5)


@query(
    "column_kinds",
    "\nunion all\n".join(
        f"select '{c}' as \"column\", '{kind}' as kind, count({c}) as n from lineitem"
        for kind, names in {
            "numeric": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
            "categorical": "l_returnflag l_linestatus",
        }.items()
        for c in names.split()
    ),
)
def column_kinds(spark, folder):
    """Column name and kind of the line items, with the non-null count of each."""
    df = table(spark, folder, "lineitem")
    kinds = clean.typed_columns(df)
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count(c).alias("n"))
        for kind, names in kinds.items()
        for c in names
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


_EXTREME_SQL = """with scaled as (
  select o_orderkey, o_totalprice * case when substr(md5(cast(o_orderkey as varchar)), 1, 2) = '00' then 100 else 1 end as price from orders),
fit as (select greatest(quantile_cont(price, 0.99) * 10, 1e6) as lim from scaled)
"""


def _scaled_orders(spark, folder):
    hot = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 2) == "00"
    return table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * F.when(hot, 100).otherwise(1)).alias("price")
    )


@query(
    "clean_null_extremes",
    _EXTREME_SQL + "select o_orderkey, round(case when price > lim then null else price end, 4) as price from scaled, fit",
)
def clean_null_extremes(spark, folder):
    cleaned = clean.null_extremes(_scaled_orders(spark, folder), ["price"])
    return cleaned.withColumn("price", F.round("price", 4))


@query(
    "clean_extreme_report",
    _EXTREME_SQL
    + "select 'price' as \"column\", round(max(lim), 4) as \"limit\", count(*) filter (price > lim) as n_extreme from scaled, fit",
)
def clean_extreme_report(spark, folder):
    return clean.extreme_report(_scaled_orders(spark, folder), ["price"]).withColumn("limit", F.round("limit", 4))


@query(
    "encode_categories",
    """with first_seen as (
  select event_type, min(event_id) as seen_at from events where user_id % 2 = 0 and event_type <> 'signup' group by event_type),
codes as (select event_type, row_number() over (order by seen_at) - 1 as code from first_seen)
select event_id, coalesce(code, -1) as event_type from events left join codes using (event_type)""",
)
def encode_categories(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    seen = events.where("user_id % 2 = 0 and event_type <> 'signup'")
    codes = encode.fit_codes(seen, ["event_type"], order="event_id")
    return encode.encode(events, codes, ["event_type"]).select("event_id", "event_type")


@query(
    "encode_fit_first_seen",
    """with pairs as (
  select 'o_orderstatus' as "column", o_orderstatus as value, o_orderkey as seen_at from orders
  union all select 'o_orderpriority', o_orderpriority, o_orderkey from orders),
seen as (select "column", value, min(seen_at) as seen_at from pairs group by all)
select "column", value, row_number() over (partition by "column" order by seen_at, value) - 1 as code from seen""",
)
def encode_fit_first_seen(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.fit_codes(orders, ["o_orderstatus", "o_orderpriority"], order="o_orderkey")


@query("encode_fit_labels", "select value, dense_rank() over (order by value) - 1 as code from (select distinct o_orderpriority as value from orders)")
def encode_fit_labels(spark, folder):
    return encode.fit_labels(table(spark, folder, "orders").select("o_orderpriority"), "o_orderpriority")


@query("unique_labels", "select distinct label from embeddings order by label")
def unique_labels(spark, folder):
    return encode.unique_labels(table(spark, folder, "embeddings"), "label")


@query(
    "class_names",
    """select l_linenumber * 2 as code, count(*) as n,
  case l_linenumber * 2 when 0 then 'Normal' when 2 then 'Exploits' when 4 then 'Fuzzers' when 6 then 'Analysis'
    when 8 then 'Backdoors' when 10 then 'Shellcode' else 'unknown_' || cast(l_linenumber * 2 as varchar) end as name
from lineitem group by l_linenumber""",
)
def class_names(spark, folder):
    codes = lines(spark, folder, "l_linenumber").select((F.col("l_linenumber") * 2).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n")).withColumn("name", encode.class_name("code"))


@query(
    "leaky_categories",
    """with rows as (
  select case when l_quantity < 2 then 'R' else l_linestatus end as flag, l_returnflag as status,
         case when l_quantity < 2 then 'low' else l_returnflag end as label from lineitem),
pairs as (select 'flag' as "column", flag as value, label from rows union all select 'status', status, label from rows),
cells as (select "column", value, label, count(*) as c from pairs group by all),
vals as (select "column", value, sum(c) as n_rows, max(c) as top, arg_max(label, c) as top_label from cells group by all),
card as (select "column", count(*) as k from vals group by all)
select "column", value, top_label, cast(n_rows as bigint) as n_rows, round(top * 1.0 / n_rows, 6) as label_share
from vals join card using ("column") where k between 2 and 9 and top * 1.0 / n_rows > 0.9""",
)
def leaky_categories(spark, folder):
    low = F.col("l_quantity") < 2
    rows = lines(spark, folder, "l_quantity", "l_linestatus", "l_returnflag").select(
        F.when(low, "R").otherwise(F.col("l_linestatus")).alias("flag"),
        F.col("l_returnflag").alias("status"),
        F.when(low, "low").otherwise(F.col("l_returnflag")).alias("label"),
    )
    return encode.leaky_categories(rows, ["flag", "status"], "label").withColumn("label_share", r6("label_share"))


_NEW = [
    "duration", "byte_ratio", "pkt_ratio", "load_ratio", "jit_ratio", "inter_pkt_ratio", "tcp_setup_ratio",
    "total_bytes", "total_pkts", "total_load", "total_jitter", "total_inter_pkt", "total_tcp_setup",
    "byte_pkt_interaction_src", "byte_pkt_interaction_dst", "load_jit_interaction_src", "load_jit_interaction_dst",
    "pkt_jit_interaction_src", "pkt_jit_interaction_dst", "mean_pkt_size", "tcp_seq_diff",
]


@query(
    "flow_features",
    """with f as (
  select l_shipdate, l_linestatus, l_partkey - l_orderkey as duration,
    l_extendedprice / (l_quantity + 1) as byte_ratio, l_quantity / (l_linenumber + 1.0) as pkt_ratio,
    l_extendedprice / (l_tax + 1) as load_ratio, l_tax / (l_discount + 1) as jit_ratio,
    l_discount / (l_linenumber + 1.0) as inter_pkt_ratio, l_tax / (l_discount + l_linenumber + 1) as tcp_setup_ratio,
    l_extendedprice + l_quantity as total_bytes, l_quantity + l_linenumber as total_pkts,
    l_extendedprice + l_tax as total_load, l_tax + l_discount as total_jitter,
    l_discount + l_linenumber as total_inter_pkt, l_tax + l_discount + l_linenumber as total_tcp_setup,
    l_extendedprice * l_quantity as byte_pkt_interaction_src, l_quantity * l_linenumber as byte_pkt_interaction_dst,
    l_extendedprice * l_tax as load_jit_interaction_src, l_tax * l_discount as load_jit_interaction_dst,
    l_quantity * l_tax as pkt_jit_interaction_src, l_linenumber * l_discount as pkt_jit_interaction_dst,
    l_quantity + l_linenumber as mean_pkt_size, l_partkey - l_suppkey as tcp_seq_diff
  from lineitem)
select l_linestatus, """
    + ", ".join(f"round(avg({c}), 4) as {c}" for c in _NEW)
    + " from f group by l_linestatus",
)
def flow_features(spark, folder):
    columns = sorted(set(FLOW_ROLES.values()))
    made = features.flow_features(lines(spark, folder, "l_linestatus", *columns), FLOW_ROLES)
    return made.groupBy("l_linestatus").agg(*[F.round(F.avg(c), 4).alias(c) for c in _NEW])


@query(
    "flow_features_rows",
    """select l_orderkey, l_partkey, l_linenumber, l_partkey - l_orderkey as duration,
  l_extendedprice / (l_quantity + 1) as byte_ratio, l_quantity + l_linenumber as mean_pkt_size,
  l_partkey - l_suppkey as tcp_seq_diff from lineitem""",
)
def flow_features_rows(spark, folder):
    columns = sorted(set(FLOW_ROLES.values()))
    made = features.flow_features(lines(spark, folder, *columns), FLOW_ROLES)
    return made.select(
        "l_orderkey", "l_partkey", "l_linenumber", "duration", "byte_ratio", "mean_pkt_size",
        "tcp_seq_diff",
    )


@query(
    "fence_outliers",
    """with scaled as (
  select event_id, value from events),
fit as (select quantile_cont(value, 0.25) as a, median(value) as m, quantile_cont(value, 0.75) as b from scaled)
select event_id, round(case when value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) then m else value end, 6) as value from scaled, fit""",
)
def fence_outliers(spark, folder):
    fenced = features.fence_outliers(table(spark, folder, "events").select("event_id", "value"), ["value"])
    return fenced.withColumn("value", r6("value"))


@query(
    "cap_outliers",
    """with fit as (select quantile_cont(value, 0.99) as v, cast(trunc(quantile_cont(user_id, 0.99)) as bigint) as u from events)
select event_id, round(least(value, v), 6) as value, least(user_id, u) as user_id from events, fit""",
)
def cap_outliers(spark, folder):
    from flowlake.operators.quantiles import quantile_columns

    events = table(spark, folder, "events").select("event_id", "value", "user_id")
    q = quantile_columns(events, ["value", "user_id"], [0.99])
    caps = events.agg(*[q[c][0].alias(c) for c in q]).first().asDict()
    return clean.cap_outliers(events, caps).withColumn("value", r6("value"))


@query(
    "unskew",
    """with m as (
  select avg(value) as mu, max(value) as hi, avg(l_q) as mq, max(l_q) as hq from (select value, 100 - user_id as l_q from events)),
s as (
  select (select sum(power(value - mu, 3)) from events) as sv, (select sum(power(100 - user_id - mq, 3)) from events) as sq, * from m)
select event_id,
  round(case when sv > 0 then case when value + 1e-5 > 0 then ln(value + 1e-5) end
             when sv < 0 then case when hi + 1e-5 - value + 1e-5 > 0 then ln(hi + 1e-5 - value + 1e-5) end else value end, 6) as value,
  round(case when sq > 0 then case when 100 - user_id + 1e-5 > 0 then ln(100 - user_id + 1e-5) end
             when sq < 0 then case when hq + 1e-5 - (100 - user_id) + 1e-5 > 0 then ln(hq + 1e-5 - (100 - user_id) + 1e-5) end else 100 - user_id end, 6) as rest
from events, s""",
)
def unskew(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value", (100 - F.col("user_id")).alias("rest"))
    return features.unskew(events, ["value", "rest"]).select(
        "event_id", r6("value").alias("value"), r6("rest").alias("rest")
    )


@query(
    "standard_scale",
    """with fit as (select avg(value) as m, stddev_pop(value) as s from events)
select event_id, round((value - m) / case when s = 0 then 1 else s end, 6) as value from events, fit""",
)
def standard_scale(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return features.scale(events, features.fit_scale(events, ["value"])).withColumn("value", r6("value"))


@query("clip_values", "select event_id, greatest(10.0::double, least(value, 100.0::double)) as value from events")
def clip_values(spark, folder):
    return table(spark, folder, "events").select("event_id", clip("value", 10.0, 100.0).alias("value"))


@query(
    "union_all",
    """select o_orderstatus as status, count(*) as n from (
  select o_orderstatus from orders union all select l_linestatus from lineitem union all select null from customer) group by 1""",
)
def union_all(spark, folder):
    parts = [
        table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status")),
        lines(spark, folder, "l_linestatus").select(F.col("l_linestatus").alias("status")),
        table(spark, folder, "customer").select("c_custkey"),
    ]
    return clean.stack_tables(parts).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "class_set_difference",
    "select distinct o_orderpriority as label from orders except select distinct o_orderpriority from orders where o_totalprice < 500",
)
def class_set_difference(spark, folder):
    orders = table(spark, folder, "orders")
    return (
        orders.select(F.col("o_orderpriority").alias("label"))
        .distinct()
        .join(orders.where("o_totalprice < 500").select(F.col("o_orderpriority").alias("label")).distinct(), "label", "left_anti")
    )


@query(
    "label_union",
    "select o_orderstatus as label from orders union select l_returnflag from lineitem",
)
def label_union(spark, folder):
    a = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("label"))
    b = lines(spark, folder, "l_returnflag").select(F.col("l_returnflag").alias("label"))
    return a.distinct().union(b.distinct()).distinct()
