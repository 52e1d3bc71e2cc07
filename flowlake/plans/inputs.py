"""Inputs the queries share: the given tables with the dirt and roles of flow data.

Dirt is placed by the first md5 digit of the row key, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.plans.registry import table

# events with missing, NaN and infinite values, padded text, blanks and hex numbers
DIRTY_SQL = """with dirty as (
  select event_id, ts, user_id, event_type,
         case substr(md5(cast(event_id as varchar)), 1, 1)
           when '0' then null when '1' then cast('nan' as double) when '2' then cast('inf' as double)
           when '3' then cast('-inf' as double) else value end as value,
         case substr(md5(cast(event_id as varchar)), 1, 1)
           when '4' then null when '5' then '  ' || upper(event_type) || ' ' else event_type end as raw_type,
         case substr(md5(cast(event_id as varchar)), 1, 1)
           when '6' then ' ' when '7' then '0x' || cast(user_id as varchar) when '8' then 'http'
           else cast(user_id as varchar) end as port,
         cast(user_id % 4 as int) - 1 as level
  from events)
"""


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    digit = F.substring(F.md5(F.col("event_id").cast("string")), 1, 1)
    inf = F.lit(float("inf"))
    user = F.col("user_id").cast("string")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.when(digit == "0", F.lit(None).cast("double"))
        .when(digit == "1", F.lit(float("nan")))
        .when(digit == "2", inf)
        .when(digit == "3", -inf)
        .otherwise(F.col("value"))
        .alias("value"),
        F.when(digit == "4", F.lit(None).cast("string"))
        .when(digit == "5", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
        .otherwise(F.col("event_type"))
        .alias("raw_type"),
        F.when(digit == "6", " ")
        .when(digit == "7", F.concat(F.lit("0x"), user))
        .when(digit == "8", "http")
        .otherwise(user)
        .alias("port"),
        ((F.col("user_id") % 4).cast("int") - 1).alias("level"),
    )


# line items in the roles of the two flow directions
FLOW_ROLES = {
    "start": "l_orderkey",
    "end": "l_partkey",
    "src_bytes": "l_extendedprice",
    "dst_bytes": "l_quantity",
    "src_pkts": "l_quantity",
    "dst_pkts": "l_linenumber",
    "src_load": "l_extendedprice",
    "dst_load": "l_tax",
    "src_jit": "l_tax",
    "dst_jit": "l_discount",
    "src_gap": "l_discount",
    "dst_gap": "l_linenumber",
    "rtt": "l_tax",
    "synack": "l_discount",
    "ackdat": "l_linenumber",
    "src_size": "l_quantity",
    "dst_size": "l_linenumber",
    "src_seq": "l_partkey",
    "dst_seq": "l_suppkey",
}

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Line items, only the named columns."""
    return table(spark, folder, "lineitem").select(*columns)


CLASSES = 10
_DIMS = 64


def _logit_terms(cell: str) -> list[str]:
    """Class k sums every tenth vector entry from k on; ``cell`` formats a 0-based entry."""
    return ["(" + " + ".join(cell.format(j) for j in range(k, _DIMS, CLASSES)) + ") * 2" for k in range(CLASSES)]


# vectors with ten class logits; two thirds of the rows lean towards their label
SCORED_SQL = (
    "with logit as (select vec_id, label, unnest(range(10)) as k, unnest(["
    + ", ".join(_logit_terms("cast(embedding[{0} + 1] as double)"))
    + """]) as raw from embeddings),
scored as (
  select vec_id, cast(label as int) as label, cast(k as int) as k,
         raw + case when k = label and substr(md5(cast(vec_id as varchar)), 1, 1) < 'a' then 2.0 else 0.0 end as z
  from logit),
prob as (
  select vec_id, label, k, z, exp(z - m) / sum(exp(z - m)) over (partition by vec_id) as p,
         z - m - ln(sum(exp(z - m)) over (partition by vec_id)) as logp
  from (select *, max(z) over (partition by vec_id) as m from scored)),
pred as (select vec_id, label, cast(arg_max(k, p) as int) as pred, max(p) as top from prob group by vec_id, label)
"""
)


def scored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, label, logits, probs, pred."""
    from flowlake.functions import scores as S

    raw = F.expr("array(" + ", ".join(_logit_terms("cast(embedding[{0}] as double)")) + ")")
    lean = F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "a"
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", "label", raw.alias("raw"))
        .select(
            "vec_id",
            "label",
            F.transform("raw", lambda v, k: v + F.when((k == F.col("label")) & lean, 2.0).otherwise(0.0)).alias(
                "logits"
            ),
        )
        .withColumn("probs", S.softmax("logits"))
        .withColumn("pred", S.argmax("probs"))
    )


# events as a classified stream: hard predictions per day (round) and user group (client)
CLIENTS = 5
ROUNDS_SQL = """with classified as (
  select event_id, cast(floor(epoch_us(ts) / 86400000000) as bigint) as round, cast(user_id % 5 as int) as client,
         cast(case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as int) as label,
         cast(case when value < 20 then case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end
              else floor(value) % 5 end as int) as pred
  from events),
cm as (select round, client, label, pred, count(*) as n from classified group by all),
counts as (
  select round, client, c.k,
         coalesce(sum(n) filter (label = k), 0) as support, coalesce(sum(n) filter (pred = k), 0) as predicted,
         coalesce(sum(n) filter (label = k and pred = k), 0) as hit
  from cm, range(5) c(k) group by all),
classes as (
  select round, client, cast(k as int) as k, cast(support as bigint) as support,
         case when predicted > 0 then hit / predicted else 0 end as "precision",
         case when support > 0 then hit / support else 0 end as recall,
         case when support + predicted > 0 then 2 * hit / (support + predicted) else 0 end as f1
  from counts),
metric as (
  select round, client, cast(sum(support) as bigint) as n, sum("precision" * support) / sum(support) as "precision",
         sum(recall * support) / sum(support) as recall, sum(f1 * support) / sum(support) as f1
  from classes group by all)
"""


def classified_events(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, round (day number), client, label 0..4, pred 0..4."""
    code = (
        F.when(F.col("event_type") == "click", 0)
        .when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 3)
        .otherwise(4)
    )
    day = F.expr("date_diff(cast(ts as date), date'1970-01-01')").cast("bigint")
    return table(spark, folder, "events").select(
        "event_id",
        day.alias("round"),
        (F.col("user_id") % CLIENTS).cast("int").alias("client"),
        code.alias("label"),
        F.when(F.col("value") < 20, code).otherwise((F.floor("value") % 5).cast("int")).alias("pred"),
    )


# line items as classified flows: seven features, a label that depends on two of them, an owner
FLOW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey"]
FLOW_CLASSES = 5
FLOW_LABEL = (
    "case when l_extendedprice * (1 - l_discount) < 20000 then 0 "
    "when l_extendedprice * (1 - l_discount) < 50000 then case when l_quantity < 25 then 1 else 2 end "
    "when l_quantity < 25 then 3 else 4 end"
)
FLOW_ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """flow_id, label 0..4, client 0..4, held_out, and the features."""
    return table(spark, folder, "lineitem").selectExpr(
        f"{FLOW_ID} as flow_id",
        f"cast({FLOW_LABEL} as int) as label",
        "cast(l_suppkey % 5 as int) as client",
        f"substr(md5({FLOW_ID}), 1, 1) < '3' as held_out",
        *FLOW_FEATURES,
    )
