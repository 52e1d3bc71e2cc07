"""Profiling queries over line items, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import profile, quantiles
from flowlake.plans.inputs import DIRTY_SQL, NUMERIC, dirty_events, lines
from flowlake.plans.registry import query, r6, table


def _each(select: str, source: str = "lineitem", columns=NUMERIC) -> str:
    return "\nunion all\n".join(f"select '{c}' as \"column\", {select.replace('$c', c)} from {source}" for c in columns)


def _rounded(df, *keep: str, digits: int = 4):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


@query(
    "numeric_stats",
    _each(
        "round(avg($c), 4) as mean, round(stddev_samp($c), 4) as std, round(median($c), 4) as median, round(quantile_cont($c, 0.99), 4) as q99"
    ),
)
def numeric_stats(spark, folder):
    return _rounded(profile.numeric_stats(lines(spark, folder, *NUMERIC), NUMERIC), "column")


@query(
    "numeric_stats_narrowed",
    _each("round(median($c), 4) as median, round(quantile_cont($c, 0.99), 4) as q99"),
)
def numeric_stats_narrowed(spark, folder):
    """The same quantiles by narrowing, the way taken for tables too large for one task."""
    df = lines(spark, folder, *NUMERIC)
    q = quantiles.quantile_columns(df, NUMERIC, [0.5, 0.99])
    got = df.agg(
        F.array(*[F.struct(F.lit(c).alias("column"), q[c][0].alias("median"), q[c][1].alias("q99")) for c in NUMERIC]).alias("e")
    )
    return _rounded(got.select(F.inline("e")), "column")


@query(
    "range_stats",
    _each("round(min($c), 4) as min, round(max($c), 4) as max, round(median($c), 4) as median"),
)
def range_stats(spark, folder):
    return _rounded(profile.range_stats(lines(spark, folder, *NUMERIC), NUMERIC), "column")


@query(
    "describe_numeric",
    _each(
        "count($c) as n, round(avg($c), 4) as mean, round(stddev_samp($c), 4) as std, round(min($c), 4) as min, round(quantile_cont($c, 0.25), 4) as q25, "
        "round(median($c), 4) as q50, round(quantile_cont($c, 0.75), 4) as q75, round(max($c), 4) as max"
    ),
)
def describe_numeric(spark, folder):
    return _rounded(profile.five_numbers(lines(spark, folder, *NUMERIC), NUMERIC), "column", "n")


_TEXT = ["o_orderstatus", "o_orderpriority"]


@query(
    "describe_text",
    "with v as ("
    + " union all ".join(f"select '{c}' as \"column\", {c} as value, count(*) as n from orders group by {c}" for c in _TEXT)
    + """)
select "column", cast(sum(n) as bigint) as n, count(*) as n_unique, max(n) as freq,
  (select min(value) from v w where w."column" = v."column" and w.n = max(v.n)) as top from v group by "column" """,
)
def describe_text(spark, folder):
    return profile.describe_text(table(spark, folder, "orders").select(*_TEXT), _TEXT)


@query(
    "iqr_bounds",
    _each(
        "round(quantile_cont($c, 0.25) - 1.5 * (quantile_cont($c, 0.75) - quantile_cont($c, 0.25)), 4) as lower, "
        "round(quantile_cont($c, 0.75) + 1.5 * (quantile_cont($c, 0.75) - quantile_cont($c, 0.25)), 4) as upper, round(median($c), 4) as median"
    ),
)
def iqr_bounds(spark, folder):
    return _rounded(profile.iqr_bounds(lines(spark, folder, *NUMERIC), NUMERIC), "column")


@query(
    "missing_report",
    DIRTY_SQL
    + """select 'value' as "column", count(*) filter (value is null or isnan(value)) as n_missing,
  round(count(*) filter (value is null or isnan(value)) * 100.0 / count(*), 2) as pct_missing from dirty
union all select 'raw_type', count(*) filter (raw_type is null), round(count(*) filter (raw_type is null) * 100.0 / count(*), 2) from dirty
union all select 'port', count(*) filter (port is null), round(count(*) filter (port is null) * 100.0 / count(*), 2) from dirty""",
)
def missing_report(spark, folder):
    names = ["value", "raw_type", "port"]
    return profile.missing_report(dirty_events(spark, folder).select(*names), names)


@query(
    "distinct_counts",
    "\nunion all\n".join(
        f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from lineitem"
        for c in ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", "l_partkey"]
    ),
)
def distinct_counts(spark, folder):
    names = ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", "l_partkey"]
    return profile.distinct_counts(lines(spark, folder, *names), names)


@query(
    "column_values",
    """select 'l_returnflag' as "column", l_returnflag as value, count(*) as n from lineitem group by l_returnflag
union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by l_linestatus""",
)
def column_values(spark, folder):
    names = ["l_returnflag", "l_linestatus"]
    return profile.column_values(lines(spark, folder, *names), names)


@query(
    "duplicate_count",
    """select count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem)) as n_duplicates from lineitem""",
)
def duplicate_count(spark, folder):
    return profile.duplicate_count(lines(spark, folder, "l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "skewness",
    """with m as (select avg(value) as a, avg(user_id) as b from events)
select 'value' as "column", round(avg(power(value - a, 3)) / power(avg(power(value - a, 2)), 1.5), 6) as skewness from events, m
union all select 'user_id', round(avg(power(user_id - b, 3)) / power(avg(power(user_id - b, 2)), 1.5), 6) from events, m""",
)
def skewness(spark, folder):
    got = profile.skewness(table(spark, folder, "events").select("value", "user_id"), ["value", "user_id"])
    return got.withColumn("skewness", r6("skewness"))


_CORRELATED = {
    "price": "l_extendedprice",
    "quantity": "l_quantity",
    "gross": "l_extendedprice * (1 + l_tax)",
    "net": "l_extendedprice * (1 - l_discount)",
    "number": "cast(l_linenumber as double)",
}


def _correlated(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _CORRELATED.items()])


def _corr_sql() -> str:
    names = list(_CORRELATED)
    return "\nunion all\n".join(
        f"select '{a}' as a, '{b}' as b, corr({_CORRELATED[a]}, {_CORRELATED[b]}) as r from lineitem"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    )


@query("correlation_pairs", f"select a, b, round(r, 6) as r from ({_corr_sql()})")
def correlation_pairs(spark, folder):
    return profile.correlation_pairs(_correlated(spark, folder), list(_CORRELATED)).withColumn("r", r6("r"))


@query("correlated_pairs", f"select a, b, round(r, 6) as r from ({_corr_sql()}) where r >= 0.75")
def correlated_pairs(spark, folder):
    return profile.correlated_pairs(_correlated(spark, folder), list(_CORRELATED)).withColumn("r", r6("r"))


@query("drop_redundant_columns", "select l_extendedprice as price, l_quantity as quantity, cast(l_linenumber as double) as number from lineitem")
def drop_redundant_columns(spark, folder):
    df = _correlated(spark, folder)
    return df.drop(*profile.redundant_columns(df, list(_CORRELATED)))


def _mi_sql() -> str:
    parts = "\nunion all\n".join(
        f"""select '{c}' as "column", l_returnflag as label,
  least(cast(floor(({c} - (select min({c}) from lineitem)) / ((select max({c}) - min({c}) from lineitem) / 10.0)) as int), 9) as bin from lineitem"""
        for c in NUMERIC
    )
    return f"""with b as ({parts}),
j as (select "column", bin, label, count(*) as n from b group by all),
t as (select *, sum(n) over (partition by "column") as tot, sum(n) over (partition by "column", bin) as nb,
  sum(n) over (partition by "column", label) as nl from j)
select "column", round(sum(n / tot * ln(n * tot / (nb * nl))), 6) as mi from t group by "column" order by mi desc"""


@query("mutual_information", _mi_sql())
def mutual_information(spark, folder):
    got = profile.mutual_information(lines(spark, folder, "l_returnflag", *NUMERIC), NUMERIC, "l_returnflag")
    return got.withColumn("mi", r6("mi")).orderBy(F.desc("mi"))


@query(
    "drop_uninformative",
    f"select \"column\" from ({_mi_sql()}) where mi >= 0.0001",
)
def drop_uninformative(spark, folder):
    got = profile.mutual_information(lines(spark, folder, "l_returnflag", *NUMERIC), NUMERIC, "l_returnflag")
    return got.where(F.round("mi", 6) >= 0.0001).select("column")


def _hist_sql() -> str:
    return "\nunion all\n".join(
        f"""select '{c}' as "column", cast(bin as int) as bin, round(lo + bin * (hi - lo) / 10.0, 4) as bin_start, round(lo + (bin + 1) * (hi - lo) / 10.0, 4) as bin_end, count(*) as n
from (select least(floor(({c} - lo) / ((hi - lo) / 10.0)), 9) as bin, lo, hi from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem))
group by bin, lo, hi"""
        for c in NUMERIC
    )


@query("histogram", _hist_sql())
def histogram(spark, folder):
    got = profile.histogram(lines(spark, folder, *NUMERIC), NUMERIC)
    return got.withColumn("bin_start", F.round("bin_start", 4)).withColumn("bin_end", F.round("bin_end", 4))


@query(
    "split_statistics",
    """select cast(null as varchar) as split, cast(null as varchar) as event_type, count(*) as n from events
union all select split, null, count(*) from s group by split union all select split, event_type, count(*) from s group by split, event_type""".replace(
        " from s ",
        """ from (select event_type, case when row_number() over (partition by event_type
  order by md5(cast(event_id as varchar)), event_id) <= round(0.2 * count(*) over (partition by event_type)) then 'test' else 'train' end as split from events) """,
    ),
)
def split_statistics(spark, folder):
    from flowlake.operators.splits import stratified_split

    events = table(spark, folder, "events").select("event_id", "event_type")
    return profile.split_statistics(stratified_split(events, "event_id", "event_type"), "split", "event_type")


@query("explained_variance")
def explained_variance(spark, folder):
    return profile.explained_variance(table(spark, folder, "embeddings").select("embedding"), "embedding", 10)


@query(
    "value_counts",
    "select event_type as value, count(*) as n from events group by 1 order by n desc, value",
)
def value_counts(spark, folder):
    got = table(spark, folder, "events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return got.orderBy(F.desc("n"), "value")


@query(
    "top_columns",
    f"select \"column\", mi from ({_mi_sql()}) order by mi desc, \"column\" limit 3",
)
def top_columns(spark, folder):
    got = profile.mutual_information(lines(spark, folder, "l_returnflag", *NUMERIC), NUMERIC, "l_returnflag")
    return got.withColumn("mi", r6("mi")).orderBy(F.desc("mi"), "column").limit(3)
