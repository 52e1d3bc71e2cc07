"""Column and row cleaning. Everything here is a projection or filter unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions.numeric import binarize, blank_to_int, finite, to_int
from flowlake.operators.ordering import forward_fill, label_last_n
from flowlake.operators.quantiles import quantile_columns

# Capture columns dropped in the first and in the second cleaning step.
CAPTURE_DROPS_FIRST = (
    "peer metric_type prefix name labels label_values value mem events_proc events_queued timers active_timers "
    "files active_files reassem_unknown_size unit trans_id software_type version.major version.minor version.addl "
    "unparsed_version port_num port_proto gaps ack action size times.modified times.accessed times.created "
    "times.changed mode stratum poll precision root_delay root_disp ref_id ref_time org_time rec_time xmt_time "
    "num_exts notice source uids mac requested_addr msg_types fingerprint certificate.version certificate.serial "
    "certificate.subject certificate.issuer certificate.not_valid_before certificate.not_valid_after "
    "certificate.key_alg certificate.sig_alg certificate.key_type certificate.key_length certificate.exponent "
    "san.dns basic_constraints.ca host_cert client_cert fuid depth analyzers mime_type resp_fuids resp_mime_types "
    "cert_chain_fps client_cert_chain_fps subject issuer sni_matches_cert client_addr version.minor2 host_p note "
    "msg sub src actions email_dest suppress_for direction level message location assigned_addr lease_time "
    "host_name md5 sha1 extracted"
).split()
CAPTURE_DROPS_SECOND = (
    "version curve server_name resumed established ssl_history addl user_agent certificate.curve referrer host "
    "server cipher tags uri service client host_key query qclass qclass_name qtype qtype_name rcode rcode_name AA "
    "TC RD RA Z answers TTLs rejected compression_alg host_key_alg orig_fuids orig_mime_types origin cause "
    "analyzer_kind analyzer_name failure_reason analyzer next_protocol id hashAlgorithm issuerNameHash "
    "issuerKeyHash serialNumber certStatus thisUpdate nextUpdate version.minor3 last_alert proxied request_type "
    "till forwardable renewable cookie cert_count dst p tunnel_type status request.host request_p bound.host "
    "bound_p client_scid failure_data san.ip resp_filenames"
).split()


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the listed columns; names the table lacks are ignored."""
    present = [c for c in df.columns if c in set(names)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in present]) if present else df


def standard_label(df: DataFrame, aliases: Sequence[str] = ("attack_cat", "Label"), label: str = "label") -> DataFrame:
    """Rename the first label alias found, only when ``label`` is absent; drop leftover first alias."""
    if label not in df.columns:
        for alias in aliases:
            if alias in df.columns:
                return df.withColumnRenamed(alias, label)
        return df
    return df.drop(aliases[0])


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def tidy_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim and lower-case."""
    return df.withColumns({c: F.lower(F.trim(F.col(c))) for c in columns})


def blanks_to_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: blank_to_int(c) for c in columns})


def binarized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: binarize(c) for c in columns})


def coerced_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_int(c) for c in columns})


def impute(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Missing and infinite numbers become the given constant (a fitted median, or 0)."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``impute`` with the median of the finite values; one aggregation, medians held on the driver."""
    q = quantile_columns(df, columns, [0.5])
    row = df.agg(*[q[c][0].alias(c) for c in columns]).first()
    return impute(df, {c: row[c] for c in columns})


def fill_then_drop(df: DataFrame, columns: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Forward fill in the given order, then drop rows that still miss a value."""
    return forward_fill(df, columns, order).dropna(subset=list(columns))


def numeric_order(text: Column) -> list[Column]:
    """What orders texts by the numbers they spell; all null for a text that spells none.

    Whole numbers of up to 38 digits and fractions of up to nine places compare exactly, others as doubles.
    """
    return [text.try_cast("double"), text.try_cast("decimal(38,0)"), text.try_cast("decimal(38,9)")]


def label_flag_last(df: DataFrame, order: Sequence[str], n: int = 10, out: str = "label") -> DataFrame:
    """0 everywhere, 1 on the last ``n`` rows by the order columns: other texts come after numbers."""
    latest = []
    for c in order:
        text = F.col(f"`{c}`")
        latest += [*[n.desc_nulls_first() for n in numeric_order(text)], text.desc()]
    return label_last_n(df, order[-1], latest, n, out)


def clamp_labels(df: DataFrame, label: str, classes: int, out: str = "clamped") -> DataFrame:
    """Labels forced into [0, classes-1]; ``out_of_range`` marks the rows that changed."""
    c = F.col(label)
    return df.withColumn(out, F.least(F.greatest(c, F.lit(0)), F.lit(classes - 1))).withColumn(
        "out_of_range", ~c.between(0, classes - 1)
    )


def deduplicate(df: DataFrame) -> DataFrame:
    """Distinct full rows; copies of one row are combined before the shuffle."""
    return df.distinct()


def null_extremes(df: DataFrame, columns: Sequence[str], factor: float = 10.0, floor: float = 1e6) -> DataFrame:
    """Infinite values and values above ``max(factor * q99, floor)`` become null."""
    limits = extreme_limits(df, columns, factor, floor)
    return df.withColumns(
        {c: F.when(finite(c) <= F.lit(limits[c]), F.col(c)) for c in columns if limits[c] is not None}
    )


def extreme_limits(df: DataFrame, columns: Sequence[str], factor: float, floor: float) -> dict[str, float | None]:
    q = quantile_columns(df, columns, [0.99])
    row = df.agg(*[q[c][0].alias(c) for c in columns]).first()
    return {c: None if row[c] is None else max(row[c] * factor, floor) for c in columns}


def extreme_report(
    df: DataFrame, columns: Sequence[str], factor: float = 10.0, floor: float = 1e6
) -> DataFrame:
    """Per column the limit and how many finite values exceed it."""
    limits = extreme_limits(df, columns, factor, floor)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(limits[c]).cast("double").alias("limit"),
            F.count_if(finite(c) > F.lit(limits[c])).alias("n_extreme"),
        )
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def cap_outliers(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Cap at a fitted bound, itself cast to the column's type (integers truncate); nulls stay."""
    out = {}
    for c, cap in caps.items():
        bound = F.lit(cap).cast(df.schema[c].dataType)
        out[c] = F.when(F.col(c) > bound, bound).otherwise(F.col(c))
    return df.withColumns(out)


def features_and_label(
    df: DataFrame, features: Sequence[str], label: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    """One ``features`` array plus ``label`` (null when the table is unlabeled) and the kept keys."""
    y = F.col(label) if label in df.columns else F.lit(None).cast("int")
    return df.select(
        *keep, F.array(*[F.col(c).cast("double") for c in features]).alias("features"), y.alias("label")
    )


def typed_columns(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind, from the schema alone."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    return {"numeric": numeric, "categorical": text}


def stack_tables(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns a part lacks become null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
