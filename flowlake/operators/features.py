"""Engineered flow features and fitted column transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.numeric import finite, ratio, skew_transform, standard_scale
from flowlake.operators.quantiles import quantile_columns


def flow_features(df: DataFrame, of: Mapping[str, str]) -> DataFrame:
    """Durations, ratios, sums and products of the two flow directions.

    ``of`` maps the roles (start, end, src_bytes, dst_bytes, src_pkts, dst_pkts, src_load,
    dst_load, src_jit, dst_jit, src_gap, dst_gap, rtt, synack, ackdat, src_size, dst_size,
    src_seq, dst_seq) to the table's columns.
    """
    c = {role: F.col(name) for role, name in of.items()}
    pair = {"byte": "bytes", "pkt": "pkts", "load": "load", "jit": "jit", "inter_pkt": "gap"}
    new = {"duration": c["end"] - c["start"]}
    for name, role in pair.items():
        new[f"{name}_ratio"] = ratio(c[f"src_{role}"], c[f"dst_{role}"])
        new["total_jitter" if name == "jit" else f"total_{name}s" if name in ("byte", "pkt") else f"total_{name}"] = c[f"src_{role}"] + c[f"dst_{role}"]
    new["tcp_setup_ratio"] = ratio(c["rtt"], c["synack"] + c["ackdat"])
    new["total_tcp_setup"] = c["rtt"] + c["synack"] + c["ackdat"]
    for side in ("src", "dst"):
        new[f"byte_pkt_interaction_{side}"] = c[f"{side}_bytes"] * c[f"{side}_pkts"]
        new[f"load_jit_interaction_{side}"] = c[f"{side}_load"] * c[f"{side}_jit"]
        new[f"pkt_jit_interaction_{side}"] = c[f"{side}_pkts"] * c[f"{side}_jit"]
    new["mean_pkt_size"] = c["src_size"] + c["dst_size"]
    new["tcp_seq_diff"] = c["src_seq"] - c["dst_seq"]
    return df.withColumns(new)


def fence_outliers(df: DataFrame, columns: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Values outside the IQR fence become the median; bounds are a few numbers per column."""
    q = quantile_columns(df, columns, [0.25, 0.5, 0.75])
    row = df.agg(*[q[c][i].alias(f"{c}_{i}") for c in columns for i in range(3)]).first()
    out = {}
    for c in columns:
        low, mid, high = (row[f"{c}_{i}"] for i in range(3))
        if mid is None:
            continue
        lo, hi = low - whisker * (high - low), high + whisker * (high - low)
        x = F.col(c).cast("double")
        out[c] = F.when((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(float(mid))).otherwise(x)
    return df.withColumns(out)


def unskew(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Log transform chosen by the sign of each column's skewness (one statistics pass)."""
    row = df.agg(
        *[F.skewness(finite(c)).alias(f"s_{c}") for c in columns],
        *[F.max(finite(c)).cast("double").alias(f"m_{c}") for c in columns],
    ).first()
    return df.withColumns(
        {
            c: skew_transform(c, F.lit(row[f"s_{c}"]).cast("double"), F.lit(row[f"m_{c}"]).cast("double"))
            for c in columns
        }
    )


def fit_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column."""
    row = df.agg(
        *[F.avg(finite(c)).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(finite(c)).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: standard_scale(F.col(c), F.lit(m).cast("double"), F.lit(s).cast("double")) for c, (m, s) in fitted.items()}
    )
