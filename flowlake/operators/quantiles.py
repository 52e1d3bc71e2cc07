"""Exact linear-interpolation quantiles for any table size, by one path.

The built-in exact ``percentile`` merges every distinct value into one task. Here a sketch pass gives
a bracket around each wanted order statistic, a counting pass proves the brackets (one that fails is widened),
and a third pass counts the few values inside them per value, into a small written table. On that table the
k-th value is found by counting sub-brackets until few values are left to rank. Each pass is one aggregation over all columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.numeric import finite
from flowlake.sources.durable import durable

# A sketch's ranks are off by at most one part in so many; brackets reach twice that far to either side.
_ACCURACY = 2_000
# Values of a bracket that one task may rank, and sub-brackets counted at a time beyond that.
_CANDIDATES = 500_000
_PARTS = 1_024

# (column number, position in its order)
_Key = tuple[int, int]


def quantile_columns(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[Column]]:
    """Per column the quantiles as expressions for a ``df.agg`` (missing and infinite skipped)."""
    values = narrowed_quantiles(df, columns, probs)
    # max(lit) keeps the expression an aggregate, also with groups or without other aggregates
    return {c: [F.max(F.lit(v)) for v in values[c]] for c in columns}


def narrowed_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], candidates: int = _CANDIDATES, accuracy: int = _ACCURACY
) -> dict[str, list[float | None]]:
    """Quantile values found by narrowing; the driver holds one bracket per order statistic."""
    clean = df.select(*[finite(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sizes, brackets = _brackets(clean, len(columns), probs, accuracy)
    found = _values(clean, _proved(clean, sizes, brackets, accuracy), candidates) if brackets else {}
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        result[c] = [None] * len(probs)
        for j, p in enumerate(probs if sizes[i] else ()):
            h = (sizes[i] - 1) * p
            a, b = found[i, math.floor(h)], found[i, math.ceil(h)]
            result[c][j] = float(a + (b - a) * (h - math.floor(h)))
    return result


def _ends(share: float, slack: float) -> tuple[float, float]:
    return max(0.0, share - slack), min(1.0, share + slack)


def _brackets(clean: DataFrame, columns: int, probs: Sequence[float], accuracy: int) -> tuple[list[int], dict[_Key, tuple[float, float]]]:
    """Rows of each column, and a bracket around every order statistic that the quantiles need: one sketch pass."""
    slack = 2.0 / accuracy
    shares = sorted({e for p in probs for e in _ends(p, slack)})
    row = clean.agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(columns)],
        *[F.percentile_approx(f"c{i}", shares, accuracy).alias(f"s{i}") for i in range(columns)],
    ).first()
    found: dict[_Key, tuple[float, float]] = {}
    for i in range(columns):
        if not row[f"n{i}"]:
            continue
        at = dict(zip(shares, row[f"s{i}"]))
        for p in probs:
            low, high = _ends(p, slack)
            h = (row[f"n{i}"] - 1) * p
            for k in {math.floor(h), math.ceil(h)}:
                # ends of the table need no sketch
                found[i, k] = (at[low] if low > 0 else -math.inf, at[high] if high < 1 else math.inf)
    return [row[f"n{i}"] for i in range(columns)], found


def _proved(clean: DataFrame, sizes: list[int], brackets: dict[_Key, tuple[float, float]], accuracy: int) -> dict[_Key, tuple[float, float, int, int]]:
    """(low, high, values below, values inside) of brackets that hold their order statistic; others are widened and counted again."""
    proved: dict[_Key, tuple[float, float, int, int]] = {}
    open_ = dict(brackets)
    slack = 2.0 / accuracy
    while open_:
        keys = list(open_)
        row = clean.agg(
            *[F.count_if(F.col(f"c{k[0]}") < open_[k][0]).alias(f"b{j}") for j, k in enumerate(keys)],
            *[F.count_if(F.col(f"c{k[0]}") <= open_[k][1]).alias(f"u{j}") for j, k in enumerate(keys)],
        ).first()
        failed = []
        for j, k in enumerate(keys):
            below, upto = row[f"b{j}"], row[f"u{j}"]
            if below <= k[1] < upto:
                proved[k] = (*open_[k], below, upto - below)
            else:
                failed.append(k)
        open_ = {}
        if failed:
            slack *= 8
            ends = [_ends((k[1] + 0.5) / sizes[k[0]], slack) for k in failed]
            wider = clean.agg(*[F.percentile_approx(f"c{k[0]}", list(e), accuracy).alias(f"s{j}") for j, (k, e) in enumerate(zip(failed, ends))]).first()
            for j, (k, (low, high)) in enumerate(zip(failed, ends)):
                open_[k] = (wider[f"s{j}"][0] if low > 0 else -math.inf, wider[f"s{j}"][1] if high < 1 else math.inf)
    return proved


def _values(clean: DataFrame, proved: dict[_Key, tuple[float, float, int, int]], candidates: int) -> dict[_Key, float]:
    """The wanted order statistics. Brackets that are equal share their values."""
    shared: dict[tuple, list[_Key]] = {}
    for key, (low, high, below, inside) in proved.items():
        shared.setdefault((key[0], low, high, below, inside), []).append(key)
    spans = list(shared)
    inside = [F.col(f"c{i}").between(low, high) for i, low, high, _, _ in spans]
    cells = [c for j, (i, *_) in enumerate(spans) for c in (F.lit(j), F.when(inside[j], F.col(f"c{i}")))]
    # only rows with a value inside some bracket are spread out; copies of a value are combined before the shuffle
    held = clean.where(reduce(or_, inside)).select(F.stack(F.lit(len(spans)), *cells).alias("j", "v"))
    counted = durable(held.where(F.col("v").isNotNull()).groupBy("j", "v").agg(F.count("*").alias("n")), "brackets")
    wanted = [(j, key[1] - spans[j][3], key) for j, span in enumerate(spans) for key in shared[span]]
    found: dict[_Key, float] = {}
    large = [w for w in wanted if spans[w[0]][4] > candidates]
    found.update(_ranked(counted, [w for w in wanted if spans[w[0]][4] <= candidates]))
    for w in large:
        found.update(_searched(counted.where(F.col("j") == w[0]), w, candidates))
    return found


def _ranked(counted: DataFrame, wanted: list[tuple[int, int, _Key]]) -> dict[_Key, float]:
    """The values at the wanted positions of brackets that hold few values."""
    if not wanted:
        return {}
    upto = Window.partitionBy("j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).cast("bigint").alias("k"), F.lit(number).alias("number")) for number, (j, k, _) in enumerate(wanted)])
    rows = (
        counted.where(F.col("j").isin(sorted({w[0] for w in wanted})))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("at", F.filter(places, lambda p: (p["j"] == F.col("j")) & (p["k"] >= F.col("upto") - F.col("n")) & (p["k"] < F.col("upto"))))
        .select(F.explode("at.number").alias("number"), "v")
        .collect()  # one row for each wanted position
    )
    return {wanted[r["number"]][2]: r["v"] for r in rows}


def _searched(counted: DataFrame, wanted: tuple[int, int, _Key], candidates: int) -> dict[_Key, float]:
    """One value of a bracket with many: sub-brackets of equal width are counted until one holds few distinct values."""
    j, k, key = wanted
    while True:
        span = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct")).first()
        if span["distinct"] <= candidates or not math.isfinite(span["hi"] - span["lo"]):
            return _ranked(counted, [(j, k, key)])
        part = F.least(F.lit(_PARTS - 1), F.floor((F.col("v") - F.lit(span["lo"])) / F.lit(span["hi"] - span["lo"]) * _PARTS)).cast("int")
        cells = counted.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).orderBy("part").collect()  # at most _PARTS rows
        for cell in cells:
            if k < cell["n"]:
                counted = counted.where(part == cell["part"])
                break
            k -= cell["n"]
