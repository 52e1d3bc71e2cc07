"""Positional operators without a single-task sort.

A layout is one range shuffle: rows sorted by the order key, cut into slices and written
once with (slice, offset). Ranks, running totals and carried values then need only one
small row per slice (and group) to connect the slices, so no task ever holds a whole
table or a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import shuffle_width
from flowlake.sources.durable import counted_broadcast, durable

# monotonically_increasing_id() keeps the partition number above this bit.
_OFFSET_BITS = 33
_LITERAL_SLICES = 2_000


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lay_out(
    df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Range-sorted, written copy of ``df`` with ``_slice`` and ``_offset``.

    ``order`` should end in a unique key so that ties cannot collapse into one slice.
    """
    keys = [F.col(g) for g in group] + [_as_col(c) for c in order]
    laid = (
        df.repartitionByRange(slices or shuffle_width(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", _OFFSET_BITS).cast("int"))
        .withColumn("_offset", F.col("_id").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)))
        .drop("_id")
    )
    return durable(laid, "layout")


def _links(laid: DataFrame, group: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """One row per (slice, group) with the totals of that piece."""
    return laid.groupBy("_slice", *group).agg(*[e.alias(n) for n, e in totals.items()])


def _attach(laid: DataFrame, links: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join the links back on (slice, group), null-safe in the group columns.

    Without groups there is one link per slice, a bound the layout itself sets. With groups
    there is one more per group, so the links are written and counted before a broadcast.
    """
    on = laid["_slice"] == F.col("_link_slice")
    links = links.withColumnRenamed("_slice", "_link_slice")
    for g in group:
        links = links.withColumnRenamed(g, f"_link_{g}")
        on = on & laid[g].eqNullSafe(F.col(f"_link_{g}"))
    small = counted_broadcast(durable(links, "links")) if group else F.broadcast(links)
    return laid.join(small, on, "inner").drop("_link_slice", *[f"_link_{g}" for g in group])


def with_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    out: str = "rank",
    slices: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row by ``order``, inside ``group`` when given.

    ``size`` names an optional column with the row count of the row's group.
    """
    laid = lay_out(df, order, group, slices)
    if not group:
        return _rank_whole(laid, out, size)
    links = _links(laid, group, {"_rows": F.count("*"), "_first": F.min("_offset")})
    across = Window.partitionBy(*group)
    earlier = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    links = links.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if size:
        links = links.withColumn(size, F.sum("_rows").over(across))
    ranked = _attach(laid, links.drop("_rows"), group).withColumn(
        out, F.col("_before") + F.col("_offset") - F.col("_first")
    )
    return ranked.drop("_slice", "_offset", "_before", "_first")


def _rank_whole(laid: DataFrame, out: str, size: str | None) -> DataFrame:
    """Rank over the whole table from one row count per slice.

    Few slices travel as literals, so no join is needed; many as a broadcast table whose
    row count is the number of slices.
    """
    counts = laid.groupBy("_slice").agg(F.count("*").alias("_rows"))
    rows = {r["_slice"]: r["_rows"] for r in counts.collect()}
    total = sum(rows.values())
    if len(rows) <= _LITERAL_SLICES:
        starts, before = [], 0
        for piece in range(max(rows, default=-1) + 1):
            starts.append(before)
            before += rows.get(piece, 0)
        start = F.array(*[F.lit(s).cast("bigint") for s in starts or [0]])[F.col("_slice")]
        ranked = laid.withColumn(out, start + F.col("_offset"))
    else:
        earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        links = counts.select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
        ranked = _attach(laid, links, ()).withColumn(out, F.col("_before") + F.col("_offset")).drop("_before")
    if size:
        ranked = ranked.withColumn(size, F.lit(total).cast("bigint"))
    return ranked.drop("_slice", "_offset")


def running_sum(
    df: DataFrame,
    values: dict[str, str],
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Cumulative sums (``{output: input column}``) by ``order`` inside ``group``."""
    laid = lay_out(df, order, group, slices)
    links = _links(laid, group, {f"_sum_{o}": F.sum(c) for o, c in values.items()})
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    for out in values:
        links = links.withColumn(f"_sum_{out}", F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)))
    inside = (
        Window.partitionBy("_slice", *group).orderBy("_offset").rowsBetween(Window.unboundedPreceding, 0)
    )
    local = laid
    for out, column in values.items():
        local = local.withColumn(out, F.sum(column).over(inside))
    summed = _attach(local, links, group)
    for out in values:
        summed = summed.withColumn(out, F.col(out) + F.col(f"_sum_{out}")).drop(f"_sum_{out}")
    return summed.drop("_slice", "_offset")


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Replace nulls by the last earlier non-null value in order."""
    laid = lay_out(df, order, group, slices)
    links = _links(
        laid,
        group,
        {f"_last_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_offset"))) for c in columns},
    )
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    for c in columns:
        links = links.withColumn(f"_last_{c}", F.last(f"_last_{c}", ignorenulls=True).over(earlier))
    inside = (
        Window.partitionBy("_slice", *group).orderBy("_offset").rowsBetween(Window.unboundedPreceding, 0)
    )
    local = laid
    for c in columns:
        local = local.withColumn(c, F.last(c, ignorenulls=True).over(inside))
    filled = _attach(local, links, group)
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.col(f"_last_{c}"))).drop(f"_last_{c}")
    return filled.drop("_slice", "_offset")


def positional_windows(
    df: DataFrame, order: Sequence[str | Column], windows: int = 10, out: str = "window", rank: str = "rank"
) -> DataFrame:
    """``windows`` consecutive blocks of floor(n/windows) rows; the last takes the remainder.

    Not ``ntile``, which spreads the remainder over the first blocks.
    """
    ranked = with_rank(df, order, out=rank, size="_n")
    width = F.greatest(F.floor(F.col("_n") / windows), F.lit(1))
    return ranked.withColumn(
        out, F.least(F.floor(F.col(rank) / width), F.lit(windows - 1)).cast("int")
    ).withColumnRenamed("_n", "n_rows")


def label_last_n(
    df: DataFrame, key: str, order: Sequence[Column], n: int = 10, out: str = "label"
) -> DataFrame:
    """1 on the last ``n`` rows by order, 0 elsewhere (``key`` is unique).

    ``order`` is given latest-first. The tail is a distributed top-n and holds n rows, so
    its broadcast is bounded by the argument.
    """
    tail = df.orderBy(*order).limit(n).select(F.col(key).alias("_tail"))
    marked = df.join(F.broadcast(tail), F.col(key) == F.col("_tail"), "left")
    return marked.withColumn(out, F.col("_tail").isNotNull().cast("int")).drop("_tail")


def shuffled(df: DataFrame, key: str) -> DataFrame:
    """Rows in the md5 order of their key: a reproducible shuffle (one range sort)."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key)
