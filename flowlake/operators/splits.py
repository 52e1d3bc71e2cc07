"""Train/test splits and client assignment by exact per-stratum quotas.

Rows of a stratum are taken in md5 order of their key, so every split is random-looking,
reproducible and independent of row placement. Exact quotas need no sort of the table: a
count per (stratum, leading hash digits) locates each cut; a cell that still holds too many rows is
counted by its next digits, and so on; only the rows inside the last, small cell are ranked to
find the hash at the cut, and every row is then placed by comparing its own hash. A stratum holding a
third of all rows never meets in one task, and the result is a projection of the input with one small join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.hashing import hash_key
from flowlake.operators.ordering import positional_windows
from flowlake.sources.durable import counted_broadcast, durable

_DIGITS = 3
# Rows of a cell that one task may rank, and the digits a hash has.
_RANKED = 100_000
_HASH_DIGITS = 32


def cut_segments(
    df: DataFrame,
    key: str,
    ends: Callable[[Column], Column],
    strata: Sequence[str] = (),
    out: str = "segment",
    salt: str | Column | None = None,
    digits: int = _DIGITS,
    ranked: int = _RANKED,
) -> DataFrame:
    """Number each row with the segment its md5 position falls in.

    ``ends(n)`` gives the ascending, exclusive end positions of all segments but the last
    for a stratum of ``n`` rows. Null strata form a stratum of their own. ``key`` should be unique in its
    stratum: rows with one key stay together. ``salt``, a text or a column, is hashed before the key.
    """
    before = [F.lit(salt) if isinstance(salt, str) else salt] if salt is not None else []
    hashed = df.withColumn("_hash", hash_key(*before, key))
    cuts = _cuts(hashed, ends, strata, digits, ranked)
    marks = durable(_cut_marks(hashed, cuts, key, strata), "marks")

    def passed(mark: Column) -> Column:
        return (F.col("_hash") > mark["hash"]) | ((F.col("_hash") == mark["hash"]) & (F.col(key) >= mark["key"]))

    if strata:
        placed = _join_cells(hashed, marks, strata, "left")
        number = F.coalesce(F.size(F.filter("_marks", passed)), F.lit(0))
    else:
        # one row of marks at most: plain literals, no join
        row = marks.first()
        number = F.lit(0)
        kind = df.schema[key].dataType
        for mark in row["_marks"] if row else []:
            at = F.struct(F.lit(mark["hash"]).alias("hash"), F.lit(mark["key"]).cast(kind).alias("key"))
            number = number + F.coalesce(passed(at), F.lit(False)).cast("int")
        placed = hashed
    return placed.withColumn(out, number.cast("int")).drop("_hash", "_marks")


def _cuts(hashed: DataFrame, ends, strata: Sequence[str], digits: int, ranked: int) -> DataFrame:
    """Per cut the hash cell ``prefix`` it lies in, its ``size``, and the rows of it still below (``rest``)."""
    cuts = durable(_cut_points(hashed, ends, strata, digits), "cuts")
    depth = digits
    while depth + digits <= _HASH_DIGITS:
        largest = cuts.where(f"rest > 0 and length(prefix) = {depth}").agg(F.max("size")).first()[0]
        if (largest or 0) <= ranked:
            break
        cuts = durable(_refined(hashed, cuts, strata, depth, digits, ranked), "cuts")
        depth += digits
    return cuts


def _join_cells(rows: DataFrame, dim: DataFrame, strata: Sequence[str], how: str, extra: Sequence[str] = ()) -> DataFrame:
    """Join a small table by stratum, null strata included, and by the ``extra`` columns both sides have."""
    on = F.lit(True)
    for c in [*strata, *extra]:
        dim = dim.withColumnRenamed(c, f"_at_{c}")
        on = on & (rows[c].eqNullSafe(F.col(f"_at_{c}")) if c in strata else (rows[c] == F.col(f"_at_{c}")))
    return rows.join(counted_broadcast(dim), on, how).drop(*[f"_at_{c}" for c in [*strata, *extra]])


def _near(hashed: DataFrame, cuts: DataFrame, strata: Sequence[str], depth: int) -> DataFrame:
    """Rows inside the cells of cuts whose prefix has ``depth`` digits, with that ``prefix``."""
    cells = durable(cuts.select(*strata, "prefix").distinct(), "cells")
    return _join_cells(hashed.withColumn("prefix", F.substring("_hash", 1, depth)), cells, strata, "inner", ["prefix"])


def _refined(hashed: DataFrame, cuts: DataFrame, strata: Sequence[str], depth: int, digits: int, ranked: int) -> DataFrame:
    """``cuts`` with those in cells of over ``ranked`` rows placed in cells of ``digits`` more digits."""
    wide = (F.col("rest") > 0) & (F.length("prefix") == depth) & (F.col("size") > ranked)
    inside = Window.partitionBy(*strata, "prefix").orderBy("_deeper").rowsBetween(Window.unboundedPreceding, 0)
    deeper = (
        _near(hashed, cuts.where(wide), strata, depth)
        .groupBy(*strata, "prefix", F.substring("_hash", 1, depth + digits).alias("_deeper"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_hi", F.sum("_c").over(inside))
    )
    found = (
        _join_cells(deeper, cuts.where(wide).drop("size"), strata, "inner", ["prefix"])
        .where((F.col("rest") >= F.col("_hi") - F.col("_c")) & (F.col("rest") < F.col("_hi")))
        .select(*strata, F.col("_deeper").alias("prefix"), (F.col("rest") - F.col("_hi") + F.col("_c")).alias("rest"), F.col("_c").alias("size"))
    )
    return cuts.where(~wide).unionByName(found)


def _cut_marks(hashed: DataFrame, cuts: DataFrame, key: str, strata: Sequence[str]) -> DataFrame:
    """Per stratum the (hash, key) every segment but the first starts at.

    A cut at the start of a cell needs no row: the cell's digits sort before all its hashes.
    """
    kind = hashed.schema[key].dataType
    marks = cuts.where("rest = 0").select(
        *strata, F.struct(F.col("prefix").alias("hash"), F.lit(None).cast(kind).alias("key")).alias("m")
    )
    inner = cuts.where("rest > 0")
    # cells of one depth as a rule, of two or three where some were refined
    for depth in sorted(r["d"] for r in inner.select(F.length("prefix").alias("d")).distinct().collect()):
        here = inner.where(F.length("prefix") == depth)
        position = F.row_number().over(Window.partitionBy(*strata, "prefix").orderBy("_hash", key)) - 1
        rows = _near(hashed, here, strata, depth).select(
            *strata, "prefix", position.cast("bigint").alias("rest"), F.struct(F.col("_hash").alias("hash"), F.col(key).alias("key")).alias("m")
        )
        # equal cut positions each need their own mark
        marks = marks.unionByName(_join_cells(rows, here.drop("size"), strata, "inner", ["prefix", "rest"]).select(*strata, "m"))
    return marks.groupBy(*strata).agg(F.collect_list("m").alias("_marks"))


def _cut_points(hashed: DataFrame, ends, strata: Sequence[str], digits: int) -> DataFrame:
    """For every segment end the hash cell it lies in, the cell's rows and those of them still below."""
    cells = hashed.groupBy(*strata, F.substring("_hash", 1, digits).alias("prefix")).agg(F.count("*").alias("size"))
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        cells.withColumn("_hi", F.sum("size").over(upto))
        .withColumn("_lo", F.col("_hi") - F.col("size"))
        .withColumn("_ends", ends(F.sum("size").over(whole)))
    )
    # an end e belongs to the first cell whose upper count exceeds it; ends at n cut nothing
    inside = F.filter("_ends", lambda e: (e >= F.col("_lo")) & (e < F.col("_hi")))
    return cells.withColumn("_end", F.explode(inside)).select(
        *strata, "prefix", (F.col("_end") - F.col("_lo")).cast("bigint").alias("rest"), "size"
    )


def _test_first(ratio: float, rounding: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda n: F.array(rounding(n * F.lit(ratio)).cast("bigint"))


def _named(df: DataFrame, segment: str, first: str, second: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(segment) == 0, first).otherwise(second)).drop(segment)


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    within: Sequence[str] = (),
    test_ratio: float = 0.2,
    out: str = "split",
    salt: str | None = None,
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """``round(test_ratio * n)`` test rows of each label, inside each ``within`` group."""
    cut = cut_segments(df, key, _test_first(test_ratio, F.round), [*within, label], "_segment", salt)
    return _named(cut, "_segment", names[1], names[0], out)


def random_split(
    df: DataFrame, key: str, test_ratio: float = 0.2, out: str = "split", salt: str | None = None
) -> DataFrame:
    """``ceil(test_ratio * n)`` test rows of the whole table, labels ignored."""
    cut = cut_segments(df, key, _test_first(test_ratio, F.ceil), (), "_segment", salt)
    return _named(cut, "_segment", "test", "train", out)


def unlabeled_split(df: DataFrame, out: str = "split") -> DataFrame:
    """Without labels every row serves for both training and testing."""
    return df.withColumn(out, F.explode(F.array(F.lit("train"), F.lit("test"))))


def resplit(parts: Sequence[DataFrame], key: str, label: str | None, test_ratio: float = 0.2) -> DataFrame:
    """Union previously split parts and split again."""
    whole = parts[0].drop("split")
    for part in parts[1:]:
        whole = whole.unionByName(part.drop("split"), allowMissingColumns=True)
    if label is None:
        return random_split(whole, key, test_ratio)
    return stratified_split(whole, key, label, test_ratio=test_ratio)


def temporal_stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    order: Sequence[str | Column],
    windows: int = 10,
    test_ratio: float = 0.2,
    out: str = "split",
) -> DataFrame:
    """Stratified split inside consecutive time windows.

    A window where some class has one row, or whose test or train quota is smaller than its
    number of classes, cannot be stratified: its first ``1 - test_ratio`` rows by time train.
    Adds ``window`` and ``split``.
    """
    placed = positional_windows(df, order, windows, "window", "_rank")
    shape = (
        placed.groupBy("window", label)
        .agg(F.count("*").alias("_c"), F.min("_rank").alias("_start"))
        .groupBy("window")
        .agg(
            F.sum("_c").alias("size"),
            F.min("_c").alias("rarest"),
            F.count("*").alias("classes"),
            F.min("_start").alias("start"),
        )
        .collect()  # one row per window
    )
    split = stratified_split(placed, key, label, within=["window"], test_ratio=test_ratio, out=out)
    chosen = F.col(out)
    for w in shape:
        quota = math.ceil(w["size"] * test_ratio)
        if w["rarest"] < 2 or quota < w["classes"] or w["size"] - quota < w["classes"]:
            end = w["start"] + math.floor(w["size"] * (1.0 - test_ratio))
            by_time = F.when(F.col("_rank") < end, "train").otherwise("test")
            chosen = F.when(F.col("window") == w["window"], by_time).otherwise(chosen)
    return split.withColumn(out, chosen).drop("_rank", "n_rows")


def missing_classes(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Labels of the table that one of the two splits lacks: (split, label)."""
    present = df.select(label, split).distinct()
    wanted = present.select(label).distinct().withColumn(
        split, F.explode(F.array(F.lit("train"), F.lit("test")))
    )
    return wanted.join(present, [label, split], "left_anti")


def covered_split(
    df: DataFrame, key: str, label: str, order: Sequence[str | Column], windows: int = 10, test_ratio: float = 0.2
) -> DataFrame:
    """Temporal split when both sides hold every class, else one global stratified split."""
    temporal = temporal_stratified_split(df, key, label, order, windows, test_ratio)
    if missing_classes(temporal, label).isEmpty():
        return temporal
    return stratified_split(temporal.drop("split"), key, label, test_ratio=test_ratio)


def split_report(df: DataFrame, label: str, time: str, split: str = "split") -> DataFrame:
    """Rows and time range per split and class."""
    return df.groupBy(split, label).agg(
        F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def stratified_clients(
    df: DataFrame, key: str, label: str, clients: int, out: str = "client", salt: str | None = None
) -> DataFrame:
    """Equal shares of every class per client; the last client takes the remainders."""

    def ends(n: Column) -> Column:
        share = F.floor(n / clients)
        return F.array(*[(share * F.lit(i)).cast("bigint") for i in range(1, clients)])

    return cut_segments(df, key, ends, [label], out, salt)


def client_train_val(
    df: DataFrame, key: str, label: str, client: str = "client", val_ratio: float = 0.2
) -> DataFrame:
    """Stratified train/val split inside every client (column ``part``)."""
    return stratified_split(
        df, key, label, within=[client], test_ratio=val_ratio, out="part", salt="val", names=("train", "val")
    )


def undersample(df: DataFrame, key: str, label: str, target: int) -> DataFrame:
    """The first ``target`` rows of each class in md5 order; smaller classes stay whole."""
    cut = cut_segments(df, key, lambda n: F.array(F.lit(target).cast("bigint")), [label], "_segment")
    return cut.where(F.col("_segment") == 0).drop("_segment")
