"""Same-class nearest neighbours and class rebalancing.

Exact neighbours with pivot pruning: each class gets pivots (rows drawn by hash), each row belongs to its
nearest one, and a pivot's cell is cut into units of some thousand rows. A row's k best inside its own unit bound how
far a neighbour can lie; the bound, the cells' radii and the planes between pivots tell which other
units can hold a closer one, and the row is sent to those only. A unit's rows arrive before
the visitors and stay in memory, visitors pass by in batches, so no task holds more than a unit, however large a class or
a cell is, and no row pairs are written. On clustered data rows visit a few units; where distances say
nothing (independent noise in many dimensions) they visit all, and the work is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.hashing import hash_key, hash_unit
from flowlake.operators.model import list_array
from flowlake.operators.splits import undersample
from flowlake.operators.weights import class_counts
from flowlake.session import shuffle_width
from flowlake.sources.durable import counted_broadcast, durable

BLOCK_ROWS = 2_000
# Pivots of a class: one for each unit's worth of rows, at most so many.
PIVOTS = 1_024
_VISITORS = 512


def _pivots(rows: DataFrame, block_rows: int) -> dict:
    """Per class the pivots as a matrix: about one for each ``block_rows`` rows, ``PIVOTS`` at most, drawn by hash.

    A sample for speed only: any pivots give the same neighbours.
    """
    sizes = rows.groupBy("cls").agg(F.count("*").alias("n"))
    wanted = F.least(F.ceil(F.col("n") / block_rows), F.lit(PIVOTS))
    dim = durable(sizes.select(F.col("cls").alias("_class"), (wanted / F.col("n")).alias("_share")), "pivot-shares")
    on = rows["cls"].eqNullSafe(F.col("_class"))
    drawn = rows.join(counted_broadcast(dim), on).where((hash_unit(F.lit("pivot"), "id") < F.col("_share")) & (F.col("_share") < 1))
    found: dict = {}
    for r in drawn.select("cls", "x").collect():
        found.setdefault(r["cls"], []).append(r["x"])
    return {c: np.unique(np.array(x, dtype=float), axis=0) for c, x in found.items()}


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``, good to rounding of the largest square."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _placed(rows: DataFrame, pivots: dict) -> DataFrame:
    """Rows with their ``cell`` and the distance ``gap`` to its pivot."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int, gap double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, gap = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            x = _matrix(batch.column("x"))
            for c, own in _by_class(batch.column("cls")):
                if c in pivots:
                    p = pivots[c]
                    cell[own] = _gaps(x[own], p).argmin(axis=1)
                    gap[own] = np.sqrt(((x[own] - p[cell[own]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

    return rows.mapInArrow(run, schema)


def _by_class(column: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """Each class of a batch with the places of its rows."""
    found: dict = {}
    for i, c in enumerate(column.to_pylist()):
        found.setdefault(c, []).append(i)
    for c, places in found.items():
        yield c, np.array(places)


def _names(ids: pa.Array) -> np.ndarray:
    """Ids as an array that compares and sorts."""
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=object)


def _best(seeds: np.ndarray, seed_ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(seed, other, distance) of the k nearest others of each seed, itself left out; ties go to the smaller id.

    Distances by matrix product pick who is near enough to be measured exactly.
    """
    rough = _gaps(seeds, others)
    rank = np.unique(other_ids, return_inverse=True)[1]
    # the seed itself may be among the nearest, hence one more; rounding of the product grows with the values
    upto = min(k, rough.shape[1] - 1)
    largest = max(float(np.abs(seeds).max(initial=0.0)), float(np.abs(others).max(initial=0.0)))
    limit = np.partition(rough, upto, axis=1)[:, upto] + largest * np.sqrt(seeds.shape[1]) * 1e-6
    at, to = np.nonzero(rough <= limit[:, None])
    keep = seed_ids[at] != other_ids[to]
    at, to = at[keep], to[keep]
    exact = np.sqrt(((others[to] - seeds[at]) ** 2).sum(axis=1))
    order = np.lexsort((rank[to], exact, at))
    at, to, exact = at[order], to[order], exact[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[kept], to[kept], exact[kept]


class _Unit:
    """The rows of one unit, in memory."""

    def __init__(self, number: int):
        self.number = number
        self._x: list[np.ndarray] = []
        self._ids: list[pa.Array] = []

    def add(self, part: pa.RecordBatch) -> None:
        self._x.append(_matrix(part.column("x")))
        self._ids.append(part.column("id"))

    def meet(self, ids: pa.Array, x: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """The k best of the unit's rows for each row given, none farther than its bound."""
        if not self._x:
            return
        others, names = np.concatenate(self._x), pa.concat_arrays(self._ids)
        own = _names(names)
        for lo in range(0, len(x), _VISITORS):
            some = ids.slice(lo, _VISITORS)
            at, to, gap = _best(x[lo : lo + _VISITORS], _names(some), others, own, k)
            if bound is not None:
                near = gap <= bound[lo + at]
                at, to, gap = at[near], to[near], gap[near]
            yield pa.RecordBatch.from_arrays(
                [some.take(pa.array(at)), names.take(pa.array(to)), pa.array(gap), list_array(others[to])],
                names=["id", "neighbour", "distance", "vector"],
            )

    def meet_itself(self, k: int) -> Iterator[pa.RecordBatch]:
        if self._x:
            yield from self.meet(pa.concat_arrays(self._ids), np.concatenate(self._x), k)


def _met(k: int, visitors: bool):
    """Kernel over (unit, visits, id, x, bound), a unit's rows before its visitors: each visitor's k best of the unit,
    or without ``visitors`` each resident's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _Unit(-1)
        for batch in batches:
            units = batch.column("unit").to_numpy()
            visits = batch.column("visits").to_numpy(zero_copy_only=False)
            # stretches of one unit and one kind
            edges = (np.flatnonzero((units[1:] != units[:-1]) | (visits[1:] != visits[:-1])) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(units)]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if units[lo] != unit.number:
                    if not visitors:
                        yield from unit.meet_itself(k)
                    unit = _Unit(units[lo])
                if visits[lo]:
                    yield from unit.meet(part.column("id"), _matrix(part.column("x")), k, part.column("bound").to_numpy())
                else:
                    unit.add(part)
        if not visitors:
            yield from unit.meet_itself(k)

    return run


def _visits(bounded: DataFrame, pivots: dict, cells: dict) -> DataFrame:
    """``(unit, id, x, bound)``: rows and the other units that may hold one of their nearest.

    ``cells`` has per class the first unit, number of units and radius of every cell.
    """
    id_type = bounded.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _VISITORS):
                part = batch.slice(lo, _VISITORS)
                x, own = _matrix(part.column("x")), part.column("unit").to_numpy()
                bound, cell = part.column("bound").to_numpy(), part.column("cell").to_numpy()
                for c, here in _by_class(part.column("cls")):
                    first, parts, radius = cells[c]
                    near = np.ones((len(here), len(first)), bool)
                    if c in pivots:
                        near = _may_hold(x[here], bound[here], cell[here], pivots[c], radius)
                    i, j = np.nonzero(near)
                    # every unit of a cell is visited, but for the row's own
                    each = np.repeat(np.arange(len(i)), parts[j])
                    unit = first[j][each] + np.arange(len(each)) - np.repeat(np.cumsum(parts[j]) - parts[j], parts[j])
                    rows = here[i[each]]
                    away = unit != own[rows]
                    took = pa.array(rows[away])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(unit[away].astype(np.int64)), part.column("id").take(took), part.column("x").take(took), pa.array(bound[rows[away]])],
                        names=["unit", "id", "x", "bound"],
                    )

    return bounded.mapInArrow(run, f"unit bigint, id {id_type}, x array<double>, bound double")


def _may_hold(x: np.ndarray, bound: np.ndarray, cell: np.ndarray, p: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells can hold a row within each row's bound, by the ball around a pivot and the plane between two."""
    gaps, between = _gaps(x, p), _gaps(p, p)[cell]
    mine = gaps[np.arange(len(x)), cell][:, None]
    plane = np.divide(gaps**2 - mine**2, 2 * between, out=np.zeros_like(between), where=between > 0)
    slack = 1e-6 * (bound[:, None] + np.abs(x).max(initial=0.0) + np.abs(p).max(initial=0.0))
    return np.maximum(gaps - radius, plane) <= bound[:, None] + np.where(np.isfinite(slack), slack, 0.0)


def same_class_neighbours(
    df: DataFrame, key: str, label: str, features: str, k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` nearest rows of the same class: (id, rank, neighbour, distance, vector). Ties go to the smaller id.

    ``key`` must be unique, vectors of one length without nulls; a null label is a class.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("cls"), F.col(features).cast("array<double>").alias("x"))
    pivots = _pivots(rows, block_rows)
    placed = durable(_placed(rows, pivots), "placed")
    # at most PIVOTS cells a class; cells of more rows than a unit are cut by hash
    listed, cells, units = [], {}, 0
    for r in placed.groupBy("cls", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).orderBy("cls", "cell").collect():
        parts = -(-r["n"] // block_rows)
        listed.append((r["cls"], r["cell"], units, parts))
        own = cells.setdefault(r["cls"], [[], [], np.full(len(pivots.get(r["cls"], [0])), -np.inf), []])
        own[0].append(units)
        own[1].append(parts)
        own[2][r["cell"]] = r["radius"]
        own[3].append(r["cell"])
        units += parts
    # cells without rows hold nothing; the others' numbers are the pivots'
    whole = {}
    for c, (first, parts, radius, numbers) in cells.items():
        firsts, counts = np.zeros(len(radius), np.int64), np.zeros(len(radius), np.int64)
        firsts[numbers], counts[numbers] = first, parts
        whole[c] = (firsts, counts, radius)
    kind = df.schema[label].dataType.simpleString()
    dim = durable(spark.createDataFrame(listed, f"_cls {kind}, _cell int, _first bigint, _parts bigint"), "units")
    on = placed["cls"].eqNullSafe(F.col("_cls")) & (placed["cell"] == F.col("_cell"))
    unit = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))
    settled = durable(placed.join(counted_broadcast(dim), on).select("id", "cls", "x", "cell", unit.alias("unit")), "in-units")
    id_type = df.schema[key].dataType.simpleString()

    def matched(members: DataFrame, visitors: bool) -> DataFrame:
        dealt = members.repartition(max(1, min(shuffle_width(spark), units)), "unit").sortWithinPartitions("unit", "visits")
        return dealt.mapInArrow(_met(k, visitors), f"id {id_type}, neighbour {id_type}, distance double, vector array<double>")

    residents = settled.select("unit", F.lit(False).alias("visits"), "id", "x", F.lit(None).cast("double").alias("bound"))
    near = matched(residents, visitors=False)
    if units > len(cells):
        near = durable(near, "near")
        # the k-th best inside the own unit; a unit with fewer others bounds nothing
        worst = near.groupBy("id").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
        bound = F.coalesce(F.when(F.col("_n") >= k, F.col("_far")), F.lit(float("inf"))).alias("bound")
        bounded = settled.join(worst, "id", "left").select("id", "cls", "x", "cell", "unit", bound)
        guests = _visits(bounded, pivots, whole).select("unit", F.lit(True).alias("visits"), "id", "x", "bound")
        near = near.unionByName(matched(residents.unionByName(guests), visitors=True))
    # at most k rows for each unit that a row visited
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def smote(df: DataFrame, key: str, label: str, features: str, target: int, k: int = 5) -> DataFrame:
    """Synthetic rows that lift every class below ``target`` to it: (label, features).

    Only classes with fewer than ``target`` rows take part, so everything here is bounded
    by ``target`` rows per class. Extra rows are dealt to the class's rows in md5 order;
    neighbour and position on the connecting line come from hashes of (key, copy).
    A row without a neighbour (single-row class) is repeated.
    """
    small = class_counts(df, label).where(F.col("n") < target).select(F.col(label).alias("_class"), "n")
    short = df.join(counted_broadcast(durable(small, "small")), F.col(label) == F.col("_class")).drop("_class")
    short = durable(short, "short")
    near = (
        same_class_neighbours(short, key, label, features, k)
        .groupBy(F.col("id").alias("_near_id"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("near"))
    )
    seat = F.row_number().over(Window.partitionBy(label).orderBy(hash_key(key), key)) - 1
    extra = F.lit(target) - F.col("n")
    seeds = short.withColumn("_seat", seat).withColumn(
        "_copies", (F.floor(extra / F.col("n")) + (F.col("_seat") < extra % F.col("n")).cast("int")).cast("int")
    )
    copies = (
        seeds.where("_copies > 0")
        .join(near, F.col(key) == F.col("_near_id"), "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    )
    pick = F.floor(hash_unit(F.lit("near"), key, "_copy") * F.size("near")).cast("int")
    step = hash_unit(F.lit("step"), key, "_copy")
    x = F.col(features).cast("array<double>")
    other = F.coalesce(F.get(F.col("near"), pick)["vector"], x)
    return copies.select(
        F.col(key).alias("seed"),
        F.col("_copy").alias("copy"),
        F.col(label),
        F.zip_with(x, other, lambda a, b: a + step * (b - a)).alias(features),
    )


def rebalance(df: DataFrame, key: str, label: str, features: str, target: int, k: int = 5) -> DataFrame:
    """Every class at ``target`` rows: smaller ones with synthetic rows, larger ones thinned."""
    kept = undersample(df, key, label, target).select(
        label, F.col(features).cast("array<double>").alias(features), F.lit(False).alias("synthetic")
    )
    made = smote(df, key, label, features, target, k).select(label, features, F.lit(True).alias("synthetic"))
    return kept.unionByName(made)
