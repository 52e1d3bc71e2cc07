"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label are scaled to length one, where a cosine of at least t means a distance
of at most epsilon = sqrt(2 - 2t). They are projected on the leading principal directions
(which never lengthens a distance), sorted by grid cells of side epsilon, and cut into blocks of
consecutive vectors. Intervals of the sequence are joined recursively: a pair of intervals is
opened into its parts only if their bounding boxes are within epsilon. The vectors of the
block pairs that are left are compared in double precision.

Edge cases: a row whose label or vector is null, or whose vector is empty, zero or holds a
null, NaN or infinite component links with nothing; neither does a row without id (its
component is null); vectors of different length never link; equal vectors are compared once,
whatever their number; repeated rows count as other vectors; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.components import components
from flowlake.llm.rows import arrow_map, picked
from flowlake.session import shuffle_width
from flowlake.sources.durable import durable

DIRECTIONS = 6
BLOCK = 512
_FAN = 16
# Keeps a pair on the edge of two boxes from being lost to rounding.
_SLACK = 1e-6


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def directions(vectors: DataFrame, size: int, count: int = DIRECTIONS) -> np.ndarray:
    """The leading principal directions of all unit vectors of length ``size``, as columns.

    Tasks sum products row by row of the size x size matrix; only the finished matrix, whose
    size the vectors' length fixes, reaches the driver.
    """

    def kernel(batches):
        gram, total, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            u = _unit(_matrix(batch.column(0), size))
            gram += u.T @ u
            total += u.sum(axis=0)
            n += len(u)
        rows = np.vstack([gram, total, np.full(size, n / size)])
        flat = pa.array(rows.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows.size)), flat], names=["cell", "value"]
        )

    fields = [T.StructField("cell", T.LongType()), T.StructField("value", T.DoubleType())]
    cells = arrow_map(vectors.select("vector"), kernel, fields).groupBy("cell").agg(F.sum("value").alias("value"))
    values = np.zeros((size + 2) * size)
    for row in cells.collect():
        values[row["cell"]] = row["value"]
    rows = values.reshape(size + 2, size)
    n = max(rows[-1].sum(), 1.0)
    mean = rows[-2] / n
    _, found = np.linalg.eigh(rows[:size] / n - np.outer(mean, mean))
    return found[:, ::-1][:, : min(count, size)]


def _blocks(vectors: DataFrame, size: int, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Written blocks ``(label, block, lows, highs, nodes, weights, data)`` of consecutive vectors in grid order."""
    count = axes.shape[1]

    def project(batches):
        for batch in batches:
            y = _unit(_matrix(batch.column(3), size)) @ axes
            cells = np.floor(y / epsilon).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists(pa.array(cells.ravel()), count).cast(pa.list_(pa.int32())), lists(pa.array(y.ravel()), count).cast(pa.list_(pa.float64()))],
                names=["label", "node", "weight", "vector", "cells", "y"],
            )

    base = vectors.select("label", "node", "weight", "vector")
    placed = arrow_map(
        base,
        project,
        [*base.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("y", T.ArrayType(T.DoubleType()))],
    )
    order = ["label", *[F.col("cells")[i] for i in range(count)], F.col("y")[0], "node"]
    laid = placed.repartitionByRange(shuffle_width(vectors.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        label = kind = None

        def block():
            nonlocal number
            node, weight, data, y = (np.concatenate(c) for c in zip(*held))
            held.clear()
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([label], kind),
                    pa.array([number]),
                    pa.array([y.min(axis=0).tolist()]),
                    pa.array([y.max(axis=0).tolist()]),
                    pa.array([node.tobytes()]),
                    pa.array([weight.tobytes()]),
                    pa.array([data.tobytes()]),
                ],
                names=["label", "block", "lows", "highs", "nodes", "weights", "data"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            labels = batch.column(0).to_pylist()
            columns = (
                batch.column(1).to_numpy(),
                batch.column(2).to_numpy(),
                _matrix(batch.column(3), size),
                _matrix(batch.column(5), count),
            )
            at = 0
            while at < len(labels):
                if held and (labels[at] != label or sum(len(h[0]) for h in held) >= BLOCK):
                    yield block()
                label = labels[at]
                room = BLOCK - sum(len(h[0]) for h in held)
                stop = at
                while stop < len(labels) and stop - at < room and labels[stop] == label:
                    stop += 1
                held.append(tuple(c[at:stop] for c in columns))
                at = stop
        if held:
            yield block()

    numbers, binary = T.ArrayType(T.DoubleType()), T.BinaryType()
    fields = [
        vectors.schema["label"],
        T.StructField("block", T.LongType()),
        T.StructField("lows", numbers),
        T.StructField("highs", numbers),
        *[T.StructField(n, binary) for n in ("nodes", "weights", "data")],
    ]
    return durable(arrow_map(laid, cut, fields), "ego-blocks")


def _block_pairs(blocks: DataFrame, epsilon: float, count: int) -> DataFrame:
    """``(block_a, block_b)`` of one label whose boxes are within ``epsilon``, found by recursion from the whole sequence."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("block")) - 1
    leaves = durable(blocks.select("label", "block", "lows", "highs", place.cast("bigint").alias("at")), "ego-boxes")
    last = leaves.agg(F.max("at")).first()[0] or 0
    depth = 0
    while last >> (4 * depth):
        depth += 1

    def level(d: int, side: str) -> DataFrame:
        lows = F.array(*[F.min(F.col("lows")[i]) for i in range(count)])
        highs = F.array(*[F.max(F.col("highs")[i]) for i in range(count)])
        boxes = leaves.groupBy("label", F.shiftright("at", 4 * d).alias(f"{side}")).agg(
            lows.alias(f"{side}_lows"), highs.alias(f"{side}_highs")
        )
        return boxes.withColumn(f"{side}_parent", F.shiftright(side, 4))

    gap = F.aggregate(
        F.zip_with(
            F.zip_with("a_lows", "b_highs", lambda x, y: x - y),
            F.zip_with("b_lows", "a_highs", lambda x, y: x - y),
            lambda p, q: F.pow(F.greatest(p, q, F.lit(0.0)), F.lit(2.0)),
        ),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    pairs = leaves.select("label").distinct().select("label", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    for d in range(depth - 1, -1, -1):
        opened = pairs.select("label", F.col("a").alias("a_parent"), F.col("b").alias("b_parent"))
        opened = opened.join(level(d, "a"), ["label", "a_parent"]).join(level(d, "b"), ["label", "b_parent"])
        pairs = opened.where((F.col("a") <= F.col("b")) & (gap <= epsilon**2 + _SLACK)).select("label", "a", "b")
    names = leaves.select("label", "at", "block")
    a = names.select("label", F.col("at").alias("a"), F.col("block").alias("block_a"))
    b = names.select("label", F.col("at").alias("b"), F.col("block").alias("block_b"))
    return pairs.join(a, ["label", "a"]).join(b, ["label", "b"]).select("block_a", "block_b")


def _roots(rows: np.ndarray, columns: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray):
    """Smallest node reachable inside one block pair, for every node that has a match."""
    keys, where = np.unique(np.concatenate([nodes_a[rows], nodes_b[columns]]), return_inverse=True)
    left, right = where[: len(rows)], where[len(rows) :]
    label = np.arange(len(keys))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return keys, keys[label]
        label = new


def _compared(pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(node, partners, root)``: for each block pair, the weight each node links to and a spanning star of its matches."""

    def kernel(batches):
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for row in batch.to_pylist():
                same = row["block_a"] == row["block_b"]
                na, nb = (np.frombuffer(row[f"nodes_{s}"], np.int64) for s in "ab")
                wa, wb = (np.frombuffer(row[f"weights_{s}"], np.int64) for s in "ab")
                xa, xb = (np.frombuffer(row[f"data_{s}"], np.float64).reshape(-1, size) for s in "ab")
                scale = np.sqrt((xa * xa).sum(axis=1))[:, None] * np.sqrt((xb * xb).sum(axis=1))[None, :]
                i, j = np.nonzero((xa @ xb.T) / scale >= threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                keys, roots = _roots(i, j, na, nb)
                partners = np.zeros(len(keys), np.int64)
                np.add.at(partners, np.searchsorted(keys, na[i]), wb[j])
                np.add.at(partners, np.searchsorted(keys, nb[j]), wa[i])
                out.append((keys, partners, roots))
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "partners", "root"])

    fields = [T.StructField(n, T.LongType()) for n in ("node", "partners", "root")]
    return arrow_map(pairs, kernel, fields)


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
) -> DataFrame:
    """``(id, links, component)`` per row: rows linked directly, and the smallest id reachable (its own without links).

    Equal vectors of a label are one node with a weight; its copies link to each other and share
    its links, so a group of copies is never expanded into pairs.
    """
    rows = picked(df, id=id_col, vector=vector_col, label=label_col)
    wide = F.transform("vector", lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    live = F.coalesce(fine & F.exists(wide, lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    rows = rows.withColumn("live", live).withColumn("vector", wide)
    grouped = rows.where("live").groupBy("label", "vector").agg(F.min("id").alias("first_id"), F.count("*").alias("weight"))
    nodes = durable(
        grouped.withColumn("size", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), "ego-nodes"
    )
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    found = None
    for size in sorted(r["size"] for r in nodes.select("size").distinct().collect()):
        vectors = nodes.where(F.col("size") == size)
        axes = directions(vectors, size)
        blocks = _blocks(vectors, size, axes, epsilon)
        pairs = _block_pairs(blocks, epsilon, axes.shape[1])
        sides = {
            s: blocks.select(F.col("block").alias(f"block_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "weights", "data")])
            for s in "ab"
        }
        loaded = pairs.join(sides["a"], "block_a").join(sides["b"], "block_b")
        part = durable(_compared(loaded, size, threshold), "ego-matches")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    roots = durable(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "ego-roots")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component"))
    resolved = (
        named.join(firsts, "root")
        .join(partners, "node", "left")
        .select("label", "vector", (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("links"), "component")
    )
    linked = rows.where("live").join(resolved, ["label", "vector"]).select("id", "links", "component")
    alone = rows.where(~F.col("live")).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(alone)
