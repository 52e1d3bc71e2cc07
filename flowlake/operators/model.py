"""Boosted-tree models: a small node table, its storage, and scoring of tables with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.numeric import finite

NODE_SCHEMA = (
    "track int, client int, turn int, class int, node bigint, feat int, bin int, threshold double, "
    "miss_left boolean, gain double, leaf double"
)


@dataclass
class Tree:
    """One class's tree of one turn. Node 1 is the root, node i has children 2i and 2i+1."""

    track: int
    client: int
    turn: int
    cls: int
    splits: dict[int, tuple] = field(default_factory=dict)  # node -> (feat, bin, threshold, miss_left, gain)
    leaves: dict[int, float] = field(default_factory=lambda: {1: 0.0})

    def set_leaf(self, node: int, value: float) -> None:
        self.leaves[node] = value

    def split(self, node: int, feat: int, bin_: int, threshold: float, miss_left: bool, gain: float) -> None:
        self.leaves.pop(node, None)
        self.splits[node] = (feat, bin_, threshold, bool(miss_left), gain)

    def leaf_count(self) -> int:
        return len(self.leaves)

    @property
    def index(self) -> dict[int, int]:
        """Position of each node in the arrays of ``place``."""
        return {n: i for i, n in enumerate(sorted([*self.splits, *self.leaves]))}

    def place(self, values: np.ndarray, raw: bool = False) -> np.ndarray:
        """Node position of every row, from bins or from raw feature values."""
        index = self.index
        size = len(index)
        feat, cut = np.full(size, -1), np.zeros(size)
        miss, left = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
        right = np.zeros(size, dtype=np.int64)
        for n, (f, b, threshold, miss_left, _) in self.splits.items():
            i = index[n]
            feat[i], cut[i], miss[i] = f, threshold if raw else b, miss_left
            left[i], right[i] = index[2 * n], index[2 * n + 1]
        at = np.full(len(values), index[1])
        # one flat vector, read in the order it lies in memory
        turned = values.T.flags.c_contiguous
        flat = (values.T if turned else values).reshape(-1)
        row, column = (1, len(values)) if turned else (values.shape[1], 1)
        start = np.arange(len(values)) * row
        child = np.column_stack([right, left]).reshape(-1)
        for _ in range(max((n.bit_length() for n in self.leaves), default=1) - 1):
            here, inner = at, None
            if (feat < 0).any():
                inner = np.flatnonzero(feat.take(at) >= 0)
                if not len(inner):
                    break
                inner = None if len(inner) == len(at) else inner
                here = at if inner is None else at.take(inner)
            x = flat.take((start if inner is None else start.take(inner)) + feat.take(here) * column)
            gone = np.isnan(x) if raw else x < 0
            go_left = x <= cut.take(here)
            if gone.any():
                go_left = np.where(gone, miss.take(here), go_left)
            below = child.take(2 * here + go_left)
            if inner is None:
                at = below
            else:
                at[inner] = below
        return at

    def outputs(self) -> np.ndarray:
        index = self.index
        out = np.zeros(len(index))
        for n, v in self.leaves.items():
            out[index[n]] = v
        return out


def leaf_sums(trees: Sequence[Tree], classes: int, values: np.ndarray, raw: bool = False) -> np.ndarray:
    """Margins: per class the sum of the leaf values a row reaches."""
    total = np.zeros((len(values), classes))
    for tree in trees:
        total[:, tree.cls] += tree.outputs()[tree.place(values, raw)]
    return total


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class BoostModel:
    features: list[str]
    classes: int
    trees: list[Tree]

    def only(self, track: int) -> BoostModel:
        return replace(self, trees=[t for t in self.trees if t.track == track])

    def last_turns(self, n: int) -> BoostModel:
        """The trees of the newest ``n`` turns."""
        newest = max((t.turn for t in self.trees), default=-1)
        return replace(self, trees=[t for t in self.trees if t.turn > newest - n])

    def node_rows(self) -> list[tuple]:
        rows = []
        for t in self.trees:
            head = (t.track, t.client, t.turn, t.cls)
            rows += [(*head, n, int(f), int(b), float(c), m, float(g), None) for n, (f, b, c, m, g) in sorted(t.splits.items())]
            rows += [(*head, n, None, None, None, None, None, float(v)) for n, v in sorted(t.leaves.items())]
        return rows

    @staticmethod
    def from_nodes(nodes: DataFrame, features: Sequence[str], classes: int) -> BoostModel:
        """Rebuild from a node table; its size is rounds x classes x nodes, not data."""
        trees: dict[tuple, Tree] = {}
        for r in nodes.collect():
            key = (r["track"], r["client"], r["turn"], r["class"])
            tree = trees.setdefault(key, Tree(*key, leaves={}))
            if r["leaf"] is None:
                tree.splits[r["node"]] = (r["feat"], r["bin"], r["threshold"], r["miss_left"], r["gain"])
            else:
                tree.leaves[r["node"]] = r["leaf"]
        return BoostModel(list(features), classes, sorted(trees.values(), key=lambda t: (t.turn, t.track, t.client, t.cls)))

    def save(self, spark: SparkSession, path: str, force: bool = False) -> None:
        """Node table and feature list under ``path``; an existing model is kept unless forced."""
        mode = "overwrite" if force else "errorifexists"
        spark.createDataFrame(self.node_rows(), NODE_SCHEMA).write.mode(mode).parquet(f"{path}/nodes")
        meta = [(i, f, self.classes) for i, f in enumerate(self.features)]
        spark.createDataFrame(meta, "pos int, feature string, classes int").write.mode(mode).parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostModel:
        meta = spark.read.parquet(f"{path}/features").orderBy("pos").collect()
        return BoostModel.from_nodes(
            spark.read.parquet(f"{path}/nodes"), [m["feature"] for m in meta], meta[0]["classes"]
        )


def list_array(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column, one list per row."""
    n, width = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def matrix_of(column: pa.Array, width: int, kind=float) -> np.ndarray:
    """An Arrow list column without null rows as a matrix; null cells of a float matrix are NaN."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, width)


def packed(matrix: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """A matrix as an Arrow binary column, the bytes of one row each, or of blocks of so many rows: one copy each on its way through Spark."""
    size = matrix.shape[1] * matrix.itemsize
    n = len(matrix) if sizes is None else len(sizes)
    ends = np.arange(n + 1) if sizes is None else np.cumsum([0, *sizes])
    offsets = (ends * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def unpacked(column: pa.Array, width: int, kind) -> np.ndarray:
    """The matrix of a binary column without nulls; it must not be written to."""
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int32)[at : at + len(column) + 1]
    size = np.dtype(kind).itemsize
    found = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(found.tobytes() if offsets[0] % size else found, kind).reshape(-1, width)


def predict(df: DataFrame, model: BoostModel, out: str = "probs", features: Sequence[str] | None = None) -> DataFrame:
    """Class probabilities of each row in one pass.

    The model ships with the task: rounds x classes x nodes numbers.
    """
    trees, classes, width = model.trees, model.classes, len(model.features)

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        return list_array(softmax_rows(leaf_sums(trees, classes, matrix_of(x, width), raw=True)))

    return df.withColumn(out, score(F.array(*[finite(c).cast("double") for c in features or model.features])))


def model_info(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Split count and total gain per feature, with tree counts, from a node table."""
    trees = nodes.select("track", "client", "turn", "class").distinct().count()
    names = F.array(*[F.lit(f) for f in features])
    return (
        nodes.where(F.col("feat").isNotNull())
        .groupBy(names[F.col("feat")].alias("feature"))
        .agg(F.count("*").alias("n_splits"), F.sum("gain").alias("gain"))
        .withColumn("n_trees", F.lit(trees))
    )


def top_features(nodes: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    return model_info(nodes, features).orderBy(F.desc("n_splits"), "feature").limit(n)
