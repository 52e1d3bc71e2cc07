"""Multiclass boosted trees grown by Spark jobs.

Rows are binned once and written, with the margins of the model so far. They are written in blocks, one table row for
some thousand training rows whose numbers lie behind each other as bytes, so that a pass moves blocks and not rows between
Parquet, the JVM and Python. One tree level is one job over all rows: every task adds up gradient histograms of its rows, Spark sums them per (track, client,
class, node, feature, bin), and window functions pick the best split of each node. Only the
chosen splits, a few numbers per node, reach the driver. After each local round the margins are
written anew with the round's trees added, so a tree is walked while it grows and once when it is
finished, and a round costs the same however many went before. Where several clients train on their own for some
rounds, rows carry their own client's margins beside the shared ones until the round is combined.

A track is one parameter set and a client one owner of rows; both are plain keys of the same
job, so all trials or all clients grow their trees of a round together. Margins of tracks that are out
leave the rows at the next write. Nothing is ever grouped by client, so one client holding a third
of all rows is spread over as many tasks as its rows fill.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.numeric import finite
from flowlake.operators.convergence import Patience
from flowlake.operators.encode import refuse_labels
from flowlake.operators.model import NODE_SCHEMA, BoostModel, Tree, leaf_sums, packed, softmax_rows, unpacked
from flowlake.sources.durable import BLOCK_OPTIONS, Slots, gathered, spread

MAX_BINS = 32
_MIN_HESSIAN = 1e-16
# histogram cells a task holds before it hands partial sums on (two doubles each)
_HELD_CELLS = 8_000_000
# rows of a block, and bytes of its margins: no more than either
_BLOCK_ROWS, _BLOCK_BYTES = 4_096, 1 << 17
# rows a kernel works on at once: what it holds of them fits the processor's cache
_SLICE_ROWS = 16_384


@dataclass(frozen=True)
class BoostParams:
    """Learning parameters of one track; the defaults suit 11-class flow data."""

    eta: float = 0.05
    max_depth: int = 6
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    max_delta_step: float = 0.0
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    rounds: int = 20
    grow_policy: str = "depthwise"
    max_leaves: int = 0
    seed: int = 42

    def fault(self) -> str | None:
        """What makes these parameters unusable, if anything."""
        shares = ("subsample", "colsample_bytree", "colsample_bylevel", "colsample_bynode")
        for name in shares:
            if not 0 < getattr(self, name) <= 1:
                return f"{name} must lie in (0, 1]"
        for name in ("eta", "min_child_weight", "gamma", "reg_lambda", "reg_alpha", "max_delta_step"):
            if not 0 <= getattr(self, name) < math.inf:
                return f"{name} must be a number from 0 on"
        if self.grow_policy not in ("depthwise", "lossguide"):
            return f"unknown grow_policy {self.grow_policy}"
        if self.grow_policy == "lossguide" and self.max_depth <= 0 and self.max_leaves <= 0:
            return "lossguide needs max_depth or max_leaves"
        return None if self.rounds >= 1 else "rounds must be at least 1"


@dataclass
class BoostData:
    """Binned rows (written, in blocks) with the cut points of each feature and the tracks whose margins they carry.

    Rows are ``row_id, client, label, weight, is_val, bins, margin`` and, while clients train on their
    own, ``own``: the margins of the row's own client. Bins and margins are bytes, one number per
    feature (0: missing) or per (track, class). A block has ``n`` rows of one ``is_val``, of which ``outside`` have
    no label of the classes, and the bytes of its rows in each other column.
    """

    blocks: DataFrame
    features: list[str]
    edges: list[list[float]]
    classes: int
    tracks: tuple[int, ...]
    slots: Slots = field(repr=False, default=None)

    def layout(self) -> _Layout:
        width = max(len(e) for e in self.edges) + 2
        return _Layout(len(self.features), self.classes, self.tracks, width, "own" if "own" in self.blocks.columns else "margin")

    @property
    def rows(self) -> DataFrame:
        """The blocks taken apart: one table row per training row."""
        own = self.layout().current == "own"
        return self.blocks.mapInArrow(_rows(self.layout(), own), _ROW + ", own binary" * own)


@dataclass(frozen=True)
class _Layout:
    """How rows are packed: plain values, so that kernels do not drag the table into the task."""

    features: int
    classes: int
    tracks: tuple[int, ...]
    width: int
    current: str

    @property
    def kind(self):
        return np.uint8 if self.width <= 256 else np.uint16

    @property
    def block_rows(self) -> int:
        return max(1, min(_BLOCK_ROWS, _BLOCK_BYTES // (8 * len(self.tracks) * self.classes)))

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bin of every feature of the rows of all blocks, as stored: 0 where it is missing."""
        return unpacked(batch.column("bins"), self.features, self.kind)

    def margins(self, batch: pa.RecordBatch, column: str) -> np.ndarray:
        return unpacked(batch.column(column), len(self.tracks) * self.classes, np.float64)

    def numbers(self, batch: pa.RecordBatch, column: str) -> np.ndarray:
        return unpacked(batch.column(column), 1, _KINDS[column]).ravel()

    def span(self, track: int) -> slice:
        at = self.tracks.index(track) * self.classes
        return slice(at, at + self.classes)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending distinct cut points per feature from one approximate-percentile pass.

    Sketches depend a little on how the rows are laid out: pass the same edges to repeat a run exactly.
    """
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(finite(c).cast("double"), probs, bins * 32).alias(f"e{i}") for i, c in enumerate(features)])
    found = row.first()
    return [sorted(set(found[f"e{i}"] or [])) for i in range(len(features))]


def prepare(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: int,
    key: str,
    client: str | None = None,
    weight: str | None = None,
    validation: Column | None = None,
    tracks: int = 1,
    start: BoostModel | None = None,
    edges: list[list[float]] | None = None,
    bins: int = MAX_BINS,
) -> BoostData:
    """Bin the feature columns and write the training rows.

    ``start`` is an existing model: its margins become the starting point of every track.
    """
    edges = edges or bin_edges(df, features, bins)
    rows = df.select(
        F.xxhash64(key).alias("row_id"),
        (F.col(client).cast("int") if client else F.lit(0)).alias("client"),
        F.col(label).cast("int").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        (validation if validation is not None else F.lit(False)).alias("is_val"),
        *[finite(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
    )
    data = BoostData(rows, list(features), edges, classes, tuple(range(tracks)), Slots(df.sparkSession, "boost"))
    # binned where the rows are read: blocks, not rows, are dealt out evenly
    blocks = spread(rows.mapInArrow(_binner(data.layout(), edges, start.trees if start else []), _BLOCK))
    data.blocks = data.slots.put(blocks, **BLOCK_OPTIONS)
    refuse_labels(data.blocks.agg(F.sum("outside")).first()[0] or 0, "label")
    return data


_ROW = "row_id bigint, client int, label int, weight double, is_val boolean, bins binary, margin binary"
_BLOCK = "is_val boolean, n int, outside int, row_id binary, client binary, label binary, weight binary, bins binary, margin binary"
# columns of a block that no round changes, and how numbers lie in its bytes
_KEPT = ["is_val", "n", "outside", "row_id", "client", "label", "weight", "bins"]
_KINDS = {"row_id": np.int64, "client": np.int64, "label": np.int32, "weight": np.float64}
# what stands for no client: no int
_NOBODY = -(1 << 62)


def _slices(n: int) -> Iterator[slice]:
    return (slice(at, min(at + _SLICE_ROWS, n)) for at in range(0, n, _SLICE_ROWS))


def _binner(layout: _Layout, edges, trees: list[Tree]):
    cuts = [np.asarray(e, dtype=float) for e in edges]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # nulls arrive as NaN
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(cuts))])
            bins = np.empty(x.shape, dtype=layout.kind)
            for f, cut in enumerate(cuts):
                value = batch.column(f"x{f}").to_numpy(zero_copy_only=False).astype(float)
                bins[:, f] = np.where(np.isnan(value), 0, np.searchsorted(cut, value, side="left") + 1)
            margin = np.tile(leaf_sums(trees, layout.classes, x, raw=True), (1, len(layout.tracks)))
            label = batch.column("label").fill_null(-1).to_numpy()
            numbers = {
                "row_id": batch.column("row_id").to_numpy(),
                "client": batch.column("client").cast(pa.int64()).fill_null(_NOBODY).to_numpy(),
                "label": label,
                "weight": batch.column("weight").to_numpy(zero_copy_only=False),
            }
            columns = [*(v.astype(_KINDS[c])[:, None] for c, v in numbers.items()), bins, margin]
            outside = (label < 0) | (label >= layout.classes)
            side = batch.column("is_val").cast(pa.int8()).fill_null(2).to_numpy()
            for value, code in ((False, 0), (True, 1), (None, 2)):
                found = np.flatnonzero(side == code)
                if not len(found):
                    continue
                sizes = np.diff([*range(0, len(found), layout.block_rows), len(found)])
                starts = np.cumsum([0, *sizes[:-1]])
                heads = [
                    pa.array([value] * len(sizes), pa.bool_()),
                    pa.array(sizes, pa.int32()),
                    pa.array(np.add.reduceat(outside[found].astype(np.int32), starts), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([*heads, *(packed(c[found], sizes) for c in columns)], names=[*_KEPT, "margin"])

    return run


def _rows(layout: _Layout, own: bool):
    """Kernel: the rows of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("n").to_numpy()
            client = layout.numbers(batch, "client")
            plain = {
                "row_id": pa.array(layout.numbers(batch, "row_id")),
                "client": pa.array(client, mask=client == _NOBODY).cast(pa.int32()),
                "label": pa.array(layout.numbers(batch, "label")),
                "weight": pa.array(layout.numbers(batch, "weight")),
                "is_val": batch.column("is_val").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                "bins": packed(layout.bins(batch)),
                **{c: packed(layout.margins(batch, c)) for c in ["margin", *["own"] * own]},
            }
            yield pa.RecordBatch.from_arrays(list(plain.values()), names=list(plain))

    return run


# ---- one level: histograms -----------------------------------------------------------------


def _sampled(row_id: np.ndarray, rate: float, seed: int, track: int, turn: int) -> np.ndarray:
    """Rows of a round's subsample, from a hash of the row id."""
    if rate >= 1.0:
        return np.ones(len(row_id), dtype=bool)
    mixed = row_id.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + track * 7_919 + turn) & 0xFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(11)).astype(float) / float(1 << 53) < rate


def _columns(p: BoostParams, features: int, track: int, turn: int, cls: int, node: int) -> np.ndarray:
    """Features a node may split on, after tree, level and node sampling."""
    chosen = np.arange(features)
    steps = ((p.colsample_bytree, 0, 0), (p.colsample_bylevel, node.bit_length(), 0), (p.colsample_bynode, node.bit_length(), node))
    for rate, level, at in steps:
        if rate < 1.0:
            keep = max(1, int(round(rate * len(chosen))))
            rng = np.random.default_rng([p.seed, track, turn, cls, level, at])
            chosen = np.sort(rng.choice(chosen, keep, replace=False))
    return chosen


@dataclass
class _Growing:
    """Trees under construction for one (track, client, class) and the nodes to measure."""

    track: int
    client: int
    cls: int
    tree: Tree
    measure: list[int]

    def slots(self) -> np.ndarray:
        """Position in ``measure`` of every node of the tree, -1 for the others."""
        index = self.tree.index
        found = np.full(len(index), -1)
        for n, node in enumerate(self.measure):
            found[index[node]] = n
        return found


def _gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray):
    p = softmax_rows(margin)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1.0
    h = np.maximum(2.0 * p * (1.0 - p), _MIN_HESSIAN)
    return g * weight[:, None], h * weight[:, None]


def _histograms(layout: _Layout, params: dict[int, BoostParams], growing: list[_Growing], turn: int):
    """Kernel: partial gradient sums of one task's rows, non-empty cells only."""
    features, width = layout.features, layout.width
    owners: dict[tuple[int, int], list[_Growing]] = {}
    for item in growing:
        owners.setdefault((item.track, item.client), []).append(item)

    by_track = {t: [(owner, items) for (track, owner), items in owners.items() if track == t] for t, _ in owners}
    slots = {(i.track, i.client, i.cls): i.slots() for i in growing}
    may = {(i.track, i.client, i.cls): _allowed(params[i.track], features, turn, i) for i in growing}

    def add(sums: dict, item: _Growing, by_feature: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Sums of the rows of one slice; ``by_feature`` has their bins, a feature after the other."""
        key = (item.track, item.client, item.cls)
        nodes, allowed = len(item.measure), may[key]
        slot = slots[key][item.tree.place(by_feature.T)]
        here = np.flatnonzero(slot >= 0)
        if not len(here):
            return
        if len(here) < len(slot):
            by_feature, slot, g, h = by_feature[:, here], slot[here], g[here], h[here]
        if key not in sums:
            sums[key] = [np.zeros((nodes, features, width)) for _ in range(2)]
        first = slot * width + 1
        for f in np.flatnonzero(allowed.any(axis=0)):
            cell = first + by_feature[f]
            for total, part in zip(sums[key], (g, h)):
                added = np.bincount(cell, part, minlength=nodes * width).reshape(nodes, width)
                total[:, f, :] += np.where(allowed[:, f, None], added, 0.0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            all_bins, margins = layout.bins(batch), layout.margins(batch, layout.current)
            client, label, weight, row_id = (layout.numbers(batch, c) for c in ("client", "label", "weight", "row_id"))
            for part in _slices(len(label)):
                bins = np.ascontiguousarray(all_bins[part].T).astype(np.intp) - 1
                for track, owned in by_track.items():
                    p = params[track]
                    drawn = _sampled(row_id[part], p.subsample, p.seed, track, turn)
                    for owner, items in owned:
                        rows = np.flatnonzero((client[part] == owner) & drawn)
                        if not len(rows):
                            continue
                        at = rows + part.start
                        own = bins if len(rows) == bins.shape[1] else bins[:, rows]
                        g, h = (np.ascontiguousarray(v.T) for v in _gradients(margins[at, layout.span(track)], label[at], weight[at]))
                        for item in items:
                            add(sums, item, own, g[item.cls], h[item.cls])
                if sum(g.size for g, _ in sums.values()) > _HELD_CELLS:
                    yield from _emitted(sums, growing)
        yield from _emitted(sums, growing)

    return run


def _allowed(p: BoostParams, features: int, turn: int, item: _Growing) -> np.ndarray:
    """Which features (columns) the nodes being measured (rows) may split on."""
    may = np.zeros((len(item.measure), features), dtype=bool)
    for n, node in enumerate(item.measure):
        may[n, _columns(p, features, item.track, turn, item.cls, node)] = True
    return may


def _emitted(sums: dict, growing: list[_Growing]) -> Iterator[pa.RecordBatch]:
    """The non-empty cells of the sums so far; the sums start over."""
    nodes = {(i.track, i.client, i.cls): np.asarray(i.measure, dtype=np.int64) for i in growing}
    for key, (g, h) in sums.items():
        slot, feat, cell = np.nonzero(h)
        heads = [pa.array(np.full(len(slot), v, np.int32)) for v in key]
        yield pa.RecordBatch.from_arrays(
            [
                *heads,
                pa.array(nodes[key][slot]),
                pa.array(feat.astype(np.int32)),
                pa.array((cell - 1).astype(np.int32)),
                pa.array(g[slot, feat, cell]),
                pa.array(h[slot, feat, cell]),
            ],
            names=["track", "client", "class", "node", "feat", "bin", "g", "h"],
        )
    sums.clear()


_CELLS = "track int, client int, class int, node bigint, feat int, bin int, g double, h double"


_NODE = "track, client, class, node"
# {cells} holds the tasks' partial sums; p_* are the parameters of a row's track.
# Bin -1 counts missing values: every cut is tried with them on the right and on the left.
_BEST_SPLITS = """
with cell as (
  select {node}, feat, bin, sum(g) as g, sum(h) as h from {{cells}} group by {node}, feat, bin),
known as (
  select *, if(bin >= 0, g, 0D) as gk, if(bin >= 0, h, 0D) as hk from cell),
prefix as (
  select {node}, feat, bin,
    sum(gk) over upto as g_left, sum(hk) over upto as h_left,
    sum(g - gk) over feature as g_miss, sum(h - hk) over feature as h_miss,
    sum(g) over feature as g_all, sum(h) over feature as h_all
  from known
  window feature as (partition by {node}, feat),
    upto as (partition by {node}, feat order by bin rows between unbounded preceding and current row)),
cut as (
  select {node}, feat, bin, g_all, h_all, miss_left, gl, hl, g_all - gl as gr, h_all - hl as hr,
    {reg_lambda} as p_lambda, {reg_alpha} as p_alpha, {gamma} as p_gamma, {min_child_weight} as p_least
  from prefix
  lateral view inline(array(named_struct('m', false, 'gl', g_left, 'hl', h_left),
    named_struct('m', true, 'gl', g_left + g_miss, 'hl', h_left + h_miss))) side as miss_left, gl, hl),
scored as (
  select *, if(bin >= 0 and hl >= greatest(p_least, 1e-12D) and hr >= greatest(p_least, 1e-12D),
    round(0.5D * (pow(greatest(abs(gl) - p_alpha, 0D), 2) / (hl + p_lambda)
      + pow(greatest(abs(gr) - p_alpha, 0D), 2) / (hr + p_lambda)
      - pow(greatest(abs(g_all) - p_alpha, 0D), 2) / (h_all + p_lambda)) - p_gamma, 9), null) as gain
  from cut),
best as (
  select {node}, max(named_struct('gain', gain, 'feat', -feat, 'bin', -bin, 'right', not miss_left, 'gl', gl, 'hl', hl)) as b,
    max(g_all) as g, max(h_all) as h
  from scored group by {node})
select {node}, b.gain as gain, -b.feat as feat, -b.bin as bin, not b.right as miss_left, b.gl as gl, b.hl as hl, g, h from best
"""


def best_splits(partial: DataFrame, params: dict[int, BoostParams]) -> DataFrame:
    """Best split of every measured node from the tasks' partial histograms.

    The windows run over the bins of one feature of one node. Gains are rounded so that
    summation order cannot decide between equal ones; ties go to the smaller (feature, bin).
    """

    def of(name: str) -> str:
        pairs = ", ".join(f"{t}, {float(getattr(p, name))!r}D" for t, p in params.items())
        return f"map({pairs})[track]"

    names = ("reg_lambda", "reg_alpha", "gamma", "min_child_weight")
    text = _BEST_SPLITS.format(node=_NODE, **{n: of(n) for n in names})
    # tasks already combined their rows, so the sums can be taken where the windows need them
    placed = partial.repartition("track", "client", "class", "node", "feat")
    return partial.sparkSession.sql(text, cells=placed)


def _leaf(p: BoostParams, g: float, h: float) -> float:
    shrunk = np.sign(g) * max(abs(g) - p.reg_alpha, 0.0)
    value = -shrunk / (h + p.reg_lambda)
    if p.max_delta_step > 0:
        value = np.clip(value, -p.max_delta_step, p.max_delta_step)
    return p.eta * float(value)


def grow_round(
    data: BoostData, params: dict[int, BoostParams], owners: Collection[tuple[int, int]], turn: int
) -> tuple[list[Tree], set[int]]:
    """One tree per (track, client) of ``owners`` and class, level by level (or leaf by leaf).

    Tracks whose gradients or leaves are no finite numbers come back as the second part; their trees end there.
    """
    growing = {(t, c, k): _Growing(t, c, k, Tree(t, c, turn, k), [1]) for t, c in owners for k in range(data.classes)}
    layout = data.layout()
    used = ["row_id", "client", "label", "weight", "bins", layout.current]
    train = gathered(data.blocks.where(~F.col("is_val")).select(*used))
    options: dict[tuple, dict[int, tuple]] = {key: {} for key in growing}
    failed: set[int] = set()
    while True:
        todo = [g for g in growing.values() if g.measure and g.track not in failed]
        if not todo:
            break
        found = best_splits(train.mapInArrow(_histograms(layout, params, todo, turn), _CELLS), params).collect()
        for item in todo:
            item.measure = []
        for r in found:
            key = (r["track"], r["client"], r["class"])
            item, p = growing[key], params[r["track"]]
            if not (math.isfinite(r["g"]) and math.isfinite(r["h"]) and math.isfinite(_leaf(p, r["g"], r["h"]))):
                failed.add(item.track)
                continue
            if r["node"] == 1:
                item.tree.set_leaf(1, _leaf(p, r["g"], r["h"]))
            if r["gain"] is not None and r["gain"] > 0 and _may_deepen(p, r["node"]):
                options[key][r["node"]] = r
        for key, item in growing.items():
            if item.track not in failed:
                _expand(item, options[key], params[item.track], data.edges)
    return [g.tree for g in growing.values()], failed


def _may_deepen(p: BoostParams, node: int) -> bool:
    depth = node.bit_length() - 1
    return (p.max_depth <= 0 or depth < p.max_depth) and depth < 60


def _expand(item: _Growing, options: dict, p: BoostParams, edges) -> None:
    """Split all candidate nodes (depthwise) or the best one (lossguide); queue what to measure next."""
    if not options:
        return
    if p.grow_policy == "lossguide":
        order = [max(options, key=lambda n: (options[n]["gain"], -n))]
    else:
        order = sorted(options)
    for node in order:
        if p.max_leaves > 0 and item.tree.leaf_count() >= p.max_leaves:
            options.clear()
            return
        r = options.pop(node)
        item.tree.split(node, r["feat"], r["bin"], edges[r["feat"]][r["bin"]] if r["bin"] < len(edges[r["feat"]]) else float("inf"), r["miss_left"], r["gain"])
        right_g, right_h = r["g"] - r["gl"], r["h"] - r["hl"]
        item.tree.set_leaf(2 * node, _leaf(p, r["gl"], r["hl"]))
        item.tree.set_leaf(2 * node + 1, _leaf(p, right_g, right_h))
        if _may_deepen(p, 2 * node):
            item.measure += [2 * node, 2 * node + 1]


# ---- rounds --------------------------------------------------------------------------------


def _adder(layout: _Layout, trees: list[Tree], tracks: tuple[int, ...], own: bool):
    """Kernel: rows with the leaf values of finished trees added to their margins, for ``tracks`` only.

    ``own`` adds each client's trees to its own rows, in the column of that name; otherwise all trees are added to all
    rows' shared margins, and own ones go.
    """
    base = layout.current if own else "margin"
    columns = np.r_[tuple(layout.span(t) for t in tracks)]

    def moved(matrix: np.ndarray) -> np.ndarray:
        return matrix if tracks == layout.tracks else matrix[:, columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            all_bins, margin = layout.bins(batch), np.array(layout.margins(batch, base))
            client = layout.numbers(batch, "client") if own else None
            for part in _slices(len(margin)):
                bins = (np.ascontiguousarray(all_bins[part].T).astype(np.intp) - 1).T
                for track in layout.tracks:
                    mine = [t for t in trees if t.track == track]
                    if not own:
                        margin[part, layout.span(track)] += leaf_sums(mine, layout.classes, bins)
                        continue
                    for c in {t.client for t in mine}:
                        rows = np.flatnonzero(client[part] == c)
                        if len(rows):
                            found = leaf_sums([t for t in mine if t.client == c], layout.classes, bins[rows])
                            margin[rows + part.start, layout.span(track)] += found
            sizes = batch.column("n").to_numpy()
            kept = [batch.column(c) for c in _KEPT]
            shared = packed(moved(layout.margins(batch, "margin") if own else margin), sizes)
            added = [packed(moved(margin), sizes)] if own else []
            yield pa.RecordBatch.from_arrays([*kept, shared, *added], names=[*_KEPT, "margin", *["own"] * own])

    return run


def _judge(layout: _Layout, judged: Sequence[int]):
    """Kernel: confusion counts and log-loss sums of one task's validation rows."""
    classes = layout.classes
    cells = classes * classes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            margins, labels, owner = layout.margins(batch, layout.current), layout.numbers(batch, "label"), layout.numbers(batch, "client")
            for part in _slices(len(labels)):
                label = labels[part]
                clients, own = np.unique(owner[part], return_inverse=True)
                for t in judged:
                    m = margins[part, layout.span(t)]
                    m = m - m.max(axis=1, keepdims=True)
                    logp = m[np.arange(len(label)), label] - np.log(np.exp(m).sum(axis=1))
                    cell = own * cells + label * classes + m.argmax(axis=1)
                    sums = [np.bincount(cell, w, minlength=len(clients) * cells) for w in (None, -logp)]
                    for i, c in enumerate(clients):
                        found = np.array([s[i * cells : (i + 1) * cells] for s in sums])
                        total[t, int(c)] = total.get((t, int(c)), 0.0) + found
        for (t, c), (n, loss) in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), t, np.int32)),
                    pa.array([None if c == _NOBODY else c] * len(at), pa.int32()),
                    pa.array((at // classes).astype(np.int32)),
                    pa.array((at % classes).astype(np.int32)),
                    pa.array(n[at].astype(np.int64)),
                    pa.array(loss[at]),
                ],
                names=["track", "client", "true_class", "pred_class", "n", "loss"],
            )

    return run


def validate(data: BoostData, tracks: Sequence[int]) -> DataFrame:
    """Validation cells (track, client, true_class, pred_class, n, loss) of the model so far, or of each client's own."""
    layout = data.layout()
    blocks = data.blocks.where("is_val").select("client", "label", layout.current)
    cells = gathered(blocks).mapInArrow(
        _judge(layout, tracks),
        "track int, client int, true_class int, pred_class int, n bigint, loss double",
    )
    return cells.groupBy("track", "client", "true_class", "pred_class").agg(
        F.sum("n").alias("n"), F.sum("loss").alias("loss")
    )


def client_losses(cells: DataFrame) -> dict[tuple[int, int], float]:
    """Mean validation loss per (track, client): one number each."""
    rows = cells.groupBy("track", "client").agg((F.sum("loss") / F.sum("n")).alias("loss")).collect()
    return {(r["track"], r["client"]): r["loss"] for r in rows}


def track_scores(cells: DataFrame, by: Sequence[str] = ("track",)) -> DataFrame:
    """Weighted scores, mlogloss and the trial objective per group of validation cells.

    The objective is the weighted f1 (accuracy when only two classes occur).
    """
    from flowlake.operators.metrics import summary

    by = list(by)
    summed = cells.groupBy(*by, "true_class", "pred_class").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    losses = summed.groupBy(*by).agg(
        (F.sum("loss") / F.sum("n")).alias("mlogloss"),
        F.greatest(F.max("true_class"), F.max("pred_class")).alias("_top"),
    )
    scored = summary(summed, by).join(losses, by)
    objective = F.when(F.col("_top") <= 1, F.col("accuracy")).otherwise(F.col("f1"))
    return scored.withColumn("objective", F.coalesce(F.nanvl(objective, F.lit(0.0)), F.lit(0.0))).drop("_top")


def cell_scores(cells: Sequence[Row], classes: int) -> dict[str, float]:
    """Loss, accuracy and weighted f1 of one model's validation cells (at most clients * classes^2 rows)."""
    counts = np.zeros((classes, classes))
    for c in cells:
        counts[c["true_class"], c["pred_class"]] += c["n"]
    total, hits = counts.sum(), counts.diagonal()
    both = counts.sum(axis=0) + counts.sum(axis=1)
    f1 = np.divide(2 * hits, both, out=np.zeros(classes), where=both > 0)
    return {
        "mlogloss": float(sum(c["loss"] for c in cells) / total),
        "accuracy": float(hits.sum() / total),
        "f1": float((f1 * counts.sum(axis=1)).sum() / total),
    }


@dataclass
class Trainer:
    """Rounds over one prepared table. ``failed`` holds the tracks that ran out of finite numbers."""

    data: BoostData
    params: dict[int, BoostParams]
    trees: list[Tree] = field(default_factory=list)
    turn: int = 0
    failed: set[int] = field(default_factory=set)
    local_losses: list[tuple[int, int, int, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for track, p in self.params.items():
            if fault := p.fault():
                raise ValueError(f"track {track}: {fault}")
        # own margin tables: the prepared table stays as it is for the next trainer
        self.data = replace(self.data, slots=Slots(self.data.blocks.sparkSession, "margins"))

    def round(
        self,
        clients: Sequence[int] = (0,),
        local_rounds: int = 1,
        tracks: Sequence[int] | None = None,
        patience: int | None = None,
        last: bool = False,
    ) -> list[Tree]:
        """Let the clients train ``local_rounds`` from the current model, then append all their trees.

        After the ``last`` round nobody reads the margins: they are left as they are.

        With ``patience`` a client stops when its own validation loss has gone so many local rounds without
        a new best; the others go on. ``local_losses`` gets (turn, track, client, loss) for each of them.
        """
        params = {t: self.params[t] for t in (tracks if tracks is not None else self.params) if t not in self.failed}
        alone = len(clients) > 1 and local_rounds > 1
        live = {(t, c) for t in params for c in clients}
        stop = Patience(patience) if patience is not None else None
        made: list[Tree] = []
        for number in range(local_rounds):
            grown, failed = grow_round(self.data, params, sorted(live), self.turn)
            self.failed |= failed
            grown = [t for t in grown if t.track not in self.failed]
            made += grown
            live = {o for o in live if o[0] not in self.failed}
            final = number == local_rounds - 1
            if not alone and not (last and final):
                self._write(grown, own=False)
            elif alone and (stop or not final):
                self._write(grown, own=True)
            if stop and live:
                losses = client_losses(validate(self.data, sorted({t for t, _ in live})))
                self.local_losses += [(self.turn, *o, losses[o]) for o in sorted(live) if o in losses]
                live = {o for o in live if o not in losses or not stop.spent(o, losses[o], number)}
            self.turn += 1
            if not live:
                break
        made = [t for t in made if t.track not in self.failed]
        if alone and not last:
            self._write(made, own=False)
        self.trees = [t for t in self.trees if t.track not in self.failed] + made
        return made

    def _write(self, trees: list[Tree], own: bool) -> None:
        """Write the rows with ``trees`` in their margins; tracks that failed or were dropped leave them."""
        blocks, layout = self.data.blocks, self.data.layout()
        tracks = tuple(t for t in layout.tracks if t in self.params and t not in self.failed) or layout.tracks[:1]
        grown = blocks.mapInArrow(_adder(layout, trees, tracks, own), _BLOCK + ", own binary" * own)
        self.data.blocks = self.data.slots.put(grown, **BLOCK_OPTIONS)
        self.data.tracks = tracks

    def drop(self, tracks: Collection[int]) -> None:
        """Take tracks out of the race: their margins leave the rows with the next round."""
        self.params = {t: p for t, p in self.params.items() if t not in tracks}
        self.trees = [t for t in self.trees if t.track in self.params]

    def scores(self, tracks: Sequence[int] | None = None) -> DataFrame:
        return track_scores(validate(self.data, list(tracks if tracks is not None else self.params)))

    def model(self, start: BoostModel | None = None) -> BoostModel:
        before = start.trees if start else []
        shift = 1 + max((t.turn for t in before), default=-1)
        return BoostModel(
            self.data.features, self.data.classes, before + [replace(t, turn=t.turn + shift) for t in self.trees]
        )


def fit(
    data: BoostData, params: BoostParams, patience: int | None = None, start: BoostModel | None = None
) -> tuple[BoostModel, list[dict]]:
    """Boost until the rounds are done, or validation loss has not improved for ``patience`` rounds."""
    trainer = Trainer(data, {0: params})
    history: list[dict] = []
    stop = Patience(patience) if patience is not None else None
    for number in range(params.rounds):
        trainer.round(last=stop is None and number == params.rounds - 1)
        if trainer.failed:
            raise ArithmeticError(f"round {number} left the finite numbers; lower eta")
        if stop is None:
            continue
        record = cell_scores(validate(trainer.data, [0]).collect(), data.classes)
        history.append({"round": number, **record})
        if stop.spent(0, record["mlogloss"], number):
            break
    return trainer.model(start), history


def model_frame(spark: SparkSession, model: BoostModel) -> DataFrame:
    return spark.createDataFrame(model.node_rows(), NODE_SCHEMA)


