"""Multilayer perceptron trained by local mini-batch steps, for one owner or many clients at once.

An epoch is one pass and one job: every task starts from the common weights, takes its rows in shuffled
mini-batches, each an update, and sends the weights it arrives at, times its rows; Spark adds them up, position by
position, and the driver divides once. It holds one weight vector, whatever the number of tasks and clients. Rows of
a client are spread over all tasks, so a client with a third of the rows is no hot spot; a client's piece in a task has
weights of its own, and as their mean weighted by rows is linear, averaging the pieces is averaging the clients.
Every pass also counts predictions, from which epochs and clients get loss, accuracy, precision, recall and f1.
Rows that several passes read are written in blocks first, one table row for a stretch of training rows with their numbers
as bytes: a pass then moves blocks through Parquet, the JVM and Python, and its time is that of the steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.convergence import Patience
from flowlake.operators.encode import require_labels
from flowlake.operators.model import list_array, matrix_of, packed, softmax_rows, unpacked
from flowlake.sources.durable import BLOCK_OPTIONS, durable, gathered, spread


@dataclass(frozen=True)
class MlpSpec:
    """Network, loss (cross_entropy, focal or smoothing) and optimizer (adam or sgd)."""

    inputs: int
    classes: int
    hidden: tuple[int, ...] = (64,)
    loss: str = "cross_entropy"
    gamma: float = 2.0
    epsilon: float = 0.1
    rate: float = 0.01
    decay: float = 0.0
    seed: int = 42
    optimizer: str = "adam"

    @property
    def shapes(self) -> list[tuple[int, int]]:
        sizes = [self.inputs, *self.hidden, self.classes]
        return list(zip(sizes, sizes[1:]))


def start_weights(spec: MlpSpec) -> np.ndarray:
    """He-initialised flat weight vector."""
    rng = np.random.default_rng(spec.seed)
    parts = [np.concatenate([rng.normal(0, np.sqrt(2 / i), i * o), np.zeros(o)]) for i, o in spec.shapes]
    return np.concatenate(parts)


def _layers(flat: np.ndarray, spec: MlpSpec) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for i, o in spec.shapes:
        out.append((flat[at : at + i * o].reshape(i, o), flat[at + i * o : at + i * o + o]))
        at += i * o + o
    return out


def _forward(x: np.ndarray, layers) -> list[np.ndarray]:
    acts = [x]
    for n, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0.0) if n < len(layers) - 1 else z)
    return acts


def _loss_gradient(z: np.ndarray, y: np.ndarray, weight: np.ndarray, spec: MlpSpec) -> tuple[float, np.ndarray]:
    """Summed loss of the rows and its gradient in the logits."""
    p = softmax_rows(z)
    rows = np.arange(len(y))
    hot = np.zeros_like(p)
    hot[rows, y] = 1.0
    logp = np.log(np.maximum(p, 1e-300))
    if spec.loss == "smoothing":
        target = (1 - spec.epsilon) * hot + spec.epsilon / spec.classes
        return float((weight[:, None] * -target * logp).sum() / spec.classes), weight[:, None] * (p - target) / spec.classes
    if spec.loss == "focal":
        pt = np.minimum(p[rows, y], 1 - 1e-12)
        lt = logp[rows, y]
        slope = spec.gamma * (1 - pt) ** (spec.gamma - 1) * pt * lt - (1 - pt) ** spec.gamma
        return float((weight * (1 - pt) ** spec.gamma * -lt).sum()), (weight * slope)[:, None] * (hot - p)
    return float((weight * -logp[rows, y]).sum()), weight[:, None] * (p - hot)


def _slope(z: np.ndarray, y: np.ndarray, at: np.ndarray, weight: np.ndarray | None, spec: MlpSpec) -> np.ndarray:
    """The gradient of ``_loss_gradient`` without the loss, in the place of ``z``.

    ``at`` has the positions of the true classes in ``z``, a row after the other; no ``weight`` is 1 everywhere.
    """
    if spec.loss == "smoothing":
        return _loss_gradient(z, y, np.ones(len(y)) if weight is None else weight, spec)[1]
    z -= np.maximum.reduce(z, axis=1, keepdims=True)
    p = np.exp(z, out=z)
    p /= np.add.reduce(p, axis=1, keepdims=True)
    flat = p.reshape(-1)
    true = flat.take(at)
    if spec.loss == "focal":
        pt = np.minimum(true, 1 - 1e-12)
        rest = 1 - pt
        slope = spec.gamma * rest ** (spec.gamma - 1) * pt
        slope *= np.log(np.maximum(true, 1e-300))
        slope -= rest**spec.gamma
        np.negative(p, out=p)
        flat[at] = 1.0 - true
        p *= (slope if weight is None else weight * slope)[:, None]
        return p
    flat[at] = true - 1.0
    if weight is not None:
        p *= weight[:, None]
    return p


def loss_and_gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, spec: MlpSpec):
    layers = _layers(flat, spec)
    acts = _forward(x, layers)
    loss, delta = _loss_gradient(acts[-1], y, weight, spec)
    parts = []
    for n in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(acts[n].T @ delta).ravel(), delta.sum(axis=0)]))
        if n:
            delta = (delta @ layers[n][0].T) * (acts[n] > 0)
    return loss, np.concatenate(parts[::-1])


def prepare_rows(
    df: DataFrame, features: str, label: str, client: str | None = None, weight: str | None = None, classes: int | None = None
) -> DataFrame:
    """Written training rows (x, label, client, weight); labels must be known classes, of ``classes`` if given."""
    rows = durable(
        spread(df).select(
            F.col(features).cast("array<double>").alias("x"),
            F.col(label).cast("int").alias("label"),
            (F.col(client).cast("int") if client else F.lit(0)).alias("client"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        ),
        "mlp",
    )
    return require_labels(rows, "label", classes)


def _kernel(current: dict[int, np.ndarray], spec: MlpSpec):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"), spec.inputs)
            y, weight = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
            client = batch.column("client").to_numpy()
            for c, flat in current.items():
                own = np.flatnonzero(client == c)
                if len(own):
                    loss, gradient = loss_and_gradient(flat, x[own], y[own], weight[own], spec)
                    part = np.concatenate([gradient, [loss, weight[own].sum(), len(own)]])
                    sums[c] = sums.get(c, 0.0) + part
        for c, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), c, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)],
                names=["client", "pos", "value"],
            )

    return run


def gradient_step(rows: DataFrame, current: dict[int, np.ndarray], spec: MlpSpec) -> dict[int, tuple[np.ndarray, float, int]]:
    """Mean gradient, mean loss and row count per client, from one job.

    The driver receives one number per weight and client.
    """
    parts = gathered(rows).mapInArrow(_kernel(current, spec), "client int, pos int, value double")
    summed = parts.groupBy("client", "pos").agg(F.sum("value").alias("value"))
    width = len(next(iter(current.values()))) + 3
    table: dict[int, np.ndarray] = {}
    for r in summed.collect():
        table.setdefault(r["client"], np.zeros(width))[r["pos"]] = r["value"]
    return {c: (v[:-3] / v[-2], v[-3] / v[-2], int(round(v[-1]))) for c, v in table.items()}


# Adam's decay rates and the guard of its division.
_KEEP, _KEEP_SQUARES, _GUARD = 0.9, 0.999, 1e-8


@dataclass
class State:
    """Weights and the optimiser's running means, as one vector each; what a pass starts from and ends with."""

    flat: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: float = 0.0

    @staticmethod
    def fresh(flat: np.ndarray) -> State:
        return State(flat, np.zeros(len(flat)), np.zeros(len(flat)))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.flat, self.mean, self.square, [self.steps]])

    @staticmethod
    def of(vector: np.ndarray) -> State:
        flat, mean, square = np.split(vector[:-1], 3)
        return State(flat, mean, square, float(vector[-1]))

    def step(self, gradient: np.ndarray, spec: MlpSpec) -> State:
        g = gradient + spec.decay * self.flat
        if spec.optimizer == "sgd":
            return State(self.flat - spec.rate * g, self.mean, self.square, self.steps + 1)
        t = self.steps + 1
        mean = _KEEP * self.mean + (1 - _KEEP) * g
        square = _KEEP_SQUARES * self.square + (1 - _KEEP_SQUARES) * g * g
        m, v = mean / (1 - _KEEP**t), square / (1 - _KEEP_SQUARES**t)
        return State(self.flat - spec.rate * m / (np.sqrt(v) + _GUARD), mean, square, t)


# What the parts of a pass's sums are: weights times rows, prediction cells, and loss with weight and rows.
_WEIGHTS, _CELLS, _TOTALS = 0, 1, 2
_SUMS = "kind int, client int, pos int, value double"


def _part(kind: int, client: int, values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    heads = [pa.array(np.full(len(at), v, np.int32)) for v in (kind, client)]
    return pa.RecordBatch.from_arrays([*heads, pa.array(at.astype(np.int32)), pa.array(values[at])], names=["kind", "client", "pos", "value"])


class _Tally:
    """Prediction cells, loss, weight and rows per client."""

    def __init__(self, classes: int):
        self._classes = classes
        self._cells: dict[int, np.ndarray] = {}
        self._totals: dict[int, np.ndarray] = {}

    def add(self, client: int, z: np.ndarray, y: np.ndarray, weight: np.ndarray, spec: MlpSpec) -> None:
        loss, _ = _loss_gradient(z, y, weight, spec)
        cells = np.bincount(y * self._classes + z.argmax(axis=1), minlength=self._classes**2)
        self._cells[client] = self._cells.get(client, 0.0) + cells
        self._totals[client] = self._totals.get(client, 0.0) + np.array([loss, weight.sum(), len(y)])

    def parts(self) -> Iterator[pa.RecordBatch]:
        for client, cells in self._cells.items():
            yield _part(_CELLS, client, cells.astype(float))
            yield _part(_TOTALS, client, self._totals[client])


# what stands for no client in a block: no int
_NOBODY = -(1 << 62)
_BLOCK = "part int, n int, x binary, label binary, weight binary, client binary"


def _clients_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("client").cast(pa.int64()).fill_null(_NOBODY).to_numpy()


def _blocks(rows: DataFrame, spec: MlpSpec) -> DataFrame:
    """``rows``, written in blocks: the stretches in which a pass over the rows would meet them, numbered by its tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                numbers = [matrix_of(batch.column("x"), spec.inputs), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight")), _clients_of(batch)]
                columns = [packed(v.reshape(batch.num_rows, -1), np.array([batch.num_rows])) for v in numbers]
                heads = [pa.array([v], pa.int32()) for v in (part, batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*heads, *columns], names=["part", "n", "x", "label", "weight", "client"])

    return durable(gathered(rows).mapInArrow(run, _BLOCK), "mlp-blocks", **BLOCK_OPTIONS)


def _stretches(batch: pa.RecordBatch, spec: MlpSpec) -> Iterator[tuple]:
    """(part, x, label, weight, client) of a batch of rows, or of every block of a batch of blocks."""
    if not batch.num_rows:
        return
    if "n" not in batch.schema.names:
        x = matrix_of(batch.column("x"), spec.inputs)
        yield TaskContext.get().partitionId(), x, batch.column("label").to_numpy(), batch.column("weight").to_numpy(zero_copy_only=False), _clients_of(batch)
        return
    x = unpacked(batch.column("x"), spec.inputs, np.float64)
    label, weight, client = (unpacked(batch.column(c), 1, kind).ravel() for c, kind in (("label", np.int32), ("weight", np.float64), ("client", np.int64)))
    at = 0
    for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist()):
        span = slice(at, at + n)
        yield part, x[span], label[span], weight[span], client[span]
        at += n


def _trained(state: State, x: np.ndarray, y: np.ndarray, weight: np.ndarray, batch_rows: int, spec: MlpSpec) -> State:
    """The state after a step for each ``batch_rows`` rows in turn."""
    flat, mean, square, t = state.flat.copy(), state.mean.copy(), state.square.copy(), state.steps
    g, root = np.empty(len(flat)), np.empty(len(flat))
    layers, parts = _layers(flat, spec), _layers(g, spec)
    last = len(layers) - 1
    even = bool((weight == 1.0).all())
    true = np.arange(len(y)) % batch_rows * spec.classes + y
    for at in range(0, len(y), batch_rows):
        some = slice(at, at + batch_rows)
        acts = [x[some]]
        for n, (w, b) in enumerate(layers):
            z = acts[-1] @ w
            z += b
            acts.append(np.maximum(z, 0.0, out=z) if n < last else z)
        delta = _slope(acts.pop(), y[some], true[some], None if even else weight[some], spec)
        for n in range(last, -1, -1):
            np.matmul(acts[n].T, delta, out=parts[n][0])
            np.add.reduce(delta, axis=0, out=parts[n][1])
            if n:
                delta = delta @ layers[n][0].T
                delta *= acts[n] > 0
        g /= max(len(acts[0]) if even else weight[some].sum(), 1e-300)
        if spec.decay:
            g += spec.decay * flat
        t += 1
        if spec.optimizer == "sgd":
            flat -= spec.rate * g
            continue
        mean *= _KEEP
        mean += (1 - _KEEP) * g
        square *= _KEEP_SQUARES
        np.multiply(g, 1 - _KEEP_SQUARES, out=root)
        root *= g
        square += root
        np.divide(square, 1 - _KEEP_SQUARES**t, out=root)
        np.sqrt(root, out=root)
        root += _GUARD
        np.divide(mean, 1 - _KEEP**t, out=g)
        g *= spec.rate
        g /= root
        flat -= g
    return State(flat, mean, square, t)


def _local(start: State, spec: MlpSpec, number: int, batch_rows: int | None, passes: int, clients: tuple[int, ...] | None):
    """Kernel: train each client's piece of a part from ``start``, by stretches as they arrive.

    Without ``batch_rows`` a piece takes a single step, by the mean gradient of all its rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], State] = {}
        rows: dict[tuple[int, int], int] = {}
        whole: dict[tuple[int, int], list] = {}
        draws: dict[int, np.random.Generator] = {}
        tally = _Tally(spec.classes)
        for part, x, y, weight, client in (s for batch in batches for s in _stretches(batch, spec)):
            rng = draws.setdefault(part, np.random.default_rng([spec.seed, number, part]))
            for c in np.unique(client).tolist():
                if c == _NOBODY or (clients is not None and c not in clients):
                    continue
                mine = np.flatnonzero(client == c)
                state = own.setdefault((part, c), start)
                rows[part, c] = rows.get((part, c), 0) + len(mine)
                tally.add(c, _forward(x[mine], _layers(state.flat, spec))[-1], y[mine], weight[mine], spec)
                if batch_rows is None:
                    _, g = loss_and_gradient(state.flat, x[mine], y[mine], weight[mine], spec)
                    so_far = whole.setdefault((part, c), [0.0, 0.0])
                    whole[part, c] = [so_far[0] + g, so_far[1] + weight[mine].sum()]
                    continue
                for _ in range(passes):
                    order = rng.permutation(mine)
                    state = _trained(state, x[order], y[order], weight[order], batch_rows, spec)
                own[part, c] = state
        for piece, (g, total) in whole.items():
            own[piece] = own[piece].step(g / max(total, 1e-300), spec)
        ended: dict[int, np.ndarray] = {}
        for (part, c), state in own.items():
            ended[c] = ended.get(c, 0.0) + state.vector() * rows[part, c]
        for c, vector in ended.items():
            yield _part(_WEIGHTS, c, vector)
        yield from tally.parts()

    return run


def _judged(flat: np.ndarray, spec: MlpSpec):
    """Kernel: prediction cells and loss of the rows, by client."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(spec.classes)
        for _, x, y, weight, client in (s for batch in batches for s in _stretches(batch, spec)):
            for c in np.unique(client).tolist():
                if c != _NOBODY:
                    mine = client == c
                    tally.add(c, _forward(x[mine], _layers(flat, spec))[-1], y[mine], weight[mine], spec)
        yield from tally.parts()

    return run


METRICS = ("loss", "accuracy", "precision", "recall", "f1")


def _scores(cells: np.ndarray, totals: np.ndarray) -> dict[str, float]:
    """Mean loss and support-weighted scores of one confusion matrix."""
    support, predicted, hits = cells.sum(axis=1), cells.sum(axis=0), cells.diagonal()
    n = max(cells.sum(), 1.0)

    def share(a: np.ndarray, b: np.ndarray) -> float:
        return float((np.divide(a, b, out=np.zeros(len(a)), where=b > 0) * support).sum() / n)

    right = float(hits.sum() / n)
    return {
        "loss": float(totals[0] / totals[1]) if totals[1] else 0.0,
        "accuracy": right,
        "precision": share(hits, predicted),
        "recall": right,
        "f1": share(2 * hits, support + predicted),
    }


def _pass(parts: DataFrame, spec: MlpSpec, size: int = 0) -> tuple[np.ndarray | None, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Mean state over all pieces, and (cells, totals) per client, of one job.

    Weights are added over tasks and clients in Spark: the driver gets one number per position of the
    state, and classes^2 cells a client.
    """
    key = F.when(F.col("kind") == _WEIGHTS, F.lit(-1)).otherwise(F.col("client"))
    summed = parts.groupBy("kind", key.alias("client"), "pos").agg(F.sum("value").alias("value")).collect()
    k = spec.classes
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    state = np.zeros(size)
    for r in summed:
        if r["kind"] == _WEIGHTS:
            state[r["pos"]] = r["value"]
        else:
            cells, totals = found.setdefault(r["client"], (np.zeros(k * k), np.zeros(3)))
            (cells if r["kind"] == _CELLS else totals)[r["pos"]] = r["value"]
    rows = sum(t[2] for _, t in found.values())
    return (state / rows if rows else None), found


def _together(found: dict[int, tuple[np.ndarray, np.ndarray]], spec: MlpSpec) -> tuple[np.ndarray, np.ndarray]:
    k = spec.classes
    cells = sum((c for c, _ in found.values()), np.zeros(k * k)).reshape(k, k)
    return cells, sum((t for _, t in found.values()), np.zeros(3))


def evaluate_mlp(rows: DataFrame, flat: np.ndarray, spec: MlpSpec) -> dict[str, dict[str, float]]:
    """Loss, accuracy, precision, recall, f1 and rows of each client (``client_0``, ...) and of all (``all``), from one pass."""
    _, found = _pass(gathered(rows).mapInArrow(_judged(flat, spec), _SUMS), spec)
    k = spec.classes
    each = {f"client_{c}": (cells.reshape(k, k), totals) for c, (cells, totals) in sorted(found.items())}
    each["all"] = _together(found, spec)
    return {name: {**_scores(cells, totals), "n": int(totals[2])} for name, (cells, totals) in each.items()}


# Rows of a mini-batch.
BATCH_ROWS = 64


def fit_mlp(
    rows: DataFrame,
    spec: MlpSpec,
    epochs: int = 20,
    validation: DataFrame | None = None,
    patience: int | None = None,
    batch_rows: int | None = BATCH_ROWS,
) -> tuple[np.ndarray, list[dict]]:
    """Mini-batch training, one pass an epoch; with validation rows, stops after ``patience`` epochs without a new best.

    The history has loss, accuracy, precision, recall and f1 of every epoch, ``train_`` as met during the
    pass and ``val_`` after it.
    """
    state = State.fresh(start_weights(spec))
    history: list[dict] = []
    best, best_flat = float("inf"), state.flat
    if epochs > 1:
        rows, validation = (None if df is None else _blocks(df, spec) for df in (rows, validation))
    stop = Patience(patience) if patience is not None else None
    for epoch in range(epochs):
        parts = gathered(rows).mapInArrow(_local(state, spec, epoch, batch_rows, 1, None), _SUMS)
        mean, found = _pass(parts, spec, 3 * len(state.flat) + 1)
        if mean is None:
            break
        state = State.of(mean)
        record = {"epoch": epoch, **{f"train_{m}": v for m, v in _scores(*_together(found, spec)).items()}}
        history.append(record)
        if validation is None:
            continue
        held = evaluate_mlp(validation, state.flat, spec)["all"]
        record |= {f"val_{m}": held[m] for m in METRICS}
        if held["loss"] < best:
            best, best_flat = held["loss"], state.flat
        if stop and stop.spent(0, held["loss"], epoch):
            break
    return (best_flat if validation is not None else state.flat), history


def federated_average(
    rows: DataFrame,
    spec: MlpSpec,
    clients: Sequence[int],
    rounds: int,
    local_steps: int = 1,
    validation: DataFrame | None = None,
    batch_rows: int | None = BATCH_ROWS,
    start: np.ndarray | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """FedAvg: clients train from the global weights, which become their row-weighted mean.

    Each round is one pass; ``local_steps`` is how often a client goes over each stretch of its rows. A client's optimiser
    starts afresh every round. The history has a record per round with loss and rows, and with ``clients``: each
    client's training scores; with validation rows also ``validation``: the averaged network's scores on each client's
    rows, and on all of them.
    """
    flat = start_weights(spec) if start is None else start
    history: list[dict] = []
    if rounds > 1:
        rows, validation = (None if df is None else _blocks(df, spec) for df in (rows, validation))
    for number in range(1, rounds + 1):
        kernel = _local(State.fresh(flat), spec, number, batch_rows, local_steps, tuple(clients))
        mean, found = _pass(gathered(rows).mapInArrow(kernel, _SUMS), spec, 3 * len(flat) + 1)
        if mean is None:
            break
        flat = State.of(mean).flat
        k = spec.classes
        cells, totals = _together(found, spec)
        record = {"round": number, **_scores(cells, totals), "n": int(totals[2])}
        record["clients"] = {c: {**_scores(own.reshape(k, k), t), "n": int(t[2])} for c, (own, t) in sorted(found.items())}
        if validation is not None:
            record["validation"] = evaluate_mlp(validation, flat, spec)
        history.append(record)
    return flat, history


def predict_mlp(df: DataFrame, features: str, flat: np.ndarray, spec: MlpSpec, out: str = "probs") -> DataFrame:
    """Class probabilities of each row."""

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        return list_array(softmax_rows(_forward(matrix_of(x, spec.inputs), _layers(flat, spec))[-1]))

    return df.withColumn(out, score(F.col(features).cast("array<double>")))


def pipeline_mlp(df: DataFrame, columns: Sequence[str], label: str, hidden: Sequence[int], classes: int, steps: int = 50):
    """Assemble, standardise and fit Spark's own perceptron in one Pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        MultilayerPerceptronClassifier(
            featuresCol="_scaled", labelCol=label, predictionCol="pred", layers=[len(columns), *hidden, classes],
            maxIter=steps, seed=42,
        ),
    ]
    return Pipeline(stages=stages).fit(df)
