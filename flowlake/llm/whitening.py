"""Whitening of embeddings by their leading principal components, found by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so sums and means are exact. The covariance is never built: a pass over the
table multiplies it with a block of vectors, as centred XᵀXQ summed over tasks. A Chebyshev polynomial, evaluated by its
recurrence with one pass a degree, damps the unwanted part of the spectrum; QR and a
Rayleigh-Ritz step then turn the block into approximate eigenvectors. Components whose residual
norm is under the tolerance are locked; the iteration ends when all wanted ones are. A few Lanczos steps, carried by the
first passes as one more column, bound the spectrum from below. A last pass measures how far the covariance of the
whitened vectors is from the identity.

Edge cases: rows whose vector is null or empty, holds a null, NaN or infinite entry, or has another length than
most (of equally frequent lengths: the longest) are dropped; a null id stays null; repeated rows
count each time; components with no variance to speak of cannot be scaled and are left out, so one
row, equal rows or an empty table give no rows. Entries must stay under 2^40.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, picked
from flowlake.sources.durable import durable

COMPONENTS = 32
# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Residual norms end under this part of the largest eigenvalue.
TOLERANCE = 1e-12
DEGREE = 16
_ROUNDS = 100
_LANCZOS = 12
# A filter may raise one wanted component over another by so much; more would drown the lesser one in rounding.
_CONTRAST = 1e8
# An eigenvalue under this part of the largest one is rounding.
_NOTHING = 1e-11
_SEED = 20_240
# Vectors in a block of the written table, and turned into output rows at a time.
_BLOCK = 2048


def sound(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of length ``size``, and their whole numbers less ``SHIFT``."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    finite = np.isfinite(values).all(axis=1)
    return at[finite], np.floor(values[finite] * SCALE).astype(np.int64)


def length(vectors: DataFrame) -> int | None:
    """The length of most usable vectors; of equally frequent ones the largest."""

    def kernel(batches):
        for batch in batches:
            column = batch.column(0)
            sizes = [s for s in pc.unique(pc.list_value_length(column)).to_pylist() if s]
            counts = [len(sound(column, s)[0]) for s in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["size", "n"])

    fields = [T.StructField("size", T.IntegerType()), T.StructField("n", T.LongType())]
    counts = arrow_map(vectors.select("vector"), kernel, fields).groupBy("size").agg(F.sum("n").alias("n"))
    most = counts.where("n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    return most and most["size"]


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Written ``(n, data)``: the usable vectors as whole numbers, many to a row."""

    def kernel(batches):
        for batch in batches:
            _, x = sound(batch.column(0), size)
            parts = [x[i : i + _BLOCK] for i in range(0, len(x), _BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["n", "data"]
            )

    fields = [T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())]
    return durable(arrow_map(vectors.select("vector"), kernel, fields), "vector-blocks")


def _summed(table: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray], kind=T.DoubleType()) -> np.ndarray:
    """Sum over all blocks of the matrix that ``work`` makes of one; every task sends one matrix, Spark adds them."""
    width = work(np.zeros((1, size), np.int64)).shape[1]
    names = [f"v{j}" for j in range(width)]

    def kernel(batches):
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                made = work(np.frombuffer(data, np.int64).reshape(-1, size))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], names=["row", *names])

    fields = [T.StructField("row", T.LongType()), *[T.StructField(n, kind) for n in names]]
    rows = arrow_map(table.select("data"), kernel, fields).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    return np.array([r[1:] for r in sorted(map(tuple, rows.collect()))])


@dataclass(frozen=True)
class Centre:
    """Number of vectors, and per dimension the sum of their whole numbers less ``SHIFT``."""

    n: int
    sums: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exact."""
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x) / self.n


class _Lanczos:
    """Steps of the Lanczos recurrence with whole reorthogonalisation; each takes one product with the operator."""

    def __init__(self, size: int, steps: int, rng):
        start = rng.standard_normal(size)
        self.basis = [start / np.linalg.norm(start)]
        self._steps = min(steps, size)
        self._own: list[float] = []
        self._off: list[float] = []

    @property
    def wanted(self) -> bool:
        return len(self._own) < self._steps

    def take(self, product: np.ndarray) -> None:
        self._own.append(float(self.basis[-1] @ product))
        known = np.array(self.basis)
        for _ in range(2):
            product = product - known.T @ (known @ product)
        self._off.append(float(np.linalg.norm(product)))
        if self._off[-1] <= 1e-12 * max(abs(v) for v in self._own):
            self._steps = len(self._own)
        else:
            self.basis.append(product / self._off[-1])

    def lowest(self) -> float:
        """A lower bound of the spectrum as far as the steps show; 0 while they go on."""
        if self.wanted:
            return 0.0
        inner = np.diag(self._own) + np.diag(self._off[:-1], 1) + np.diag(self._off[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(inner)[0]) - self._off[-1])


@dataclass
class Spectrum:
    """Leading eigenvalues and unit eigenvectors (columns), what certifies them, and the passes they took."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int


def _degree(first: float, last: float) -> int:
    """The highest degree that keeps the wanted components within ``_CONTRAST`` of each other."""
    apart = math.acosh(max(first, 1.0)) - math.acosh(max(last, 1.0))
    return DEGREE if apart <= 0 else max(2, min(DEGREE, int(math.log(_CONTRAST) / apart)))


def leading(
    multiply: Callable[[np.ndarray], np.ndarray], size: int, count: int, trace: float, tolerance: float = TOLERANCE
) -> Spectrum:
    """The ``count`` largest eigenpairs of the symmetric operator ``multiply``, which is asked for whole blocks only."""
    rng = np.random.default_rng(_SEED)
    count = min(count, size)
    lanczos = _Lanczos(size, _LANCZOS, rng)
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        if not lanczos.wanted:
            return multiply(q)
        both = multiply(np.column_stack([q, lanczos.basis[-1]]))
        lanczos.take(both[:, -1])
        return both[:, :-1]

    q = np.linalg.qr(rng.standard_normal((size, min(size, count + max(8, count // 2)))))[0]
    locked, values, residuals = np.empty((size, 0)), [], []

    def apart(x: np.ndarray) -> np.ndarray:
        """``x`` without what lies in the locked components."""
        return x - locked @ (locked.T @ x)

    for _ in range(_ROUNDS):
        y = apart(product(q))
        ritz, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        left = np.linalg.norm(y - q * ritz, axis=0)
        top = max([*values[:1], ritz[0]])
        done = 0
        while len(values) < count and done < len(ritz) and left[done] <= tolerance * top:
            values.append(float(ritz[done]))
            residuals.append(float(left[done]))
            done += 1
        locked = np.column_stack([locked, q[:, :done]])
        if len(values) == count:
            return Spectrum(np.array(values), locked, np.array(residuals), trace, passes)
        q, y, ritz = apart(q[:, done:]), apart(y[:, done:]), ritz[done:]
        high, low = float(ritz[-1]), lanczos.lowest()
        low = low if low < high else 0.0
        middle, half = (high + low) / 2, (high - low) / 2
        if half <= 1e-8 * top:
            # nothing worth damping is left outside the block: one plain step
            q = np.linalg.qr(apart(y))[0]
            continue
        last = ritz[min(count - len(values), len(ritz)) - 1]
        before, now = q, apart(y - middle * q) / half
        for _ in range(_degree((ritz[0] - middle) / half, (last - middle) / half) - 1):
            before, now = now, apart(2 / half * (product(now) - middle * now) - before)
        now = now / np.linalg.norm(now, axis=0)
        q = np.linalg.qr(apart(np.linalg.qr(now)[0]))[0]
    raise RuntimeError("the components did not settle")


@dataclass
class Whitener:
    """What whitening needs: mean, components, and how well they do on the vectors they were fitted on."""

    size: int
    centre: Centre
    spectrum: Spectrum
    identity_error: float

    def scaled(self) -> np.ndarray:
        return self.spectrum.vectors / np.sqrt(self.spectrum.values)


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Components of all usable vectors of ``df``; None when there are none."""
    vectors = picked(df, id=id_col, vector=vector_col)
    size = length(vectors)
    if size is None:
        return None
    table = blocks(vectors, size)
    n = table.agg(F.sum("n")).first()[0]
    centre = Centre(n, _summed(table, size, lambda x: x.sum(axis=0)[:, None], T.LongType())[:, 0])

    def multiply(q: np.ndarray) -> np.ndarray:
        return _summed(table, size, lambda x: (c := centre.centred(x)).T @ (c @ q)) / n

    trace = float(_summed(table, size, lambda x: (centre.centred(x) ** 2).sum(axis=0)[:, None]).sum() / n)
    if trace == 0:
        return Whitener(size, centre, Spectrum(np.empty(0), np.empty((size, 0)), np.empty(0), 0.0, 0), 0.0)
    found = leading(multiply, size, components, trace)
    kept = int((found.values > _NOTHING * found.values[0]).sum())
    found = Spectrum(found.values[:kept], found.vectors[:, :kept], found.residuals[:kept], trace, found.passes)
    scaled = found.vectors / np.sqrt(found.values)
    gram = _summed(table, size, lambda x: (w := centre.centred(x) @ scaled).T @ w) / n
    return Whitener(size, centre, found, float(np.abs(gram - np.eye(kept)).max()))


def _squared(deviations: np.ndarray) -> pa.Array:
    """Exact sums of squares by row."""
    largest = int(np.abs(deviations).max(initial=0))
    if largest**2 * deviations.shape[1] < 1 << 63:
        return pa.array((deviations * deviations).sum(axis=1)).cast(pa.decimal128(38, 0))
    sums = (deviations.astype(object) ** 2).sum(axis=1)
    return pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row for each usable vector and component.

    ``deviation`` is exact, as ``decimal(38, 0)``.
    """
    vectors = picked(df, id=id_col, vector=vector_col)
    fields = [
        T.StructField("id", vectors.schema["id"].dataType),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]
    fitted = fit(df, id_col, vector_col, components)
    if fitted is None or not len(fitted.spectrum.values):
        return df.sparkSession.createDataFrame([], T.StructType(fields))
    scaled, count = fitted.scaled(), len(fitted.spectrum.values)
    explained = fitted.spectrum.values / fitted.spectrum.trace
    centre, size, error = fitted.centre, fitted.size, fitted.identity_error

    def kernel(batches):
        for batch in batches:
            places, x = sound(batch.column(1), size)
            for i in range(0, len(x), _BLOCK):
                away = centre.deviations(x[i : i + _BLOCK])
                rows = np.repeat(np.arange(len(away)), count)
                total = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(places[i + rows])),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(away))),
                        pa.array(np.full(total, centre.n)),
                        _squared(away).take(pa.array(rows)),
                        pa.array(((away / centre.n) @ scaled).ravel()),
                        pa.array(np.tile(explained, len(away))),
                        pa.array(np.full(total, error)),
                    ],
                    names=[f.name for f in fields],
                )

    return arrow_map(vectors, kernel, fields)
