"""Quality classifier by positive-unlabelled learning.

Trusted positives and the unlabelled mass of web text are told apart by the non-negative
unbiased risk ``pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])`` with logistic loss l and a
linear g over how a text is written: pairs of character classes, repetition of words and lines,
word lengths. The unlabelled expectation runs over every document, one small aggregate per
step; the class prior pi is estimated from the labels of the training rows.

Edge cases: a null text is empty; empty texts have all-zero features and get the score of the
bias alone; very long texts are read whole; rows without label are unlabelled, and so are held-
out rows; several labels of an id count as positive only if all are; repeated rows count each
time; without trusted positives every score is the prior; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, field, picked, texts
from flowlake.sources.durable import durable

STEPS = 14
RIDGE = 1e-3
PRIOR = 0.8  # where no labels of both kinds allow an estimate

# Character classes: lower, upper, digit, newline, other blank, ten signs of their own, other ASCII signs, UTF-8 beyond ASCII.
_SIGNS = b".,!?|*#$%&"
_CLASSES = 7 + len(_SIGNS)
_CLASS = np.full(256, 5, np.uint8)
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[10] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[128:] = 6
for _i, _sign in enumerate(_SIGNS):
    _CLASS[_sign] = 7 + _i
_SHAPE = 8
WIDTH = _CLASSES * _CLASSES + _SHAPE + 1


def features(text: bytes) -> np.ndarray:
    """WIDTH numbers, the last one 1 for the bias."""
    out = np.zeros(WIDTH, np.float32)
    out[-1] = 1
    found = text.lower().split()
    if not found:
        return out
    kinds = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int16)
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / max(1, len(kinds) - 1))
    n = len(found)
    lines = [line for line in text.split(b"\n") if line.strip()]
    distinct = len(set(found))
    same = sum(map(bytes.__eq__, found, found[1:]))
    twos = len(set(zip(found, found[1:])))
    mean = sum(map(len, found)) / n
    out[_CLASSES * _CLASSES : -1] = (
        distinct / n**0.8,
        same / n,
        1 - (twos + 1) / n,
        1 - len(set(lines)) / len(lines),
        min(mean, 40) / 10,
        max(0.0, mean - 8) / 10,
        np.log1p(n) / 10,
        1 / n,
    )
    return out


def feature_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x)`` for every row: x holds the features as 32-bit floats."""

    def kernel(batches):
        for batch in batches:
            x = [features(t).tobytes() for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["id", "x"])

    rows = picked(df, id=id_col, text=text_col)
    return arrow_map(rows, kernel, [field(rows, "id"), T.StructField("x", T.BinaryType())])


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)


@dataclass
class Scorer:
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(rows: DataFrame, weights: np.ndarray | None) -> np.ndarray:
    """Over ``rows(x)``: count, sum of x, and with weights g = wx the losses, gradient and curvature of l(-g).

    One row of WIDTH x WIDTH numbers per task is added up by Spark; the driver sees one.
    """
    size = 3 + 2 * WIDTH + (WIDTH * WIDTH if weights is not None else 0)

    def kernel(batches):
        total = np.zeros(size)
        for batch in batches:
            x = _stack(batch.column(0))
            total[0] += len(x)
            total[3 : 3 + WIDTH] += x.sum(axis=0)
            if weights is not None:
                g = x @ weights
                s = _sigmoid(g)
                total[1] += np.logaddexp(0, -g).sum()
                total[2] += np.logaddexp(0, g).sum()
                total[3 + WIDTH : 3 + 2 * WIDTH] += s @ x
                total[3 + 2 * WIDTH :] += ((x * (s * (1 - s))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "value"])

    fields = [T.StructField("cell", T.LongType()), T.StructField("value", T.DoubleType())]
    added = arrow_map(rows.select("x"), kernel, fields).groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[added.column(0).to_numpy()] = added.column(1).to_numpy()
    return out


def fit(everything: DataFrame, positives: DataFrame, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> Scorer:
    """Minimise the non-negative risk over ``positives(x)`` and all of ``everything(x)`` by Newton steps.

    With logistic loss l(g) - l(-g) = -g, so the unbiased risk is convex and needs only the sum of
    the positives. Where the negative part ``E_U[l(-g)] - pi E_P[l(-g)]`` is below zero, the step
    goes up that part instead of down the risk.
    """
    p = _sums(positives, None)
    weights = np.zeros(WIDTH)
    if not p[0]:
        weights[-1] = np.log(prior / (1 - prior))
        return Scorer(weights, prior)
    mean = p[3 : 3 + WIDTH] / p[0]
    weights[-1] = np.log(prior / (1 - prior))
    penalty = np.full(WIDTH, ridge)
    penalty[-1] = 0
    best, least = weights, np.inf
    for _ in range(steps):
        u = _sums(everything, weights)
        here = _sums(positives, weights)
        n = u[0]
        negative = u[2] / n - prior * here[2] / here[0]
        risk = prior * here[1] / here[0] + max(0.0, negative) + 0.5 * (penalty * weights**2).sum()
        if risk < least:
            settled = least - risk < 1e-6
            best, least = weights, risk
            if settled:
                break
        push = u[3 + WIDTH : 3 + 2 * WIDTH] / n
        if negative < 0:
            gradient = prior * here[3 + WIDTH : 3 + 2 * WIDTH] / here[0] - push
        else:
            gradient = push - prior * mean + penalty * weights
        curve = u[3 + 2 * WIDTH :].reshape(WIDTH, WIDTH) / n + np.diag(penalty + 1e-9)
        weights = weights - np.linalg.solve(curve, gradient)
    return Scorer(best, prior)


def trusted(labels: DataFrame, id_col: str, label_col: str, usable) -> DataFrame:
    """``(label_id, label)`` of the labels that may be learnt from, one row per id; null ids and labels never are."""
    rows = picked(labels, label_id=id_col, label=label_col).where(F.col("label_id").isNotNull() & F.col("label").isNotNull())
    return rows.where(usable(F.col("label_id"))).groupBy("label_id").agg(F.min("label").alias("label"))


def learn(
    df: DataFrame,
    labels: DataFrame,
    usable,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
) -> tuple[Scorer, DataFrame]:
    """The scorer and the written features ``(id, x)`` of ``df``; ``usable(id)`` says whose label may be learnt from."""
    blocks = durable(feature_blocks(df, id_col, text_col), "quality-features")
    known = durable(trusted(labels, label_id, label_col, usable), "quality-labels")
    shares = known.agg(F.avg("label")).first()[0]
    prior = float(shares) if shares is not None and 0 < shares < 1 else PRIOR
    positives = durable(
        blocks.join(known.where("label = 1").hint("merge"), F.col("id") == F.col("label_id"), "left_semi").select("x"), "quality-positives"
    )
    return fit(blocks, positives, prior), blocks


def learn_and_score(df: DataFrame, labels: DataFrame, usable, **columns: str) -> DataFrame:
    """``(id, score)`` for every row of ``df``, by a classifier learnt on it as in ``learn``."""
    scorer, blocks = learn(df, labels, usable, **columns)

    def kernel(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer.score(_stack(batch.column(1))))], names=["id", "score"]
            )

    return arrow_map(blocks, kernel, [blocks.schema["id"], T.StructField("score", T.DoubleType())])


def accepted(df: DataFrame, labels: DataFrame, usable, text_col: str = "text", threshold: float = 0.5, **columns: str) -> DataFrame:
    """The rows of ``df`` that the classifier scores at ``threshold`` or more, columns as they were.

    Texts are scored where they lie: nothing is joined back.
    """
    scorer, _ = learn(df, labels, usable, text_col=text_col, **columns)
    at = df.columns.index(text_col)
    rows = df.toDF(*[f"_{i}" for i in range(len(df.columns))])

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(at).cast(pa.binary()).to_pylist()
                x = np.stack([features(t or b"") for t in raw]).astype(np.float64)
                yield batch.filter(pa.array(scorer.score(x) >= threshold))

    return arrow_map(rows, kernel, list(rows.schema.fields)).toDF(*df.columns)
