"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Over all labelled training rows every n-gram of characters is counted once per document and
class. The FEATURES n-grams whose presence tells the classes apart most surely stay, each scaled by
the log ratio of its smoothed shares in the two classes. A logistic model over the scaled
presences is then fitted on a bounded sample of labelled rows and scores every document.

Edge cases: a null text is empty; an empty text has no n-grams and gets the score of the bias;
very long texts are read whole; several labels of an id count as toxic if any is; repeated rows count each
time; without labels of both kinds every score is the share of toxic ones seen (0 without any);
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, field, picked, texts
from flowlake.sources.durable import durable

SIZES = (4, 5)
FEATURES = 1 << 14
SURE = 5.0  # standard errors between the class shares of a feature, far beyond what chance gives among millions
FEWEST = 100  # the surest stay even where the training rows are too few for that
LEAST = 5  # documents an n-gram must occur in
SAMPLE = 30_000  # labelled rows the linear model is fitted on, by hash order
_STEPS = 250
_RIDGE = 2e-5
_CHUNK = 4_000_000
_STRETCH = 1 << 20  # presences summed at once in fitting
_SIEVE = 20  # bits of the table that turns most n-grams away before the exact lookup

# Letters by code point, lower-cased; everything else is a break.
_LETTER = np.zeros(0x250, np.uint32)
for _n in range(0x250):
    _low = chr(_n).lower()
    if chr(_n).isalpha():
        _LETTER[_n] = ord(_low) if len(_low) == 1 else _n
_BREAK = np.uint64(0x9E3779B97F4A7C15)


def grams(text: bytes, sizes=SIZES) -> np.ndarray:
    """64-bit hashes of the n-grams at every place; runs of other characters count as one break each."""
    points = np.frombuffer(b"".join((b" ", text, b" ")).decode().encode("utf-32-le"), "<u4")
    small = np.minimum(points, 0x24F)
    code = np.where(points < 0x250, _LETTER[small], points)
    code = code[(code != 0) | np.append(True, code[:-1] != 0)].astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ code[k : len(code) - n + 1 + k]) * _BREAK
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _packed(rows: DataFrame) -> DataFrame:
    """``(id, packed, mark)`` of ``rows(id, text)``: texts compressed for the one shuffle that they take."""

    def kernel(batches):
        for batch in batches:
            raw = texts(batch, "text")
            marks = np.fromiter((xxhash.xxh64_intdigest(t) for t in raw), np.uint64, len(raw)).view(np.int64)
            small = [len(t).to_bytes(8, "little") + pa.compress(t, "zstd", asbytes=True) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(small, pa.binary()), pa.array(marks)], names=["id", "packed", "mark"]
            )

    return arrow_map(rows, kernel, [field(rows, "id"), T.StructField("packed", T.BinaryType()), T.StructField("mark", T.LongType())])


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    return [
        pa.decompress(p[8:], decompressed_size=int.from_bytes(p[:8], "little"), codec="zstd", asbytes=True)
        for p in batch.column(0).to_pylist()
    ]


def presence_counts(labelled: DataFrame) -> DataFrame:
    """``(gram, toxic, clean)``: documents of each class that have the n-gram, over ``labelled(packed, label)``."""

    def partial(parts: list[np.ndarray], labels: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(parts)
        weight = np.repeat(np.array(labels, np.int64), [len(p) for p in parts])
        order = np.argsort(flat, kind="stable")
        flat, weight = flat[order], weight[order]
        begins = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        toxic = np.add.reduceat(weight, begins)
        every = np.diff(np.append(begins, len(flat)))
        return pa.RecordBatch.from_arrays(
            [pa.array(flat[begins].view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["gram", "toxic", "clean"]
        )

    def kernel(batches):
        parts, labels, size = [], [], 0
        for batch in batches:
            for text, label in zip(_unpacked(batch), batch.column(1).to_pylist()):
                parts.append(np.unique(grams(text)))
                labels.append(int(label))
                size += len(parts[-1])
                if size >= _CHUNK:
                    yield partial(parts, labels)
                    parts, labels, size = [], [], 0
        if size:
            yield partial(parts, labels)

    fields = [T.StructField(n, T.LongType()) for n in ("gram", "toxic", "clean")]
    sums = arrow_map(labelled, kernel, fields).repartition("gram").groupBy("gram")
    return sums.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts: DataFrame, toxic: int, clean: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and log-count ratios of the n-grams that tell the classes apart most surely.

    Sureness is the difference of the two shares over its standard error.
    """
    t, c = F.col("toxic") + 1.0, F.col("clean") + 1.0
    p, q = t / (toxic + 2.0), c / (clean + 2.0)
    pooled = (t + c) / (toxic + clean + 4.0)
    sure = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / (toxic + 2.0) + 1 / (clean + 2.0)))
    rows = counts.where(F.col("toxic") + F.col("clean") >= LEAST).select("gram", F.log(p / q).alias("ratio"), sure.alias("sure"))
    top = rows.orderBy(F.col("sure").desc(), "gram").limit(features).toArrow()
    hashes = top.column(0).to_numpy().astype(np.int64).view(np.uint64)
    keep = max(FEWEST, int((top.column(2).to_numpy() >= SURE).sum()))
    order = np.argsort(hashes[:keep])
    return hashes[order], top.column(1).to_numpy()[order].astype(np.float64)


@dataclass
class Scorer:
    """At most FEATURES hashes, ratios and weights, and a sieve: bounded, so safe to broadcast."""

    hashes: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    sieve: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, ratios: np.ndarray) -> Scorer:
        sieve = np.zeros(1 << _SIEVE, bool)
        sieve[(hashes >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
        return cls(hashes, ratios, np.zeros(len(hashes)), 0.0, sieve)

    def present(self, text: bytes) -> np.ndarray:
        """Numbers of the features that the text has."""
        found = grams(text)
        found = found[self.sieve[(found >> np.uint64(64 - _SIEVE)).astype(np.int64)]]
        at = np.searchsorted(self.hashes, found)
        at[at == len(self.hashes)] = 0
        return np.unique(at[self.hashes[at] == found]) if len(self.hashes) else at

    def score(self, text: bytes) -> float:
        at = self.present(text)
        return float(1 / (1 + np.exp(-np.clip((self.weights * self.ratios)[at].sum() + self.bias, -40, 40))))


def _stretch_sums(values: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of ``values[places]`` over consecutive stretches of the given sizes, some millions of places at a time."""
    out = np.zeros(len(sizes))
    filled = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[filled])
    at, done = 0, 0
    while at < len(filled):
        until = max(at + 1, int(np.searchsorted(ends, done + _STRETCH, side="right")))
        begins = np.append(done, ends[at : until - 1]) - done
        out[filled[at:until]] = np.add.reduceat(values[places[done : ends[until - 1]]], begins)
        at, done = until, ends[until - 1]
    return out


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = _STEPS) -> tuple[np.ndarray, float]:
    """Logistic weights over scaled presences by Adam steps over all rows; ``rows`` lists each text's features."""
    sizes = np.array([len(r) for r in rows], np.int64)
    column = np.concatenate(rows).astype(np.uint32) if len(rows) else np.empty(0, np.uint32)
    n, d = len(rows), len(ratios)
    # the same presences by row and by column: both sums of a step are gathers and sums of stretches
    owner = np.repeat(np.arange(n, dtype=np.uint32), sizes)[np.argsort(column, kind="stable")]
    uses = np.bincount(column, minlength=d)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    w, bias = np.zeros(d), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for step in range(1, steps + 1):
        margin = _stretch_sums(ratios * w, column, sizes) + bias
        residual = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels
        gradient = ratios * _stretch_sums(residual, owner, uses) / n + _RIDGE * w
        slope = residual.mean()
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * slope, 0.999 * vb + 0.001 * slope**2
        rate = 0.03 * (1 - step / (steps + 1))
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def _fit_on_sample(labelled: DataFrame, scorer: Scorer, sample: int) -> Scorer:
    """Fit in one task on the features of at most ``sample`` rows, the first by hash of id and text."""
    shared = labelled.sparkSession.sparkContext.broadcast(scorer)

    def present(batches):
        for batch in batches:
            found = [shared.value.present(t).astype("<u4").tobytes() for t in _unpacked(batch)]
            fit = pa.array(np.zeros(len(found), np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(found, pa.binary()), fit], names=["label", "mark", "has", "fit"]
            )

    # a hash threshold with head-room, features in parallel, then the exact bound on small rows
    total = labelled.count()
    if total > sample:
        labelled = labelled.where(F.col("mark") < int(-(2**63) + 1.1 * sample / total * 2**64) if 1.1 * sample < total else F.lit(True))
    fields = [labelled.schema["label"], labelled.schema["mark"], T.StructField("has", T.BinaryType()), T.StructField("fit", T.LongType())]
    rows = arrow_map(labelled.select("packed", "label", "mark"), present, fields).orderBy("mark", "has").limit(sample)

    def learn(table: pa.Table) -> pa.Table:
        has = [np.frombuffer(h, "<u4") for h in table.column("has").to_pylist()]
        w, bias = fit_weights(has, np.array(table.column("label").to_pylist(), np.float64), shared.value.ratios)
        return pa.table({"weights": [w.tobytes()], "bias": [bias]})

    done = rows.groupBy("fit").applyInArrow(learn, "weights binary, bias double").first()
    scorer.weights = np.frombuffer(done["weights"], np.float64)
    scorer.bias = done["bias"]
    return scorer


def train(labelled: DataFrame, features: int = FEATURES, sample: int = SAMPLE) -> Scorer:
    """Scorer from ``labelled(packed, label, mark)``; counts cover all rows, the weights a bounded sample."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        empty = Scorer.of(np.empty(0, np.uint64), np.empty(0))
        empty.bias = 40.0 if toxic else -40.0
        return empty
    scorer = Scorer.of(*choose(presence_counts(labelled.select("packed", "label")), toxic, clean, features))
    return _fit_on_sample(labelled, scorer, sample)


def learn_and_score(
    df: DataFrame,
    labels: DataFrame,
    usable,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
) -> DataFrame:
    """``(id, score)`` for every row of ``df``; ``usable(id)`` says whose label may be learnt from."""
    rows = picked(df, id=id_col, text=text_col)
    known = picked(labels, label_id=label_id, label=label_col).where(F.col("label_id").isNotNull() & F.col("label").isNotNull())
    known = durable(known.where(usable(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label")), "toxic-labels")
    # a sort-merge join at every size: labels are as many as the corpus has
    labelled = _packed(rows.where(usable(F.col("id")))).join(known.hint("merge"), F.col("id") == F.col("label_id"))
    mark = F.xxhash64("id", "mark").alias("mark")
    labelled = labelled.select("packed", (F.col("label") > 0).cast("int").alias("label"), mark)
    labelled = durable(labelled, "toxic-training")
    shared = df.sparkSession.sparkContext.broadcast(train(labelled))

    def kernel(batches):
        for batch in batches:
            scores = [shared.value.score(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return arrow_map(rows, kernel, [field(rows, "id"), T.StructField("score", T.DoubleType())])
