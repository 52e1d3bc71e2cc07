"""Packing documents into token sequences by order-preserving dynamic programming.

Documents stand in id order on one line of tokens per slice. Cuts may fall at document ends
(free), sentence ends (small penalty) and, where a sentence is long or the line ends, between
any two tokens (larger penalty). The cheapest chain of cuts minimises padding plus penalties:
``f(j) = penalty(j) + capacity - j + min(f(i) + i)`` over the cuts i within one capacity before
j, a sliding-window minimum kept in a monotone queue. A stretch whose length is a power of two
needs no padding; such short stretches are offered near the end of a line only.

Edge cases: a null or empty text is one document of just the end token; texts of any length
are cut freely; repeated rows and repeated ids are separate documents; rows without id come
first; an empty table gives no pieces.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.encoding import codec
from flowlake.llm.rows import arrow_map, field, picked, texts
from flowlake.session import shuffle_width

SLICE_CHARS = 4_000_000
_LARGEST_SLICE = 128_000_000
# Tokens planned at once; what follows the last good cut is carried on.
_RUN = 1 << 19
_SEQUENCE_BITS = 40


@dataclass(frozen=True)
class Costs:
    """Penalties in tokens of padding, and how far apart cuts may be offered inside long sentences."""

    capacity: int = 4096
    sentence: float = 4.0
    inside: float = 48.0
    spacing: int = 256


def cheapest_cuts(places: np.ndarray, penalties: np.ndarray, costs: Costs, final: bool) -> list[int]:
    """Places of the best chain of cuts; the line begins at 0 and the last place is its end.

    With ``final`` the chain ends at the line's end. Otherwise it ends at the cheapest place
    within one capacity of the end, and the rest is carried on.
    """
    capacity = costs.capacity
    at, pay = places.tolist(), penalties.tolist()
    best: list[float] = [0.0] * (len(at) + 1)
    back = [0] * (len(at) + 1)
    where = [0, *at]
    tail = where[-1] - 2 * capacity
    index = {0: 0} if tail <= 0 else {}
    queue: deque[tuple[int, float, int]] = deque([(0, 0.0, 0)])
    for n in range(1, len(where)):
        j = where[n]
        while queue[0][0] < j - capacity:
            queue.popleft()
        _, low, source = queue[0]
        cost = low + capacity - j
        if j >= tail:
            length = 1
            while length < capacity:
                i = index.get(j - length)
                if i is not None and best[i] < cost:
                    cost, source = best[i], i
                length *= 2
            index[j] = n
        cost += pay[n - 1]
        best[n] = cost
        back[n] = source
        key = cost + j
        while queue and queue[-1][1] >= key:
            queue.pop()
        queue.append((j, key, n))
    n = len(where) - 1
    if not final:
        # what is left over after a cut is not padding: compare the chains as if the rest were packed full
        near = [m for m in range(n, 0, -1) if where[m] > where[-1] - capacity]
        n = min(near, key=lambda m: best[m] - where[m] / capacity)
    chain = []
    while n:
        chain.append(where[n])
        n = back[n]
    return chain[::-1]


def _offered(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, costs: Costs, final: bool):
    """Places where a cut may fall on a line of ``ids`` whose documents end at ``ends``, and the penalties."""
    stops = np.flatnonzero(sentence_end[ids]) + 1
    # a run of closing signs is one stop
    stops = stops[np.append(np.diff(stops) > 1, True)] if len(stops) else stops
    sure = np.union1d(np.concatenate([stops, ends]), [len(ids)])
    gaps = np.diff(np.concatenate([[0], sure]))
    wide = np.flatnonzero(gaps > costs.spacing)
    inner = [np.arange(sure[w] - gaps[w] + costs.spacing, sure[w], costs.spacing) for w in wide]
    if final:
        powers = 1 << np.arange(int(math.log2(costs.capacity)) + 1)
        inner.append(len(ids) - np.concatenate([powers, (powers[:, None] + powers[None, :]).ravel()]))
    extra = np.concatenate([np.empty(0, np.int64), *inner])
    places = np.union1d(sure, extra[extra > 0])
    penalties = np.full(len(places), costs.inside)
    penalties[np.isin(places, stops)] = costs.sentence
    penalties[np.isin(places, ends)] = 0.0
    return places, penalties


class _Line:
    """Documents of one slice on their way to sequences."""

    def __init__(self, sentence_end: np.ndarray, costs: Costs, slice_number: int):
        self._ends_sentence = sentence_end
        self._costs = costs
        self._sequence = slice_number << _SEQUENCE_BITS
        self._docs: list[list] = []  # [id, tokens of the document, tokens already cut off, waiting tokens]
        self._ids: list[np.ndarray] = []
        self.waiting = 0

    def add(self, key, ids: np.ndarray) -> None:
        self._docs.append([key, len(ids), 0, len(ids)])
        self._ids.append(ids)
        self.waiting += len(ids)

    def flush(self, final: bool):
        """Pieces of every sequence that is settled: (key, start, tokens, offset, sequence, ids)."""
        if not self.waiting:
            return
        line = np.concatenate(self._ids)
        ends = np.cumsum([d[3] for d in self._docs])
        chain = cheapest_cuts(*_offered(line, ends, self._ends_sentence, self._costs, final), self._costs, final)
        begin, doc = 0, 0
        first = 0  # where the current document's waiting tokens begin
        data = line.tobytes()
        for cut in chain:
            at = begin
            while at < cut:
                key, tokens, gone, left = self._docs[doc]
                stop = min(cut, first + left)
                yield key, gone + at - first, tokens, at - begin, self._sequence, data[4 * at : 4 * stop]
                at = stop
                if stop == first + left:
                    doc, first = doc + 1, stop
            self._sequence += 1
            begin = cut
        self._docs = self._docs[doc:]
        if self._docs and begin > first:
            self._docs[0][2] += begin - first
            self._docs[0][3] -= begin - first
        self._ids = [line[begin:]] if begin < len(line) else []
        self.waiting = len(line) - begin


def _slices(rows: DataFrame) -> int:
    """Slices of a few million characters; on large tables as many as the shuffle has partitions, as long as they stay bounded."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    small = math.ceil(chars / SLICE_CHARS)
    return max(1, min(small, max(shuffle_width(rows.sparkSession), 64)), math.ceil(chars / _LARGEST_SLICE))


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    costs: Costs = Costs(),
) -> DataFrame:
    """One row per piece: ``(id, start, length, doc_tokens, sequence_id, offset, ids)``.

    ``ids`` holds little-endian unsigned 32-bit token ids; a document is its text's ids and
    ``end_id``. One range shuffle by id, then every slice is packed in one streaming pass; only
    the tokens of one run wait in memory.
    """
    if costs.capacity & (costs.capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = picked(df, id=id_col, text=text_col)
    end = np.array([end_id], "<u4").tobytes()

    def kernel(batches):
        coder = codec(tokenizer)
        line = _Line(coder.sentence_end, costs, TaskContext.get().partitionId())
        kind = None

        def rows_of(final: bool):
            pieces = list(line.flush(final))
            if pieces:
                keys, start, tokens, offset, sequence, ids = zip(*pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, kind),
                        pa.array(start, pa.int64()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(sequence, pa.int64()),
                        pa.array(offset, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), coder.encode_all(texts(batch, "text"))):
                line.add(key, np.frombuffer(ids + end, "<u4"))
                if line.waiting >= _RUN:
                    yield from rows_of(final=False)
        yield from rows_of(final=True)

    long = T.LongType()
    fields = [field(rows, "id"), *[T.StructField(n, long) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]]
    laid = rows.repartitionByRange(_slices(rows), "id").sortWithinPartitions("id", F.xxhash64("text"))
    return arrow_map(laid, kernel, [*fields, T.StructField("ids", T.BinaryType())])
