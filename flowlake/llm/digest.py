"""Improbable-feature digests of documents, and how alike two digests are.

Every 64-byte window of a text has a byte entropy. How often each entropy level occurs in the
whole corpus is counted first; the rarer a level, the better its rank. In every run of 64
neighbouring windows the best-ranked one (the leftmost of equals) gets a point, and windows
with enough points are the text's features. Features are put into a chain of Bloom filters,
a new one when the last is full; two digests are compared filter by filter through the share of
common bits beyond what chance makes common.

Edge cases: a null text is empty; an empty text has the digest ``""``, alike only to itself; a
text shorter than one window is one feature; a text with no window popular enough uses its
best-ranked one, so every non-empty text has a feature; repeated features count once; repeated
rows, equal texts and ties of id (ordered by text hash) are handled row by row; an empty table
gives no rows. Very long texts are read whole, in stretches.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, field, mixed, picked, texts
from flowlake.session import shuffle_width

WINDOW = 64
LEVELS = 1024
POPULAR = 16
FILTER_BITS = 2048
PROBES = 5
FULL = 160  # features to a filter
CHANCE = 0.05  # overlap below chance + this share of what is above it counts as none
_STRETCH = 1 << 20

_C = np.arange(WINDOW + 1, dtype=np.float64)
# c log2 c in fixed point, and its steps: sliding sums stay exact
_TERM = np.rint(_C * np.log2(np.maximum(_C, 1)) * (1 << 16)).astype(np.int64)
_STEP = np.append(0, np.diff(_TERM)).astype(np.int32)
_MOST = int(_TERM[WINDOW])


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS - 1) of every window of ``data``; none if it is shorter than a window."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int32)
    back = np.ones(n, np.uint8)  # how often the byte occurs in the window that ends here
    ahead = np.ones(n, np.uint8)  # and in the window that begins here
    same = np.empty(n, np.bool_)
    for d in range(1, WINDOW):
        hit = np.equal(data[d:], data[:-d], out=same[: n - d]).view(np.uint8)
        back[d:] += hit
        ahead[:-d] += hit
    first = int(_TERM[np.bincount(data[:WINDOW], minlength=256)].sum())
    # sliding by one place takes the first byte out, then lets the next one in
    change = _STEP[back[WINDOW:]] - _STEP[ahead[: n - WINDOW]]
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = first
    np.cumsum(change, out=sums[1:], dtype=np.int64)
    sums[1:] += first
    return ((_MOST - sums) * (LEVELS - 1) // _MOST).astype(np.int32)


def stretches(data: np.ndarray):
    """(start, levels) over a long array, stretch by stretch."""
    for at in range(0, max(1, len(data) - WINDOW + 1), _STRETCH):
        yield at, entropy_levels(data[at : at + _STRETCH + WINDOW - 1])


def _batch_levels(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts of a group as one array: (bytes, text starts, level of the window at each byte)."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    levels = np.concatenate([x for _, x in stretches(data)]) if len(data) else np.empty(0, np.int32)
    return data, starts, levels


def _own_windows(starts: np.ndarray, count: int) -> np.ndarray:
    """Whether the window at each place lies in one text."""
    fits = np.ones(count, bool)
    for end in starts[1:-1]:
        fits[max(0, end - WINDOW + 1) : end] = False
    return fits


def _groups(raw: list[bytes]):
    group, size = [], 0
    for text in raw:
        group.append(text)
        size += len(text)
        if size >= _STRETCH:
            yield group
            group, size = [], 0
    if group:
        yield group


def level_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each entropy level occurs over all windows of all texts: LEVELS numbers reach the driver."""

    def kernel(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for group in _groups(texts(batch, "text")):
                _, starts, levels = _batch_levels(group)
                total += np.bincount(levels[_own_windows(starts, len(levels))], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "windows"])

    fields = [T.StructField("level", T.LongType()), T.StructField("windows", T.LongType())]
    counted = arrow_map(picked(df, text=text_col), kernel, fields).groupBy("level").agg(F.sum("windows").alias("windows"))
    out = np.zeros(LEVELS, np.int64)
    for row in counted.collect():
        out[row["level"]] = row["windows"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, 0 the rarest; equally rare levels by higher entropy first."""
    order = np.lexsort((-np.arange(LEVELS), counts))
    out = np.empty(LEVELS, np.int32)
    out[order] = np.arange(LEVELS)
    return out


def _best_of_run(keys: np.ndarray) -> np.ndarray:
    """Smallest key of every WINDOW neighbouring ones."""
    width = 1
    while width < WINDOW:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return keys


def _feature_places(size: int, levels: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of one text's features, in order."""
    count = max(0, size - WINDOW + 1)
    if not count:
        return np.zeros(1 if size else 0, np.int64)
    shift, kind = (20, np.int32) if count < 1 << 20 else (40, np.int64)
    keys = (rank[levels[:count]].astype(kind) << shift) | np.arange(count, dtype=kind)
    if count < WINDOW:
        return np.array([keys.min() & ((1 << shift) - 1)])
    # the best place never moves back, so equal winners stand together
    winners = _best_of_run(keys) & ((1 << shift) - 1)
    begins = np.append(0, np.flatnonzero(np.diff(winners)) + 1)
    at, points = winners[begins], np.diff(np.append(begins, len(winners)))
    popular = at[points >= POPULAR]
    return popular if len(popular) else at[np.argmax(points)][None]


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hash of the window at each place; a short text counts as padded with zeros."""
    if len(data) < WINDOW:
        data = np.pad(data, (0, WINDOW - len(data)))
    rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]
    blocks = np.ascontiguousarray(rows).view("<u8").astype(np.uint64)
    out = np.full(len(places), len(data) if len(data) == WINDOW else WINDOW, np.uint64)
    for k in range(blocks.shape[1]):
        out = mixed(out ^ blocks[:, k])
    return out


def _chain(hashes: np.ndarray) -> bytes:
    """Bloom filters over the distinct features in order of first occurrence, FULL to a filter."""
    _, first = np.unique(hashes, return_index=True)
    distinct = hashes[np.sort(first)]
    number = np.arange(len(distinct)) // FULL
    bits = np.zeros((int(number[-1]) + 1, FILTER_BITS), np.uint8)
    for k in range(PROBES):
        bits[number, ((distinct >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).tobytes()


def digests(raw: list[bytes], rank: np.ndarray) -> list[bytes]:
    out = []
    for group in _groups(raw):
        data, starts, levels = _batch_levels(group)
        for text, start in zip(group, starts[:-1]):
            own = data[start : start + len(text)]
            places = _feature_places(len(text), levels[start:], rank)
            out.append(_chain(_hashes(own, places)) if len(text) else b"")
    return out


def likeness(one: bytes, other: bytes) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, averaged by bits.

    Common bits count from a cut-off above the number that two filters of this fill share by
    chance; all bits of the emptier filter common is 1.
    """
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    width = FILTER_BITS // 8
    a, b = (np.frombuffer(x, np.uint8).reshape(-1, width) for x in (one, other))
    if len(a) > len(b):
        a, b = b, a
    fill_a, fill_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    best = np.empty(len(a))
    for i in range(len(a)):
        common = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(fill_a[i], fill_b)
        chance = np.minimum(fill_a[i] * fill_b / FILTER_BITS, most)
        floor = chance + CHANCE * (most - chance)
        best[i] = np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0.0, 1.0).max()
    return float((best * fill_a).sum() / fill_a.sum())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """``(id, fingerprint)`` for every row; ``rank`` defaults to the corpus's own ranks."""
    order = ranks(level_counts(df, text_col)) if rank is None else rank

    def kernel(batches):
        for batch in batches:
            found = [base64.b64encode(d).decode() for d in digests(texts(batch, "text"), order)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    rows = picked(df, id=id_col, text=text_col)
    return arrow_map(rows, kernel, [field(rows, "id"), T.StructField("fingerprint", T.StringType())])


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many leading code points of ``following`` (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows spread over buckets of neighbouring ids, highest first; each bucket's first row also closes the one before.

    Bucket bounds come from the ids alone. Of a bucket's rows the first is found by one small
    aggregate, and goes to the neighbour too, so no bucket has to see another.
    """
    spark = rows.sparkSession
    slices = shuffle_width(spark)
    shares = [i / slices for i in range(1, slices)]
    cuts = rows.stat.approxQuantile("id", shares, 1 / (4 * slices)) if shares else []
    bounds = sorted({int(c) for c in cuts}, reverse=True)
    listed = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(listed, lambda b: F.col("id") < b))
    marked = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(len(bounds))).otherwise(bucket)).withColumn(
        "mark", F.xxhash64("text")
    )
    place = F.struct(F.coalesce(-F.col("id"), F.lit((1 << 63) - 1)).alias("turn"), F.col("mark"))
    marked = marked.withColumn("place", place)
    heads = {r["bucket"]: r["head"] for r in marked.groupBy("bucket").agg(F.min("place").alias("head")).collect()}
    used = sorted(heads)

    def by_bucket(values: dict, kind: str) -> Column:
        return F.get(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(len(bounds) + 1)]), F.col("bucket"))

    is_head = (F.col("place.turn") == by_bucket({b: h["turn"] for b, h in heads.items()}, "bigint")) & (
        F.col("place.mark") == by_bucket({b: h["mark"] for b, h in heads.items()}, "bigint")
    )
    # the first bucket's head closes the last one
    guest = F.when(is_head, by_bucket({b: used[at - 1] for at, b in enumerate(used)}, "int"))
    copies = marked.withColumn("guest", guest)
    homes = F.array(F.struct("bucket", F.lit(False).alias("closing")), F.struct(F.col("guest").alias("bucket"), F.lit(True).alias("closing")))
    spread = copies.select("id", "text", "place", F.explode(F.filter(homes, lambda h: h["bucket"].isNotNull())).alias("home"))
    spread = spread.select("home.bucket", "home.closing", "place", "id", "text")
    return spread.repartition(slices, "bucket").sortWithinPartitions("bucket", "closing", "place")


def neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's digest beside those of its edited text and of the next row in descending id order.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``;
    after the last row comes the first. Rows without id come last. Texts move once, to buckets of
    neighbouring ids.
    """
    rows = picked(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    order = ranks(level_counts(df, text_col))
    numbers, strings = T.LongType(), T.StringType()

    def pairs(batches):
        """(row, following text) in order; the closing copy of a bucket only follows."""
        last = None
        for batch in batches:
            buckets, closing, ids, raw = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for bucket, guest, key, text in zip(buckets, closing, ids, raw):
                if last is not None and last[0] == bucket:
                    yield (*last[1:], text)
                    last = None
                if not guest:
                    last = (bucket, key, text)

    def kernel(batches):
        kind = None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(3).type
                yield batch

        group, size = [], 0

        def done():
            ids = [g[0] for g in group]
            whole = [g[1] for g in group]
            changed = [edited(g[1], g[2]) for g in group]
            # a row's next digest is mostly the next row's own
            tail = group[-1][2]
            own = digests([t.encode() for t in [*whole, tail]], order)
            after = [own[i + 1] if i + 1 == len(group) or group[i][2] is group[i + 1][1] else digests([group[i][2].encode()], order)[0] for i in range(len(group))]
            new = digests([t.encode() for t in changed], order)
            text = lambda d: base64.b64encode(d).decode()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, kind),
                    pa.array([len(t) for t in whole], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([text(d) for d in own[:-1]]),
                    pa.array([text(d) for d in new]),
                    pa.array([likeness(a, b) for a, b in zip(own, new)]),
                    pa.array([likeness(a, b) for a, b in zip(own, after)]),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for row in pairs(typed()):
            group.append(row)
            size += len(row[1])
            if size > 2 * _STRETCH:
                yield done()
                group, size = [], 0
        if group:
            yield done()

    fields = [field(rows, "id"), T.StructField("n_chars", numbers), *[T.StructField(n, strings) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]]
    fields += [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
    return arrow_map(_in_order(rows), kernel, fields)


def alike(one: Column, other: Column) -> Column:
    """Likeness of two fingerprint columns."""

    @F.pandas_udf(T.DoubleType())
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        read = base64.b64decode
        return pd.Series([likeness(read(x or ""), read(y or "")) for x, y in zip(a, b)], dtype="float64")

    return compare(one, other)
