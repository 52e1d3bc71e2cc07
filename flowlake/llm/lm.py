"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs are counted over the training rows. A pair's count c is held as its level
``1 + floor(log_b c)``: the filter contains the pair with every level up to its own, so a lookup
probes level after level until one is missing. The filter holds every pair of at least ``LEAST``
occurrences and grows with the corpus. Its upper levels, as many as fit ``FILTER_BYTES``, are
broadcast; the levels below lie in a written table of parts of ``PART_BLOCKS`` blocks each, or more
where there are many, and the probes that the broadcast part cannot answer are shuffled to them.
Frequent pairs are thus settled where the text is read, and no part is hot. What is shuffled for each token, pairs to count
and probes, goes as compressed byte planes.

    p(w | h) = max(c(hw) - D, 0) / c(h) + (1 - k) p0(w),   p0(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

k is the share of probability that pairs hold after contexts of h's level, summed over all
training tokens from the tables of counts. p0, the level of a context and the base score use exact
counts of words: those of frequent words are broadcast (a bounded table), all others joined.

Edge cases: a null or empty text is one end token; a null id counts as the empty text in the
fold; repeated rows count and are scored each; very long texts are handled in stretches; with
no training rows all counts are 0 and every token has probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowlake.llm.rows import arrow_map, mixed, picked, texts, words
from flowlake.llm.rows import field as rows_field
from flowlake.session import shuffle_width
from flowlake.sources.durable import durable, shuffles_freed

BASE = 1.5  # of the logarithm that makes levels
LEAST = 2  # occurrences of a pair worth keeping
DISCOUNT = 0.6
FILTER_BYTES = 1 << 25  # bound of the broadcast levels of the filter
PART_BLOCKS = 16  # least and most blocks of a part of the written levels: 2 and 32 MB, what a probing task holds
PART_BLOCKS_MOST = 256
ROUNDS = 2  # documents with probes to shuffle are read in so many rounds, so that disk holds the probes of one
FREQUENT = 1 << 20  # bound of the broadcast table of exact counts, in words; this at most
_BITS_PER_KEY = 16
_BLOCK_WORDS = 1 << 14
_GROUP = 400_000  # tokens handled at once
_CHUNK = 4_000_000  # tokens counted before partial counts leave the task
_PART_TOKENS = 1 << 20  # tokens of the training rows for each part in which pairs are added up
_MAX_LEVEL = 80
_ROW_ITEMS = 4096  # pairs or probes a row, so that a batch of rows stays small
_ROWS_AT_ONCE = 50  # rows of probes answered together

END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_PAIR = np.uint64(0xA24BAED4963EE407)
_LEVEL = np.uint64(0x9FB21C651E98DF25)
_INSIDE = np.uint64((1 << 32) - 1)  # what tells n-grams of a block apart


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_b c), exact at the powers."""
    return np.searchsorted(_FLOORS, counts, side="right")


_FLOORS = np.array([math.ceil(BASE**q - 1e-9) for q in range(_MAX_LEVEL)], dtype=np.float64)
# the count that stands for a level: the middle of those it holds
_STANDS = np.append(0.0, (_FLOORS + np.maximum(_FLOORS, np.append(_FLOORS[1:], _FLOORS[-1] * BASE) - 1)) / 2)


def token_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words and the end token."""
    found = words(text)
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out[-1] = END
    return out


def _contexts(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each one; START at the head of every document."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[0] = START
    before[ends[:-1]] = START
    return before


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(before * _PAIR + (tokens ^ (tokens >> np.uint64(31))))


def _grouped(batch: pa.RecordBatch):
    """(rows, tokens of all rows, end of each row) for a few hundred thousand tokens at a time."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts(batch, "text")):
        rows.append(row)
        parts.append(token_hashes(text))
        size += len(parts[-1])
        if size >= _GROUP:
            yield rows, np.concatenate(parts), np.cumsum([len(p) for p in parts])
            rows, parts, size = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of equal numbers, cut at _ROW_ITEMS."""
    return _cut(np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])), len(numbers))


def _cut(begin: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of stretches, none empty, that begin where the next ends, cut at _ROW_ITEMS."""
    rows = -(-np.diff(np.append(begin, end)) // _ROW_ITEMS)
    turn = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = np.repeat(begin, rows) + turn * _ROW_ITEMS
    return begin, np.append(begin[1:], end)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of one length as byte planes (first bytes of all numbers, second bytes, ...), compressed where that helps.

    Upper bytes are mostly alike; planes of random bytes stay as they are.
    """
    planes = [plane.tobytes() for c in columns for plane in c.view(np.uint8).reshape(len(c), -1).T]
    packed = [pa.compress(plane, codec="zstd", asbytes=True) for plane in planes]
    kept = [small if len(small) < len(plane) else plane for small, plane in zip(packed, planes)]
    return np.array([len(columns[0]), *map(len, kept)], np.uint32).tobytes() + b"".join(kept)


def _restored(data: bytes, *kinds: type | np.dtype) -> list[np.ndarray]:
    """The columns that ``_squeezed`` packed, of the types given."""
    types = [np.dtype(kind) for kind in kinds]
    rows, *sizes = np.frombuffer(data, np.uint32, 1 + sum(t.itemsize for t in types)).tolist()
    at, columns, sizes = 4 * (1 + len(sizes)), [], iter(sizes)
    for kind in types:
        out = np.empty((rows, kind.itemsize), np.uint8)
        for i in range(kind.itemsize):
            size = next(sizes)
            plane = data[at : at + size]
            out[:, i] = np.frombuffer(pa.decompress(plane, rows, codec="zstd") if size < rows else plane, np.uint8)
            at += size
        columns.append(out.view(kind).ravel())
    return columns


def word_counts(train: DataFrame) -> DataFrame:
    """The written ``(gram, n)`` of all words of ``train(text)`` and the end token."""

    def partial(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    def kernel(batches):
        held, size = [], 0
        for batch in batches:
            for _, tokens, _ in _grouped(batch):
                held.append(tokens)
                size += len(tokens)
                if size >= _CHUNK:
                    yield partial(held)
                    held, size = [], 0
        if size:
            yield partial(held)

    parts = arrow_map(train, kernel, [T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    return durable(parts.repartition("gram").groupBy("gram").agg(F.sum("n").alias("n")), "words")


def pair_counts(train: DataFrame, model: Model) -> DataFrame:
    """The written ``(gram, n, at, context)`` of pairs with at least LEAST occurrences.

    ``at`` is the level of a context in the broadcast table; of others the hash stands in ``context``.
    Most pairs occur once, so tasks send their counts packed: sorted runs of pairs, for each of many
    parts of the hashes. A task adds up one part after the other, and only pairs that are kept become rows.
    """
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(model)
    parts = max(1, -(-model.tokens // _PART_TOKENS))

    # the least n-gram of each part of LogFrequencyFilter.block_of
    least = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)

    def partial(held: list[tuple]) -> pa.RecordBatch:
        grams, at, far = (np.concatenate(c) for c in zip(*held))
        held.clear()
        places = np.flatnonzero(at < 0)
        grams, first, n = np.unique(grams, return_index=True, return_counts=True)
        n, at = n.astype(np.uint32), at[first]
        far = far[np.searchsorted(places, first[at < 0])]
        edges = np.searchsorted(grams, least)
        part = np.flatnonzero(np.diff(np.append(edges, len(grams))))
        begin, end = _cut(edges[part], len(grams))
        steps = np.diff(grams, prepend=np.uint64(0))
        steps[begin] = grams[begin]
        columns = [
            pa.array((np.searchsorted(edges, begin, side="right") - 1).astype(np.int32)),
            pa.array([_squeezed(steps[lo:hi], n[lo:hi], at[lo:hi]) for lo, hi in zip(begin, end)]),
            pa.array([c.tobytes() for c in np.split(far, np.cumsum(np.add.reduceat(at < 0, begin, dtype=np.int64))[:-1])]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in sent])

    def total(held: list[tuple]) -> pa.RecordBatch:
        grams, n, at, context = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        n = np.add.reduceat(n[order], first, dtype=np.int64)
        kept = n >= LEAST
        near = ~np.logical_or.reduceat(at[order] < 0, first)[kept]
        at = np.maximum.reduceat(at[order], first)[kept].astype(np.int32)
        context = np.maximum.reduceat(context[order], first)[kept]
        columns = [pa.array(grams[first][kept].view(np.int64)), pa.array(n[kept])]
        columns += [pa.array(at, mask=at < 0), pa.array(context, mask=near)]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in counted])

    def kernel(batches):
        held, size = [], 0
        for batch in batches:
            for _, tokens, ends in _grouped(batch):
                found = shared.value.lookups(tokens, ends)
                held.append((found.grams, found.at.astype(np.int8), found.before[found.at < 0]))
                size += len(tokens)
                if size >= _CHUNK:
                    yield partial(held)
                    held, size = [], 0
        if size:
            yield partial(held)

    def adding(batches):
        part, held = -1, []
        for batch in batches:
            for owner, data, contexts in zip(*(c.to_pylist() for c in batch.columns)):
                if owner != part and held:
                    yield total(held)
                    held = []
                part = owner
                steps, n, at = _restored(data, np.uint64, np.uint32, np.int8)
                context = np.full(len(at), np.iinfo(np.int64).min)
                context[at < 0] = np.frombuffer(contexts, np.int64)
                held.append((np.cumsum(steps), n, at, context))
        if held:
            yield total(held)

    sent = [T.StructField("part", T.IntegerType()), T.StructField("pairs", T.BinaryType()), T.StructField("contexts", T.BinaryType())]
    counted = [T.StructField(c, T.LongType()) for c in ("gram", "n", "context")]
    counted.insert(2, T.StructField("at", T.IntegerType()))
    tasks = min(parts, max(shuffle_width(spark), 64))
    dealt = arrow_map(train, kernel, sent).repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")
    written = durable(arrow_map(dealt, adding, counted), "pairs")
    shared.destroy()
    return written


def _level(n: Column) -> Column:
    floors = F.array(*[F.lit(float(f)) for f in _FLOORS])
    return F.size(F.filter(floors, lambda f: f <= n))


class LogFrequencyFilter:
    """Bit words in blocks: a block by the n-gram, a word and three bits in it by n-gram and level."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.blocks = len(bits) // _BLOCK_WORDS

    @staticmethod
    def block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
        return (((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def probe(grams: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
        """(word inside the block, bit mask) of n-grams at a level."""
        with np.errstate(over="ignore"):
            h = mixed((grams & _INSIDE) ^ (np.asarray(level, np.uint64) * _LEVEL))
        one = np.uint64(1)
        six = np.uint64(63)
        mask = (one << (h & six)) | (one << ((h >> np.uint64(6)) & six)) | (one << ((h >> np.uint64(12)) & six))
        return (h >> np.uint64(18)) % np.uint64(_BLOCK_WORDS), mask

    def levels(self, grams: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
        """The highest level reached by probing 1, 2, ... until one is missing, in the n-grams' own blocks or those given."""
        out = np.zeros(len(grams), np.int64)
        if not self.blocks:
            return out
        alive = np.arange(len(grams))
        base = (self.block_of(grams, self.blocks) if block is None else block) * _BLOCK_WORDS
        for level in range(1, _MAX_LEVEL):
            word, mask = self.probe(grams[alive], level)
            held = (self.bits[base[alive] + word.astype(np.int64)] & mask) == mask
            alive = alive[held]
            if not len(alive):
                break
            out[alive] = level
        return out


def _blocks_for(keys: int) -> int:
    return -(-keys * _BITS_PER_KEY // (64 * _BLOCK_WORDS))


def _filled(grams: DataFrame, which: Column, blocks: int) -> DataFrame:
    """``(block, bits)`` of the n-grams of ``grams(gram, n)`` whose ``level`` meets ``which``; a task holds one block at a time."""
    place = F.call_function(
        "div", F.shiftrightunsigned("gram", 32) * F.lit(blocks).cast("bigint"), F.lit(1 << 32).cast("bigint")
    )

    def done(number: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bits.tobytes()])], names=["block", "bits"])

    def kernel(batches):
        number, bits = -1, np.zeros(0, np.uint64)
        for batch in batches:
            gram, level, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            times = level.astype(np.int64)
            each = np.repeat(gram.view(np.uint64), times)
            step = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + 1
            word, mask = LogFrequencyFilter.probe(each, step)
            cuts = np.append(np.flatnonzero(np.diff(block)) + 1, len(block))
            until = np.cumsum(times)
            lo = 0
            for cut in cuts[cuts > 0]:
                if block[cut - 1] != number:
                    if number >= 0:
                        yield done(number, bits)
                    number, bits = int(block[cut - 1]), np.zeros(_BLOCK_WORDS, np.uint64)
                hi = until[cut - 1]
                np.bitwise_or.at(bits, word[lo:hi].astype(np.int64), mask[lo:hi])
                lo = hi
        if number >= 0:
            yield done(number, bits)

    rows = grams.select("gram", _level(F.col("n")).alias("level"), place.alias("block")).where(which)
    fields = [T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType())]
    return arrow_map(rows.repartition("block").sortWithinPartitions("block"), kernel, fields)


def build_filter(grams: DataFrame, levels: list[tuple[int, int]], filter_bytes: int) -> tuple[LogFrequencyFilter, int]:
    """The upper levels of the filter of ``grams(gram, n)`` and the lowest in them; ``levels`` lists (level, n-grams).

    Blocks are filled by tasks and reach the driver finished: at most ``filter_bytes`` in all.
    """
    room = filter_bytes * 8 // _BITS_PER_KEY
    lowest = 1
    while sum(q * n for q, n in levels if q >= lowest) > room:
        lowest += 1
    keys = sum(q * n for q, n in levels if q >= lowest)
    blocks = min(filter_bytes // (8 * _BLOCK_WORDS), _blocks_for(keys))
    if not blocks:
        return LogFrequencyFilter(np.empty(0, np.uint64)), lowest
    done = _filled(grams, F.col("level") >= lowest, blocks).toArrow()
    bits = np.zeros((blocks, _BLOCK_WORDS), np.uint64)
    for number, data in zip(done.column(0).to_pylist(), done.column(1).to_pylist()):
        bits[number] = np.frombuffer(data, np.uint64)
    return LogFrequencyFilter(bits.ravel()), lowest


@dataclass
class Model:
    """What scoring tasks need: bounded, whatever the corpus."""

    tokens: int  # N
    distinct: int  # V
    documents: int
    frequent: np.ndarray  # hashes of frequent words, sorted
    rank: np.ndarray  # of their counts among ``counts``
    counts: np.ndarray  # different counts of frequent words, rising
    bits: np.ndarray  # the broadcast levels of the filter, from ``lowest`` up
    lowest: int = 1
    blocks: int = 0  # of the written levels below
    part_blocks: int = PART_BLOCKS  # of them in a part
    held: np.ndarray = field(default_factory=lambda: np.zeros(_MAX_LEVEL + 1))  # k by level of the context
    pairs: int = 0  # pairs with at least LEAST occurrences, and those of them in the broadcast levels
    pairs_held: int = 0

    def parts(self) -> int:
        return -(-self.blocks // self.part_blocks)

    def uniform(self) -> float:
        return max(self.tokens + 0.5 * (self.distinct + 1), 0.5)

    def lookups(self, tokens: np.ndarray, ends: np.ndarray) -> Lookup:
        distinct, where = np.unique(tokens, return_inverse=True)
        place = np.full(len(distinct), -1, np.int32)
        levels = np.full(len(distinct), -1, np.int32)
        if len(self.frequent):
            near = np.minimum(np.searchsorted(self.frequent, distinct), len(self.frequent) - 1)
            known = self.frequent[near] == distinct
            place[known] = near[known]
            levels[known] = level_of(self.counts[self.rank[near[known]]])
        before = _contexts(tokens, ends)
        at = np.empty(len(tokens), np.int32)
        at[1:] = levels[where[:-1]]
        at[before == START] = level_of(np.array([self.documents]))[0]
        place[place >= 0] = self.rank[place[place >= 0]]
        return Lookup(place[where], at, before, pair_hashes(before, tokens))

    def upper(self, grams: np.ndarray) -> np.ndarray:
        """Levels of pairs in the broadcast levels; 0 for those that are not."""
        levels = LogFrequencyFilter(self.bits).levels(grams)
        return np.where(levels >= self.lowest, levels, 0)

    def low(self, place: np.ndarray) -> np.ndarray:
        """p0 of words in the broadcast table."""
        return (self.counts[place] + 0.5) / self.uniform()

    def full(self, place: np.ndarray, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of the probability of tokens whose word and context are in the broadcast table."""
        context = _STANDS[at]
        own = _pair_weight(context, _STANDS[pair]) / np.maximum(context, 1)
        return np.log10(np.minimum(own + (1 - self.held[at]) * self.low(place), 1.0))


@dataclass
class Lookup:
    """Tokens as the broadcast tables know them: places and levels are -1 outside."""

    place: np.ndarray  # of the word's count among those of frequent words
    at: np.ndarray  # level of the context
    before: np.ndarray
    grams: np.ndarray

    def words(self, tokens: np.ndarray) -> np.ndarray:
        """Join keys of words, 0 for those that need no join."""
        return np.where(self.place < 0, tokens, np.uint64(0)).view(np.int64)

    def contexts(self) -> np.ndarray:
        return np.where(self.at < 0, self.before, np.uint64(0)).view(np.int64)


@dataclass
class Tables:
    """What scoring joins: written tables that grow with the corpus."""

    words: DataFrame  # (gram, n)
    filter: DataFrame | None  # (block, bits) of the levels below the broadcast ones


def _pair_weight(context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Discounted count of each pair, zero if it is too rare to have been kept; never above its context's."""
    return np.where(pair >= LEAST, np.minimum(pair, context) - DISCOUNT, 0.0).clip(0.0)


def _held_share(pairs: DataFrame, known_words: DataFrame, singles: list[tuple[int, int]]) -> np.ndarray:
    """k for each context level: what pairs hold of the probability, over all training tokens.

    ``singles`` lists (level, tokens) of words: a word is a context as often as it occurs, and the
    start of a document as often as its end.
    """
    near = pairs.where("context is null").select("at", "n")
    far = pairs.where("context is not null").select("n", F.col("context").alias("word"))
    names = known_words.select(F.col("gram").alias("word"), _level(F.col("n")).alias("at"))
    rows = near.unionByName(far.join(names, "word").select("at", "n"))
    cells = rows.groupBy("at", _level(F.col("n")).alias("level")).agg(F.sum("n").alias("n")).collect()
    seen, kept = np.zeros(_MAX_LEVEL + 1), np.zeros(_MAX_LEVEL + 1)
    for level, n in singles:
        seen[level] += n
    for row in cells:
        context, pair = _STANDS[[row["at"]]], _STANDS[[row["level"]]]
        share = _pair_weight(context, pair) / np.maximum(np.minimum(pair, np.maximum(context, 1)), 1)
        kept[row["at"]] += float(share[0]) * row["n"]
    return np.divide(kept, seen, out=np.zeros_like(kept), where=seen > 0)


def _by_level(grams: DataFrame) -> list[tuple[int, int, int]]:
    """(level, n-grams, occurrences) of ``grams(gram, n)``."""
    rows = grams.groupBy(_level(F.col("n")).alias("level")).agg(F.count("*").alias("grams"), F.sum("n").alias("n")).collect()
    return sorted((r["level"], r["grams"], r["n"]) for r in rows)


def train_model(train: DataFrame, filter_bytes: int = FILTER_BYTES, frequent: int = FREQUENT) -> tuple[Model, Tables]:
    """The model of ``train(text)`` and the tables that its scoring joins."""
    with shuffles_freed(train.sparkSession):
        known_words = word_counts(train)
        singles = _by_level(known_words)
        cut, frequent = 1, min(frequent, FREQUENT)
        while sum(grams for q, grams, _ in singles if q >= cut) > frequent:
            cut += 1
        top = known_words.where(_level(F.col("n")) >= cut).toArrow()
        hashes = top.column(0).to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        ends = known_words.where(F.col("gram") == F.lit(int(END.view(np.int64)))).first()
        counts, rank = np.unique(top.column(1).to_numpy().astype(np.int64)[order], return_inverse=True)
        model = Model(
            tokens=sum(n for _, _, n in singles),
            distinct=sum(grams for _, grams, _ in singles),
            documents=ends["n"] if ends else 0,
            frequent=hashes[order],
            rank=rank.astype(np.int32),
            counts=counts,
            bits=np.empty(0, np.uint64),
        )
        pairs = pair_counts(train, model)
        levels = _by_level(pairs)
        built, model.lowest = build_filter(pairs, [(q, grams) for q, grams, _ in levels], filter_bytes)
        model.bits = built.bits
        model.pairs = sum(grams for _, grams, _ in levels)
        model.pairs_held = sum(grams for q, grams, _ in levels if q >= model.lowest)
        model.blocks = _blocks_for(sum(q * grams for q, grams, _ in levels if q < model.lowest))
        # a document gets an answer from each part that it asks: past 64 parts these grow, until a task has its most to hold
        model.part_blocks = min(max(-(-model.blocks // 64), PART_BLOCKS), PART_BLOCKS_MOST)
        below = durable(_filled(pairs, F.col("level") < model.lowest, model.blocks), "filter", compression="zstd") if model.blocks else None
        model.held = _held_share(pairs, known_words, [(q, n) for q, _, n in singles])
        return model, Tables(known_words, below)


def _per_row(numbers: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """Lists of ``numbers``, ``rows`` of them each."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rows)).astype(np.int32)), pa.array(numbers))


_LOOSE = ("word", "place", "context", "at", "pair")  # of tokens whose word or context needs a join
_PROBE = ("words", "contexts")  # of tokens whose pair is looked for in a part


def _settle(model: Model, place, at, pair, word, context, size: np.ndarray) -> list[pa.Array]:
    """Sums over the tokens that need no join, and lists of those that do, for runs of ``size`` tokens."""
    loose = (place < 0) | (at < 0)
    full = np.zeros(len(place))
    full[~loose] = model.full(place[~loose], at[~loose], pair[~loose])
    run = np.repeat(np.arange(len(size)), size)
    each = np.bincount(run[loose], minlength=len(size))
    counts = np.full(len(place), -1, np.int64)
    counts[place >= 0] = model.counts[place[place >= 0]]
    lists = (word, counts, context, at.astype(np.int32), pair.astype(np.int32))
    return [pa.array(np.bincount(run, full, minlength=len(size))), *[_per_row(x[loose], each) for x in lists]]


def _scoring_fields(rows: DataFrame) -> list[T.StructField]:
    long, double, whole = T.LongType(), T.DoubleType(), T.IntegerType()
    fields = [rows_field(rows, "id"), T.StructField("key", long), T.StructField("n_tokens", long)]
    fields += [T.StructField("base", double), T.StructField("known", long), T.StructField("full", double)]
    kinds = (long, long, long, whole, whole)
    return fields + [T.StructField(c, T.ArrayType(k)) for c, k in zip(_LOOSE, kinds)]


def _probe_fields() -> list[T.StructField]:
    long, whole = T.LongType(), T.IntegerType()
    fields = [T.StructField("part", whole), T.StructField("turn", whole), T.StructField("block", long), T.StructField("bits", T.BinaryType())]
    return [*fields, T.StructField("probes", T.BinaryType()), *[T.StructField(c, T.ArrayType(long)) for c in _PROBE]]


# A probe, as it is shuffled: 32 bits of the n-gram, the block in its part, the place of the word's count among those of
# frequent words plus 1, and the level of the context plus 1. Bytes that are mostly alike take little room as planes.
_PACKED = np.dtype([("gram", "<u4"), ("block", "<u2"), ("place", "<u4"), ("at", "u1")])


def _packed(block: np.ndarray, grams: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(grams), _PACKED)
    out["gram"], out["block"], out["place"], out["at"] = grams & _INSIDE, block, place + 1, at + 1
    return out


def _unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, n-gram in the block, place, level) of packed probes."""
    place, at = (data[c].astype(np.int64) - 1 for c in ("place", "at"))
    return data["block"].astype(np.int64), data["gram"].astype(np.uint64), place, at


def _read_texts(rows: DataFrame, shared: Broadcast, turn: int = 0) -> DataFrame:
    """A row for each document (``turn`` 2) with all that broadcast tables settle, and rows of probes (``turn`` 1) for the parts.

    ``shared`` is the broadcast model; keys of documents differ between rounds.
    """
    scoring, probing = _scoring_fields(rows), _probe_fields()
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in [*scoring, *probing]])

    def batch_of(rows_in: int, **columns) -> pa.RecordBatch:
        arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows_in, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def probes(keys: np.ndarray, doc, found: Lookup, tokens, asked: np.ndarray, of: Model):
        block = LogFrequencyFilter.block_of(found.grams[asked], of.blocks)
        order = np.argsort(block // of.part_blocks, kind="stable")
        asked, block = asked[order], block[order]
        part = block // of.part_blocks
        heads, ends = _runs(part)
        row = np.repeat(np.arange(len(heads)), ends - heads)
        # probes of a row are in the order of their documents
        step = np.diff(doc[asked], prepend=0)
        step[heads] = doc[asked][heads]
        place, at = found.place[asked], found.at[asked]
        far_word, far_context = place < 0, at < 0
        step, packed = step.astype(np.uint32), _packed(block % of.part_blocks, found.grams[asked], place, at)
        return batch_of(
            len(heads),
            key=pa.array(np.full(len(heads), keys[0])),
            part=pa.array(part[heads]),
            turn=pa.array(np.ones(len(heads), np.int32)),
            probes=pa.array([_squeezed(step[lo:hi], packed[lo:hi]) for lo, hi in zip(heads, ends)]),
            words=_per_row(tokens[asked][far_word].view(np.int64), np.bincount(row[far_word], minlength=len(heads))),
            contexts=_per_row(found.before[asked][far_context].view(np.int64), np.bincount(row[far_context], minlength=len(heads))),
        )

    def kernel(batches):
        of = shared.value
        parts = of.parts()
        number = (TaskContext.get().partitionId() * ROUNDS + turn) << 33
        for batch in batches:
            ids = batch.column(0)
            for some, tokens, ends in _grouped(batch):
                found = of.lookups(tokens, ends)
                pair = of.upper(found.grams)
                sizes = np.diff(np.append(0, ends))
                doc = np.repeat(np.arange(len(some)), sizes)
                here = found.place >= 0
                base = np.zeros(len(tokens))
                base[here] = np.log10(of.low(found.place[here]))
                keys = number + np.arange(len(some))
                number += len(some)
                kept = np.flatnonzero((pair > 0) | (parts == 0))
                settled = _settle(
                    of, found.place[kept], found.at[kept], pair[kept], found.words(tokens)[kept], found.contexts()[kept],
                    np.bincount(doc[kept], minlength=len(some)),
                )
                yield batch_of(
                    len(some),
                    id=ids.slice(some[0], len(some)),
                    key=pa.array(keys),
                    n_tokens=pa.array(sizes),
                    base=pa.array(np.bincount(doc, base, minlength=len(some))),
                    known=pa.array(np.bincount(doc[here], minlength=len(some))),
                    part=pa.array((keys % max(parts, 1)).astype(np.int32)),
                    turn=pa.array(np.full(len(some), 2, np.int32)),
                    **dict(zip(("full", *_LOOSE), settled)),
                )
                asked = np.flatnonzero((pair == 0) & (parts > 0))
                if len(asked):
                    yield probes(keys, doc, found, tokens, asked, of)

    return arrow_map(rows, kernel, [*scoring, *probing])


def _probe_parts(read: DataFrame, model: Model, shared: Broadcast, below: DataFrame) -> DataFrame:
    """The rows of ``read`` with probes answered. A task meets a part's blocks first, then streams what asks for them."""
    size, parts = model.part_blocks, model.parts()
    scoring = [read.schema[i] for i in range(6 + len(_LOOSE))]
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in scoring])
    number = F.call_function("div", F.col("block"), F.lit(size).cast("bigint")).cast("int")
    blocks = below.select(number.alias("part"), F.lit(0).alias("turn"), "block", "bits")
    rows = read.unionByName(blocks, allowMissingColumns=True)
    tasks = min(parts, max(shuffle_width(read.sparkSession), 64))
    dealt = rows.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "turn")

    def answered(of: Model, bits: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        words_in, contexts_in = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in _PROBE)
        sent = [_restored(data, np.uint32, _PACKED) for data in rows.column("probes").to_pylist()]
        block, gram, place, at = _unpacked(np.concatenate([packed for _, packed in sent]))
        keys = np.concatenate([key + np.cumsum(step, dtype=np.int64) for key, (step, _) in zip(rows.column("key").to_pylist(), sent)])
        pair = LogFrequencyFilter(bits).levels(gram, block)
        word, context = np.zeros((2, len(gram)), np.int64)
        word[place < 0], context[at < 0] = words_in, contexts_in
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        settled = _settle(of, place, at, pair, word, context, np.diff(np.append(begin, len(keys))))
        nothing = pa.array(np.zeros(len(begin), np.int64))
        columns = {"key": pa.array(keys[begin]), "n_tokens": nothing, "base": nothing, "known": nothing}
        columns |= dict(zip(("full", *_LOOSE), settled))
        arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(begin), f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def kernel(batches):
        of = shared.value
        part, bits = -1, np.zeros(0, np.uint64)
        for batch in batches:
            turn, owner = (batch.column(c).to_numpy() for c in ("turn", "part"))
            edges = np.flatnonzero((np.diff(turn) != 0) | (np.diff(owner) != 0)) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, len(turn))):
                if owner[lo] != part:
                    part, bits = owner[lo], np.zeros(size * _BLOCK_WORDS, np.uint64)
                if turn[lo] == 2:
                    yield batch.slice(lo, hi - lo).select(schema.names)
                for at in range(lo, hi if turn[lo] < 2 else lo, _ROWS_AT_ONCE):
                    rows = batch.slice(at, min(_ROWS_AT_ONCE, hi - at))
                    if turn[lo] == 1:
                        yield answered(of, bits, rows)
                        continue
                    for number, data in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
                        place = (number - int(part) * size) * _BLOCK_WORDS
                        bits[place : place + _BLOCK_WORDS] = np.frombuffer(data, np.uint64)

    return arrow_map(dealt, kernel, scoring)


def _with_counts(each: DataFrame, words: DataFrame) -> DataFrame:
    """``(key, far, place, at, pair)`` of loose tokens: counts of words (``far``: joined) and levels of contexts.

    Only tokens whose word is outside the broadcast table meet the words, then only those whose context is.
    """
    none = F.lit(0).cast("bigint")
    near = each.where("place >= 0").select("key", F.lit(False).alias("far"), "place", "context", "at", "pair")
    of_word = words.select(F.col("gram").alias("word"), F.col("n").alias("word_n"))
    far = each.where("place < 0").join(of_word, "word", "left")
    far = far.select("key", F.lit(True).alias("far"), F.coalesce("word_n", none).alias("place"), "context", "at", "pair")
    found = near.unionByName(far)
    of_context = words.select(F.col("gram").alias("context"), F.col("n").alias("context_n"))
    behind = found.where("at < 0").drop("at").join(of_context, "context", "left")
    behind = behind.withColumn("at", _level(F.coalesce("context_n", none))).drop("context", "context_n")
    return found.where("at >= 0").drop("context").unionByName(behind)


def score(df: DataFrame, model: Model, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score)`` for every row of ``df``.

    One pass reads the texts and settles what the broadcast tables know; probes for rarer pairs go to the parts of
    the filter, and words and contexts outside the broadcast table get their exact counts by a join.
    """
    rows = picked(df, id=id_col, text=text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rounds, written = 1 if tables.filter is None else ROUNDS, []
    with shuffles_freed(df.sparkSession):
        for turn in range(rounds):
            some = rows if rounds == 1 else rows.where(F.pmod(F.hash("id"), F.lit(rounds)) == turn)
            done = _read_texts(some, shared, turn)
            if tables.filter is not None:
                done = _probe_parts(done, model, shared, tables.filter)
            written.append(durable(done.select("id", "key", "n_tokens", "base", "known", "full", *_LOOSE), "lm-scores", compression="zstd"))
    shared.destroy()
    scored = reduce(DataFrame.unionByName, written)
    met = _with_counts(scored.select("key", F.explode(F.arrays_zip(*_LOOSE)).alias("t")).select("key", "t.*"), tables.words)
    none = F.lit(0).cast("bigint")
    low = (F.col("place") + 0.5) / F.lit(model.uniform())
    stands, held = (F.array(*[F.lit(float(x)) for x in table]) for table in (_STANDS, model.held))
    context, pair = F.element_at(stands, F.col("at") + 1), F.element_at(stands, F.col("pair") + 1)
    weight = F.when(pair >= LEAST, F.greatest(F.least(pair, context) - DISCOUNT, F.lit(0.0))).otherwise(0.0)
    p = weight / F.greatest(context, F.lit(1.0)) + (1 - F.element_at(held, F.col("at") + 1)) * low
    more = met.select(
        "key",
        F.when(F.col("far"), F.log10(low)).otherwise(0.0).alias("base"),
        F.log10(F.least(p, F.lit(1.0))).alias("full"),
        (F.col("far") & (F.col("place") > 0)).cast("bigint").alias("known"),
    )
    probed = scored.where("n_tokens = 0").select("key", "base", "full", "known")
    sums = more.unionByName(probed).groupBy("key").agg(*[F.sum(c).alias(f"more_{c}") for c in ("base", "full", "known")])
    joined = scored.where("n_tokens > 0").drop(*_LOOSE).join(sums, "key", "left")
    return joined.select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", none)).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("full") + F.coalesce("more_full", F.lit(0.0))).alias("score"),
    )
