"""Alignment of two tokenizers over a corpus, with an identity map as its fast path.

Both tokenizers spell the same bytes: a space and the text. Byte offsets where tokens of both end cut a
text into groups; tokens whose byte ranges overlap are linked. Most groups are one token against
the one with the same bytes, so A ids are mapped to such B ids beforehand: groups that follow the map
are counted in vectors as long as A's vocabulary, and only the pairs of irregular groups are
shuffled, summed by task before. Counts of the map's pairs and of the most frequent other pairs (both
bounded) then go to every task; the rest meets its counts by a join.

Edge cases: null and empty texts, and texts that a tokenizer does not spell byte by byte (a text
holding U+2581, which one vocabulary uses for the space), have no tokens: zeros and an
empty digest. Texts of any length are encoded whole; repeated rows count each time and stay rows;
a row without id is a row like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, field, once_per_worker, picked, texts
from flowlake.llm.token_counts import GPT2_PATTERN
from flowlake.sources.durable import durable

# Pairs outside the identity map whose counts go to every task: at most so many, the most frequent ones.
FREQUENT = 200_000
# Texts are encoded in groups of about so many bytes; pairs are summed when so many are held.
_GROUP = 1_000_000
_HELD = 2_000_000
# Pair counts are ranked in this many steps per doubling.
_STEPS = 4
_LOW = (1 << 32) - 1


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 characters stand for themselves, others for 256 and up."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Side:
    """One tokenizer: ``encode`` a list of texts to ids; ``spelled`` the bytes of every id."""

    encode: Callable[[list[str]], Iterable[Sequence[int]]]
    spelled: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)


def _ranked(coder, spelled: list[bytes]):
    """The same vocabulary as a rank-based encoder, which is several times faster; None where ids do not follow the merges."""
    import tiktoken

    model = json.loads(coder.to_str())
    split = model["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    bytes_first = sorted(spelled[:256]) == [bytes([b]) for b in range(256)]
    letters = byte_letters()
    in_order = all(spelled[256 + i] == bytes(letters[c] for c in x + y) for i, (x, y) in enumerate(merges))
    if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or not bytes_first or not in_order:
        return None
    ranks = {s: i for i, s in enumerate(spelled[: 256 + len(merges)])}
    return tiktoken.Encoding("aligned", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_level(path: str) -> Side:
    """A byte-level BPE file of the ``tokenizers`` library; it is given a space before the text.

    Texts of Latin letters and common signs only, on whose classes all regex engines agree, go to a faster
    encoder with the same ranks; all others to the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    letters = byte_letters()
    spelled = [b""] * coder.get_vocab_size()
    for token, number in coder.get_vocab().items():
        spelled[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    fast, common = _ranked(coder, spelled), re.compile(r"[\t-\r -~\u00A1-\u024F]*").fullmatch

    def encode(group: list[str]) -> Iterator[Sequence[int]]:
        for text in group:
            if fast and common(text):
                yield fast.encode_to_numpy(" " + text, disallowed_special=())
            else:
                yield coder.encode(" " + text, add_special_tokens=False).ids

    return Side(encode, spelled)


def pieces(path: str) -> Side:
    """A sentence-piece model that puts a space before the text itself and falls back to bytes."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [
        bytes([int(p[3:5], 16)]) if coder.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, coder.id_to_piece(i)) for i in range(coder.get_piece_size()))
    ]
    return Side(lambda group: coder.encode(group, num_threads=1), spelled)


class Aligner:
    """Both tokenizers and the map from A ids to the B ids with the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level(path_a), pieces(path_b)
        by_bytes: dict[bytes, int] = {}
        for number, spelled in enumerate(self.b.spelled):
            # a piece goes before the byte token that spells the same
            if spelled not in by_bytes or len(spelled) == 1:
                by_bytes[spelled] = number
        self.same = np.array([by_bytes.get(s, -1) for s in self.a.spelled], np.int64)
        # decimal ids with what may follow them: an id of the same side, the other side, the next group
        size = max(len(self.a.spelled), len(self.b.spelled))
        self._written = [f"{i}{sign}" for sign in ",|;" for i in range(size)]
        self._size = size

    def align(self, text: bytes, ids_a: Sequence[int], ids_b: Sequence[int]) -> dict | None:
        """Groups and links of one text; nothing when a side does not spell it."""
        whole = b" " + text
        # a ranked encoder, which gives arrays, spells every text
        for side, ids in ((self.a, ids_a), (self.b, ids_b)):
            if not isinstance(ids, np.ndarray) and b"".join(map(side.spelled.__getitem__, ids)) != whole:
                return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = self.a.lengths[a].cumsum(), self.b.lengths[b].cumsum()
        marks = np.zeros(len(whole) + 1, np.int8)
        marks[ends_a] += 1
        marks[ends_b] += 1
        ends = np.flatnonzero(marks == 2)
        group_a, group_b = ends.searchsorted(ends_a), ends.searchsorted(ends_b)
        many_a, many_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        alone = (many_a == 1) & (many_b == 1)
        plain = alone.copy()
        plain[alone] = self.same[a[alone[group_a]]] == b[alone[group_b]]
        # a link for every stretch between neighbouring ends of either side
        odd_a, odd_b = ~plain[group_a], ~plain[group_b]
        marks[:] = 0
        marks[ends_a[odd_a]] = marks[ends_b[odd_b]] = 1
        cuts = np.flatnonzero(marks)
        x, y = a[ends_a.searchsorted(cuts)], b[ends_b.searchsorted(cuts)]
        return {
            "n_a": len(a),
            "n_b": len(b),
            "n_groups": len(ends),
            "n_links": len(a) + len(b) - len(ends),
            "groups_sha256": self._digest(a, b, group_a, group_b, many_a, many_b),
            "plain": a[~odd_a].astype("<u4").tobytes(),
            "odd": (x << 32 | y).astype("<i8").tobytes(),
        }

    def _digest(self, a, b, group_a, group_b, many_a, many_b) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``: every id is written with the sign that follows it."""
        place_a = np.arange(len(a)) + (many_b.cumsum() - many_b)[group_a]
        place_b = np.arange(len(b)) + many_a.cumsum()[group_b]
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a] = a + np.where(last_a, self._size, 0)
        codes[place_b] = b + np.where(last_b, 2 * self._size, 0)
        listed = "".join(map(self._written.__getitem__, codes.tolist()))
        return hashlib.sha256(listed[:-1].encode()).hexdigest()


def aligner(path_a: str, path_b: str) -> Aligner:
    return once_per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def _groups(whole: list[bytes]) -> Iterator[tuple[int, int]]:
    """Spans of rows that hold about ``_GROUP`` bytes."""
    start = size = 0
    for i, text in enumerate(whole):
        size += len(text)
        if size > _GROUP:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(whole):
        yield start, len(whole)


_NONE = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "plain": b"", "odd": b""}
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written ``(row, id, n_a, n_b, n_groups, n_links, groups_sha256, plain, odd)`` for every row of ``df``.

    ``row`` is unique. ``plain`` holds the A ids of groups that follow the identity map, ``odd`` the linked id
    pairs of all other groups as ``a << 32 | b``, both once per occurrence.
    """
    rows = picked(df, row=F.monotonically_increasing_id(), id=id_col, text=text_col)
    fields = [
        T.StructField("row", T.LongType()),
        field(rows, "id"),
        *[T.StructField(c, T.LongType()) for c in _COUNTS],
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("plain", T.BinaryType()),
        T.StructField("odd", T.BinaryType()),
    ]
    kinds = {**dict.fromkeys(_COUNTS, pa.int64()), "groups_sha256": pa.string(), "plain": pa.binary(), "odd": pa.binary()}

    def kernel(batches):
        both = aligner(path_a, path_b)
        for batch in batches:
            whole = texts(batch, "text")
            for lo, hi in _groups(whole):
                group = [t.decode() for t in whole[lo:hi]]
                sides = zip(whole[lo:hi], both.a.encode(group), both.b.encode(group))
                found = [(t and both.align(t, x, y)) or _NONE for t, x, y in sides]
                columns = [pa.array([f[c] for f in found], kind) for c, kind in kinds.items()]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["row", "id", *kinds])

    return durable(arrow_map(rows, kernel, fields), "aligned")


def pair_counts(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Written ``(code, n, plain, best)``: how many links hold each id pair, whether some followed the map, whether
    no pair of the same B id has a higher count."""

    def kernel(batches):
        same = aligner(path_a, path_b).same
        counted = np.zeros(len(same), np.int64)
        held: list[np.ndarray] = []

        def summed():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return batch_of(codes, n, False)

        def batch_of(codes, n, plain):
            flags = pa.array(np.full(len(codes), plain))
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64)), flags], names=["code", "n", "plain"])

        size = 0
        for batch in batches:
            for ids, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted += np.bincount(np.frombuffer(ids, "<u4"), minlength=len(same))
                held.append(np.frombuffer(pairs, "<i8"))
                size += len(held[-1])
                if size > _HELD:
                    yield summed()
                    size = 0
        if held:
            yield summed()
        used = np.nonzero(counted)[0]
        yield batch_of(used << 32 | same[used], counted[used], True)

    fields = [T.StructField("code", T.LongType()), T.StructField("n", T.LongType()), T.StructField("plain", T.BooleanType())]
    partial = arrow_map(found.select("plain", "odd"), kernel, fields)
    pairs = durable(partial.groupBy("code").agg(F.sum("n").alias("n"), F.max("plain").alias("plain")), "pairs")
    second = F.col("code").bitwiseAND(F.lit(_LOW))
    # one row for each id of B's vocabulary
    highest = pairs.groupBy(second.alias("_b")).agg(F.max("n").alias("_most"))
    judged = pairs.join(F.broadcast(highest), second == F.col("_b"))
    return durable(judged.select("code", "n", "plain", (F.col("n") == F.col("_most")).alias("best")), "pair-counts")


def _least_frequent(pairs: DataFrame, limit: int) -> int:
    """The lowest count from which at most ``limit`` pairs have as much, found from a table of count sizes."""
    step = F.floor(F.log2("n") * _STEPS).alias("step")
    sizes = {r["step"]: (r["pairs"], r["least"]) for r in pairs.groupBy(step).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()}
    total, lowest = 0, 1 << 62
    for step in sorted(sizes, reverse=True):
        total += sizes[step][0]
        if total > limit:
            break
        lowest = sizes[step][1]
    return lowest


def with_counts(found: DataFrame, pairs: DataFrame, vocabulary: int, frequent: int = FREQUENT) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``found``.

    ``vocabulary`` is the number of A ids.
    """
    others = pairs.where("not plain")
    lowest = _least_frequent(others, frequent)
    at_hand = pairs.where(F.col("plain") | (F.col("n") >= lowest)).toArrow().sort_by("code")
    codes, ns, tops, plain = (at_hand.column(c).to_numpy() for c in ("code", "n", "best", "plain"))
    # pairs of the map are looked up by A id; they can come from irregular groups, too
    counts, bests = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, bool)
    counts[codes[plain] >> 32], bests[codes[plain] >> 32] = ns[plain], tops[plain]
    lists = [T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]

    def kernel(batches):
        for batch in batches:
            sums, best, left, times = [], [], [], []
            for ids, odd in zip(batch.column("plain").to_pylist(), batch.column("odd").to_pylist()):
                ids, odd = np.frombuffer(ids, "<u4"), np.frombuffer(odd, "<i8")
                at = np.minimum(codes.searchsorted(odd), max(len(codes) - 1, 0))
                known = codes[at] == odd if len(codes) else np.zeros(len(odd), bool)
                at = at[known]
                sums.append(int(counts[ids].sum() + ns[at].sum()))
                best.append(int(bests[ids].sum() + tops[at].sum()))
                rest, n = np.unique(odd[~known], return_counts=True)
                left.append(rest)
                times.append(n)
            kept = [batch.column(c) for c in ("row", "id", *_COUNTS, "groups_sha256")]
            kind = pa.list_(pa.int64())
            added = [pa.array(best, pa.int64()), pa.array(sums, pa.int64()), pa.array(left, kind), pa.array(times, kind)]
            yield pa.RecordBatch.from_arrays(
                [*kept, *added], names=["row", "id", *_COUNTS, "groups_sha256", "n_best", "count_sum", "codes", "times"]
            )

    base = [f for f in found.schema.fields if f.name not in ("plain", "odd")]
    sums = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    scored = durable(arrow_map(found, kernel, [*base, *sums, *lists]), "aligned-counts")
    rare = scored.select("row", F.explode(F.arrays_zip("codes", "times")).alias("pair"))
    met = rare.select("row", F.col("pair.codes").alias("code"), F.col("pair.times").alias("times")).join(
        others.where(F.col("n") < lowest).select("code", "n", "best"), "code"
    )
    more = met.groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
    )
    joined = scored.drop("codes", "times").join(more, "row", "left")
    return joined.select(
        "id",
        *_COUNTS,
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def align(
    df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """Alignment of every text of ``df``: tokens, groups, links, and how often the linked id pairs occur in all of ``df``."""
    found = aligned(df, path_a, path_b, id_col, text_col)
    pairs = pair_counts(found, path_a, path_b)
    return with_counts(found, pairs, len(aligner(path_a, path_b).same), frequent)
