"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``bits // 2 + 1`` segments. Two fingerprints that differ in
at most ``bits`` places have a segment in which they differ in at most one, so they share
either that segment or one variant of it with a single bit blanked out. The variants are
indexed, joined by equality, and verified on all 64 bits.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts with
fewer words than a shingle hash the whole word sequence; repeated rows, equal texts and equal
fingerprints meet in one node before any join; a row without id takes part, but only ids name
a component (null when a component has none); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.components import components
from flowlake.llm.rows import arrow_map, field, picked, texts, words
from flowlake.sources.durable import durable

BITS = 64
SEED = 42
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_COLUMN_OFFSET = np.arange(8) * 256


def fingerprint(tokens: list[bytes], size: int = 3) -> int:
    """SimHash of the word shingles, repeats included, as a signed 64-bit number."""
    if not tokens:
        return 0
    shingles = [b" ".join(tokens)] if len(tokens) < size else map(b" ".join, zip(*(tokens[i:] for i in range(size))))
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((hashes + _COLUMN_OFFSET).ravel(), minlength=8 * 256).reshape(8, 256)
    bits = (counts @ _BIT_OF_BYTE).ravel() * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, mark, fp)`` for every row of ``df``; ``mark`` is a 64-bit hash of the text itself."""

    def kernel(batches):
        for batch in batches:
            whole = texts(batch, "text")
            fps = [fingerprint(words(t), size) for t in whole]
            marks = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in whole), np.uint64, len(whole)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks), pa.array(fps, pa.int64())], names=["id", "mark", "fp"]
            )

    rows = picked(df, id=id_col, text=text_col)
    fields = [field(rows, "id"), T.StructField("mark", T.LongType()), T.StructField("fp", T.LongType())]
    return arrow_map(rows, kernel, fields)


def text_mark(text: Column) -> Column:
    """The ``mark`` of ``fingerprints`` as a column: Spark hashes strings by the same function and seed."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _cuts(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    pieces = bits // 2 + 1
    edges = [BITS * i // pieces for i in range(pieces + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1).cast("bigint"))


def _segment_keys(value: Column, number: int, width: int, side: int) -> list[Column]:
    whole = F.array(F.struct(F.lit(number * 128 + 127).alias("place"), value.alias("rest")))
    power = F.array(*[F.lit(1 << p if p < 63 else -(1 << 63)).cast("bigint") for p in range(width)])
    places = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: F.getbit(value, p) == side)
    blanked = F.transform(
        places,
        lambda p: F.struct(
            (p + number * 128).alias("place"), (value.bitwiseOR(F.get(power, p)) - F.get(power, p)).alias("rest")
        ),
    )
    return [whole, blanked]


def _variants(fps: DataFrame, cuts: list[tuple[int, int]], side: int) -> DataFrame:
    """Keys of one side: the whole segment, and each variant whose blanked bit equals ``side``.

    On the key of a variant the left rows all carry 0 and the right rows all carry 1 in the
    blanked place, so a pair with equal segments meets once (on the whole segment), not once
    per place.
    """
    keys = []
    for number, (shift, width) in enumerate(cuts):
        keys += _segment_keys(_segment(F.col("fp"), shift, width), number, width, side)
    spread = fps.select("fp", F.explode(F.concat(*keys)).alias("key"))
    return spread.select("fp", F.col("key.place").alias("place"), F.col("key.rest").alias("rest"))


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """``(a, b)`` with a < b: every pair of distinct ``fps.fp`` differing in at most ``bits`` places, once.

    A pair is reported by its first segment with at most one difference only. The variants always
    meet by a sort-merge join: Spark sizes them as if ``explode`` added no rows, some 34 to one,
    and would broadcast them.
    """
    if not 0 <= bits < BITS // 2:
        raise ValueError("bits must lie in 0..31")
    cuts = _cuts(bits)
    left = _variants(fps, cuts, 0).withColumnRenamed("fp", "x")
    right = _variants(fps, cuts, 1).withColumnRenamed("fp", "y")
    apart = F.col("x").bitwiseXOR(F.col("y"))
    found = (F.bit_count(apart) <= bits) & ((F.col("place") % 128 != 127) | (F.col("x") < F.col("y")))
    for number, (shift, width) in enumerate(cuts[:-1]):
        earlier = F.bit_count(_segment(apart, shift, width)) <= 1
        found = found & ~((F.col("place") >= (number + 1) * 128) & earlier)
    pairs = left.join(right.hint("merge"), ["place", "rest"]).where(found)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 3) -> DataFrame:
    """``(id, mark, fp, root, component)`` for every row: component is the smallest id linked directly or through others.

    ``root`` is the smallest fingerprint of the component, its name even where ids are missing or repeated.

    Texts are read once; what is written and joined afterwards is three numbers per row. Rows
    with one fingerprint form one node, so a group of copies, however large, costs one node.
    """
    rows = durable(fingerprints(df, id_col, text_col, size), "fingerprints")
    nodes = durable(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    roots = durable(components(links(nodes, bits)), "roots")
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select(
        nodes.fp, "first_id", F.coalesce("root", nodes.fp).alias("root")
    )
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component"))
    named = linked.join(firsts, "root").select(F.col("fp").alias("node"), "root", "component")
    return rows.join(named, rows.fp == named.node).select("id", "mark", "fp", "root", "component")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 3) -> DataFrame:
    """``df`` with one row per component, columns as they were: the row named by the component.

    Of repeated rows with that id the one with the smallest text hash stays. A component
    without any id keeps its row with the smallest text hash.
    """
    return one_per_root(df, clusters(df, id_col, text_col, size, bits), id_col, text_col)


def one_per_root(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that ``found(id, mark, root, component)`` names, one per root."""
    found = durable(found, "clusters")
    best = (
        found.where(F.col("id").eqNullSafe(F.col("component")))
        .groupBy("root")
        .agg(F.min(F.struct("mark", "id")).alias("best"))
        .select(F.col("best.id").alias("_kept_id"), F.col("best.mark").alias("_kept_mark"))
    )
    columns = [df[c].alias(f"_column{i}") for i, c in enumerate(df.columns)]
    ours = df.select(*columns, df[id_col].alias("_id"), text_mark(df[text_col]).alias("_mark"))
    kept = ours.join(best, ours["_id"].eqNullSafe(best["_kept_id"]) & (ours["_mark"] == best["_kept_mark"]))
    again = Window.partitionBy("_kept_id", "_kept_mark").orderBy("_id")
    once = kept.withColumn("_copy", F.row_number().over(again)).where("_copy = 1")
    return once.select(*[F.col(f"_column{i}").alias(c) for i, c in enumerate(df.columns)])
