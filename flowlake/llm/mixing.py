"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

The word total of the table is shared among the sources by weight; no source's target passes
``ceiling`` times its own words, and what it leaves is shared again by weight. Targets are cut
into blocks of ``block`` words. Blocks go to sources, then each source's blocks to its shards,
by the highest quotients ``weight / (2k - 1)``. Inside a shard documents lie in seeded order
on one line of words, and the quota takes the line from its head: whole rounds first, then its
first blocks. So all texts are whole but one a shard, which ends where the quota does.

Edge cases: a null or wordless text has size 0, takes nothing and is absent from the mix;
null is a source of its own, last in order; repeated rows are separate documents; an empty
table gives an empty plan; ids may be null. Extra columns are never referred to by name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.rows import WORD
from flowlake.sources.durable import durable

SHARD_WORDS = 1 << 22
_FINE = 20  # bits of the finest shard number


def _div(a: Column, b: Column | int) -> Column:
    """Integer quotient of non-negative numbers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """``(key, source, words, place, target)`` from ``sizes(key, source, words)``, one row per source.

    Sorted by cap over weight, the level at which the uncapped share what the capped leave is
    the highest of the levels reached one source after another; a target is the smaller of cap
    and weight times level.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(ordered)).withColumn(
        "weight", F.get(given, (F.col("place") - 1) % len(weights))
    )
    everything = Window.partitionBy(F.lit(0))
    by_cap = everything.orderBy(F.col("words") * ceiling / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("words").over(everything) - F.coalesce(F.sum(F.col("words") * ceiling).over(before), F.lit(0))
    levels = placed.withColumn("level", left / F.sum("weight").over(onward))
    top = F.max("level").over(everything)
    target = F.least(F.col("words") * float(ceiling), F.col("weight") * top)
    return levels.withColumn("target", target).select("key", "source", "words", "place", "target")


def _apportioned(rows: DataFrame, share: str, seats: str, within: Sequence[str], tie: str) -> DataFrame:
    """``rows`` with ``quota``: ``seats`` handed out by highest Sainte-Lague quotients of ``share`` inside ``within``.

    The rounded exact quota is at most ``share of the whole x number of rows + 1`` seats from
    the right one, so only the quotients in that band are listed and ranked: a few per row.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    whole = F.sum(share).over(group)
    part = F.when(whole > 0, F.col(share) / whole).otherwise(F.lit(0.0))
    near = rows.withColumn("_part", part).withColumn("_width", F.ceil(F.col("_part") * F.count("*").over(group)) + 1)
    rounded = F.floor(F.col("_part") * F.col(seats) + 0.5)
    near = near.withColumn("_sure", F.greatest(rounded - F.col("_width"), F.lit(0)))
    near = near.withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    listed = near.select(
        *within, tie, share, "_open", F.explode(F.sequence(F.col("_sure") + 1, rounded + F.col("_width"))).alias("_seat")
    ).where(F.col(share) > 0)
    rank = F.row_number().over(group.orderBy((F.col(share) / (2 * F.col("_seat") - 1)).desc(), tie, "_seat"))
    won = listed.withColumn("_rank", rank).where("_rank <= _open").groupBy(*within, tie).agg(F.count("*").alias("_won"))
    joined = near.join(won, [*within, tie], "left")
    return joined.withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop(
        "_part", "_width", "_sure", "_open", "_won"
    )


def _names(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The columns of ``df`` under private numbers, with size, source key and seeded order."""
    source = df[source_col].cast("string")
    return df.select(
        *[df[c].alias(f"_column{i}") for i, c in enumerate(df.columns)],
        df[id_col].alias("_id"),
        F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
        source.alias("_source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_key"),
        F.xxhash64(F.lit(seed), df[id_col], df[text_col]).alias("_order"),
    )


def plan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    ceiling: int = 3,
    block: int = 16,
    seed: int = 42,
) -> DataFrame:
    """Every row of ``df`` as ``_column0, _column1, ...`` with its part in the mix.

    Added: ``_size``, ``_source_size``, ``_target`` (of its source), ``_rounds`` (times the
    whole text is taken), ``_more`` (its first words, taken once more) and ``_taken`` (words, repeats counted). The number of shards follows the word total, so
    no window holds more than about ``SHARD_WORDS`` words, up to a total of ``SHARD_WORDS``
    times 2**20 (some 30 TB of text); beyond it shards grow with the table.
    """
    named = _names(df, id_col, text_col, source_col, seed)
    fine = F.shiftrightunsigned("_order", 64 - _FINE).cast("int")
    counts = durable(
        named.groupBy(F.col("_key").alias("key"), F.col("_source").alias("source"), fine.alias("fine")).agg(
            F.sum("_size").alias("words")
        ),
        "sizes",
    )
    total = counts.agg(F.sum("words")).first()[0] or 0
    depth = min(_FINE, max(0, math.ceil(math.log2(max(total, 1) / SHARD_WORDS))))
    sources = targets(counts.groupBy("key", "source").agg(F.sum("words").alias("words")), weights, ceiling)
    sources = sources.withColumn("_seats", F.lit(round(total / block)))
    quotas = durable(_apportioned(sources, "target", "_seats", [], "place"), "quotas")
    shards = counts.groupBy("key", F.shiftright("fine", _FINE - depth).alias("shard")).agg(
        F.sum("words").alias("cell_words")
    )
    cells = shards.join(
        quotas.select("key", F.col("words").alias("_source_size"), F.col("target").alias("_target"), F.col("quota").alias("_seats")),
        "key",
    )
    cells = _apportioned(cells, "cell_words", "_seats", ["key"], "shard")
    pieces = F.greatest(F.floor(F.col("cell_words") / block + 0.5), F.lit(1)).cast("bigint")
    cells = cells.withColumn("pieces", pieces).withColumn("quota", F.least("quota", F.col("pieces") * ceiling))
    cells = durable(
        cells.select(
            F.col("key").alias("_key"),
            F.col("shard").alias("_shard"),
            "_source_size",
            "_target",
            "cell_words",
            "pieces",
            _div(F.col("quota"), F.col("pieces")).alias("_rounds"),
            _div((F.col("quota") % F.col("pieces")).cast("bigint") * F.col("cell_words"), F.col("pieces")).alias("more_words"),
        ),
        "cells",
    )
    laid = named.withColumn("_shard", F.shiftright(fine, _FINE - depth))
    line = Window.partitionBy("_key", "_shard").orderBy("_order", "_id", "_size")
    laid = laid.withColumn(
        "_from", F.coalesce(F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rows = laid.join(cells, ["_key", "_shard"])
    more = F.greatest(F.least(F.col("more_words") - F.col("_from"), "_size"), F.lit(0)).cast("bigint")
    rows = rows.withColumn("_more", more)
    return rows.withColumn("_taken", F.col("_rounds") * F.col("_size") + F.col("_more"))


def mixed(
    df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **options
) -> DataFrame:
    """The mix itself, columns as in ``df``: whole copies, and in each shard of a source one text at most that is cut.

    A cut text keeps its first words and the blanks between them; ``chars_col``, when it is a
    column, becomes its length.
    """
    planned = plan(df, text_col=text_col, **options).where("_taken > 0")
    at = df.columns.index(text_col)
    text = F.col(f"_column{at}")
    is_cut = (F.col("_more") > 0) & (F.col("_more") < F.col("_size"))
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.regexp_replace(F.array_join(F.slice(pieces, 1, F.col("_more").cast("int")), ""), r"^[\x20\x09-\x0D]+", "")
    times = F.col("_rounds") + F.when(F.col("_more") == F.col("_size"), 1).otherwise(0)
    whole = F.array_repeat(F.lit(None).cast("string"), times.cast("int"))
    copies = F.concat(whole, F.when(is_cut, F.array(head)).otherwise(F.array().cast("array<string>")))
    rows = planned.withColumn("_excerpt", F.explode(copies))
    out = []
    for i, name in enumerate(df.columns):
        value = F.col(f"_column{i}")
        if i == at:
            value = F.coalesce("_excerpt", value)
        elif name == chars_col:
            value = F.when(F.col("_excerpt").isNull(), value).otherwise(F.length("_excerpt").cast(df.schema[name].dataType))
        out.append(value.alias(name))
    return rows.select(*out)
