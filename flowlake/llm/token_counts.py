"""Exact length histogram of encoded documents, and what it answers for every context limit.

Documents are counted by their number of tokens; running sums over the histogram then give,
for any limit, how many documents fit, how many tokens they hold, and how many tokens remain
when every document is cut at the limit.

Edge cases: a null or empty text has length 0 and is counted; repeated rows count each time;
texts of any length are encoded whole; an empty table gives an empty histogram, totals of 0
and quantiles of null.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, once_per_worker, picked, texts
from flowlake.sources.durable import durable

# The split pattern the vocabulary was built with (fixed value).
GPT2_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# Lengths are summed in blocks of so many before they are summed over blocks.
_BLOCK = 1024


def encoder(path: str, pattern: str):
    """A byte-level encoder from a file of ``base64 rank`` lines."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(df: DataFrame, vocabulary: str, text_col: str = "text", pattern: str = GPT2_PATTERN) -> DataFrame:
    """``tokens`` for every row of ``df``."""

    def kernel(batches):
        coder = once_per_worker(("encoder", vocabulary, pattern), lambda: encoder(vocabulary, pattern))
        for batch in batches:
            counts = [len(coder.encode_ordinary(t.decode())) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["tokens"])

    return arrow_map(picked(df, text=text_col), kernel, [T.StructField("tokens", T.LongType())])


def histogram(df: DataFrame, vocabulary: str, text_col: str = "text", pattern: str = GPT2_PATTERN) -> DataFrame:
    """``(tokens, documents)``: one row per length that occurs."""
    return lengths(df, vocabulary, text_col, pattern).groupBy("tokens").agg(F.count("*").alias("documents"))


def context_table(counts: DataFrame) -> DataFrame:
    """The histogram with its running sums, one row per length, answering that length as a context limit.

    ``fitting_documents``/``fitting_tokens``: no longer than the limit. ``longer_documents``/
    ``longer_tokens``: suffix sums beyond it. ``truncated_tokens``: all documents cut at the
    limit. ``share``: part of the documents that fit. Sums run inside blocks of lengths, and
    over the few block totals. The histogram is written first: it is read twice, its texts once.
    """
    counts = durable(counts, "lengths")
    block = F.floor(F.col("tokens") / _BLOCK)
    rows = counts.withColumn("block", block).withColumn("held", F.col("tokens") * F.col("documents"))
    totals = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("held").alias("t"))
    whole = Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "block",
        F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("base_d"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base_t"),
        F.sum("d").over(whole).alias("all_d"),
        F.sum("t").over(whole).alias("all_t"),
    )
    inside = Window.partitionBy("block").orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(bases, "block")
    fit_d = F.col("base_d") + F.sum("documents").over(inside)
    fit_t = F.col("base_t") + F.sum("held").over(inside)
    summed = summed.withColumn("fitting_documents", fit_d).withColumn("fitting_tokens", fit_t)
    longer_d = F.col("all_d") - F.col("fitting_documents")
    return summed.select(
        "tokens",
        "documents",
        "fitting_documents",
        "fitting_tokens",
        longer_d.alias("longer_documents"),
        (F.col("all_t") - F.col("fitting_tokens")).alias("longer_tokens"),
        (F.col("fitting_tokens") + longer_d * F.col("tokens")).alias("truncated_tokens"),
        (F.col("fitting_documents") / F.col("all_d")).alias("share"),
    )


def totals_at(table: DataFrame, limit: int | Column) -> DataFrame:
    """One row for any limit, also one that no document has: documents and tokens that fit, tokens after cutting."""
    at = F.lit(limit) if isinstance(limit, int) else limit
    below = F.col("tokens") <= at
    fit_d = F.coalesce(F.sum(F.when(below, F.col("documents"))), F.lit(0))
    fit_t = F.coalesce(F.sum(F.when(below, F.col("documents") * F.col("tokens"))), F.lit(0))
    beyond = F.coalesce(F.sum(F.when(~below, F.col("documents"))), F.lit(0))
    return table.agg(
        fit_d.alias("fitting_documents"), fit_t.alias("fitting_tokens"), (fit_t + beyond * at).alias("truncated_tokens")
    )


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(share, tokens)``: the smallest length within which at least ``share`` of the documents fit."""
    columns = [F.min(F.when(F.col("share") >= s, F.col("tokens"))).alias(str(i)) for i, s in enumerate(shares)]
    listed = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(str(i)).alias("tokens")) for i, s in enumerate(shares)]))
    return table.agg(*columns).select(listed.alias("row")).select("row.*")

