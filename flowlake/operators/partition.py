"""Assign rows to clients by position, with sizes that follow a law of the client id."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.ordering import with_rank

# share of client i (0-based) under each law
SIZE_LAWS = {
    "uniform": lambda i: 1.0,
    "linear": lambda i: float(i + 1),
    "square": lambda i: float((i + 1) ** 2),
    "exponential": lambda i: math.exp(i),
}


def assign_clients(
    df: DataFrame, order: Sequence[str | Column], clients: int, law: str = "uniform", out: str = "client"
) -> DataFrame:
    """Contiguous blocks by ``order``.

    ``uniform`` gives floor(rank * clients / n). The other laws give client i the floor of
    its share, and the leftover rows to the last client, which is the largest.
    """
    ranked = with_rank(df, order, out="_rank", size="_n")
    if law == "uniform":
        client = F.floor(F.col("_rank") * F.lit(clients) / F.col("_n"))
    else:
        shares = [SIZE_LAWS[law](i) for i in range(clients)]
        total = sum(shares)
        end: Column = F.lit(0)
        client = F.lit(0)
        for share in shares[:-1]:
            end = end + F.floor(F.col("_n") * F.lit(share) / F.lit(total))
            client = client + (F.col("_rank") >= end).cast("int")
    return ranked.withColumn(out, client.cast("int")).drop("_rank", "_n")
