"""Tables written to the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.session import shared_folder, shuffle_width

# How tables of blocks (few rows of many bytes) are written: row groups and pages end by size, not after a hundred rows.
BLOCK_OPTIONS = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
# A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/flowlake/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside delete their shuffle files as they end, not whenever the driver collects garbage.

    For chains of written tables: disk holds the tables and one query's shuffles, not those of all queries so far.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Slots:
    """Two alternating tables for state that is rewritten every round.

    Writing slot B reads only slot A, so the next write may overwrite A: disk use stays at
    two copies however many rounds run.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._base = fresh_path(spark, name)
        self._turn = 0

    def put(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self._base}/slot{self._turn}"
        self._turn = 1 - self._turn
        schema = df.schema
        df.write.mode("overwrite").options(**options).parquet(path)
        return self._spark.read.schema(schema).parquet(path)


def counted_broadcast(dim: DataFrame, limit: int = BROADCAST_ROWS, known: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast when ``dim`` is proven to hold at most ``limit`` rows.

    ``dim`` should be a written or otherwise cheap table: it is counted (up to the limit)
    first, or ``known``, the written table that it has the rows of. Beyond the limit the join stays
    a shuffle join, where adaptive skew handling splits hot keys.
    """
    counted = dim if known is None else known
    return F.broadcast(dim) if counted.limit(limit + 1).count() <= limit else dim


def spread(df: DataFrame) -> DataFrame:
    """Even partitions for a table that many row-wise passes will read: one shuffle up front."""
    spark = df.sparkSession
    return df.repartition(max(shuffle_width(spark), spark.sparkContext.defaultParallelism))


def gathered(df: DataFrame) -> DataFrame:
    """No more tasks than a few per core, without a shuffle, for passes whose tasks each emit a fixed-size summary.

    The summaries are what is shuffled, so their number should follow the cluster, not the data.
    """
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
