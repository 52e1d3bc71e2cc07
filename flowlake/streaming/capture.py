"""Stream capture: bounded drains of a topic, continuous receipt of payloads, receive rates."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from flowlake.operators.clean import (
    CAPTURE_DROPS_FIRST,
    CAPTURE_DROPS_SECOND,
    drop_columns,
    fill_then_drop,
    label_flag_last,
    numeric_order,
)
from flowlake.sources.readers import json_fields, json_table, payload_records

# Fixed value: messages per bounded read of the topic.
DRAIN_MESSAGES = 10_000
# Fixed value: seconds without a message after which a drain ends.
IDLE_SECONDS = 30.0


def message_stream(spark: SparkSession, transport: str = "kafka", limit: int = DRAIN_MESSAGES, **options: str) -> DataFrame:
    """Messages as a ``value`` text stream, from the earliest on.

    ``kafka`` needs the connector on the classpath and its usual options (servers, topic);
    ``files`` reads text files of a folder, one message per line.
    """
    if transport == "kafka":
        source = (
            spark.readStream.format("kafka")
            .option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", limit)
            .options(**options)
            .load()
        )
        return source.select(F.col("value").cast("string").alias("value"), "timestamp", "partition", "offset")
    if transport == "files":
        return spark.readStream.format("text").option("maxFilesPerTrigger", options.pop("files", "1000")).load(
            options["path"]
        )
    raise ValueError(f"unknown transport {transport}")


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything available now in bounded batches, then stop; the checkpoint remembers the place."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def clean_capture(
    messages: DataFrame, order: Sequence[str], fields: Sequence[str] | None = None, labelled: int = 10
) -> DataFrame:
    """Captured messages to a labelled table: columns, both drop lists, fill in order, label.

    ``order`` names message fields (the last one unique) that define the time order: numbers by
    value (whole numbers of up to 38 digits exactly), other texts after them by code point.
    """
    rows = json_table(messages, "value", fields=fields)
    kept = drop_columns(drop_columns(rows, CAPTURE_DROPS_FIRST), CAPTURE_DROPS_SECOND)
    keys: list[Column] = []
    for c in order:
        text = F.col(f"`{c}`")
        keys += [*[n.asc_nulls_last() for n in numeric_order(text)], text.asc()]
    filled = fill_then_drop(kept, kept.columns, keys)
    return label_flag_last(filled, order, labelled)


def capture_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One bounded capture: every batch lands its raw messages under its own batch partition."""

    return drain(stream, _landing(path), checkpoint)


def _landing(path: str) -> Callable[[DataFrame, int], None]:
    def handle(batch: DataFrame, number: int) -> None:
        # overwriting the batch's own folder makes a replayed batch harmless
        batch.select("value").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


class Idleness(StreamingQueryListener):
    """When a query last received rows, as its progress events tell."""

    def __init__(self) -> None:
        self.rows = 0
        self.since = time.monotonic()

    def onQueryStarted(self, event) -> None:
        self.since = time.monotonic()

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows > 0:
            self.rows += event.progress.numInputRows
            self.since = time.monotonic()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def capture_until_idle(
    stream: DataFrame, path: str, checkpoint: str, idle_seconds: float = IDLE_SECONDS, limit: int | None = DRAIN_MESSAGES
) -> int:
    """Capture as messages arrive and stop by itself once none came for ``idle_seconds``, or ``limit`` have been taken.

    Returns the number of messages of this drain. Where it stops at the limit, the batch it is in is finished first.
    """
    spark = stream.sparkSession
    watch = Idleness()
    spark.streams.addListener(watch)
    try:
        query = stream.writeStream.foreachBatch(_landing(path)).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
        # looks a few times per idle span, and ends early only with the query itself
        while not query.awaitTermination(min(1.0, idle_seconds / 4)):
            if time.monotonic() - watch.since > idle_seconds and not query.status["isTriggerActive"]:
                break
            if limit is not None and watch.rows >= limit:
                break
        query.stop()
    finally:
        spark.streams.removeListener(watch)
    return watch.rows


def captured(
    spark: SparkSession, path: str, order: Sequence[str], fields: Sequence[str] | None = None, labelled: int = 10
) -> DataFrame:
    """The table of all messages landed under ``path`` so far, whatever the batches they came in.

    Columns, fill and label come from the whole capture: one key set, values carried across
    batches, the last ``labelled`` messages of all. Before any message has landed it is empty, with the
    columns of ``fields`` (``order`` without them) as text.
    """
    try:
        messages = spark.read.schema("value string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        messages = spark.createDataFrame([], "value string")
    if fields is None:
        fields = json_fields(messages, "value") or order
    return clean_capture(messages, order, fields, labelled)


def receive(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Continuous receipt: records of good payloads to ``records``, ends of bad ones to ``quarantine``.

    ``stream`` has one payload text per row in ``value``.
    """

    def handle(batch: DataFrame, number: int) -> None:
        arrived = batch.withColumn("received_at", F.current_timestamp())
        good, bad = payload_records(arrived, "value", ["received_at"])
        good.write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def payload_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Folder of payload files, one payload per file."""
    return (
        spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files).load(path)
    )


def receive_rate(df: DataFrame, payload: str, time: str, window: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """Messages, bytes and MB/s per tumbling window of arrival time; batch or streaming.

    A streaming input needs ``lateness``, its watermark.
    """
    rows = df.withColumn("_at", F.col(time).cast("timestamp"))
    if lateness:
        rows = rows.withWatermark("_at", lateness)
    span = F.window("_at", window)
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return (
        rows.groupBy(span.alias("w"))
        .agg(F.count("*").alias("n_messages"), F.sum(F.octet_length(payload)).alias("n_bytes"))
        .select(
            F.col("w.start").alias("window_start"),
            "n_messages",
            "n_bytes",
            (F.col("n_bytes") / F.lit(1048576.0) / seconds).alias("mb_per_second"),
        )
    )
