"""Sinks: run-stamped tables, JSON records, predictions, metrics and run histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "run string, round int, timestamp string, metric string, value double"


def run_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def write_run(df: DataFrame, path: str, stamp: str | None = None, form: str = "csv") -> str:
    """Append the table under a ``run_ts`` partition; returns the stamp."""
    stamp = stamp or run_stamp()
    writer = df.withColumn("run_ts", F.lit(stamp)).write.mode("append").partitionBy("run_ts")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
    return stamp


def json_records(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Each row as one JSON object text."""
    return F.to_json(F.struct(*(columns or df.columns)))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_predictions(scored: DataFrame, path: str, round_number: int) -> None:
    """Predictions of one round: label, name and, where known, truth and probabilities."""
    wanted = ("predicted_label", "prediction_type", "prediction_score", "probs", "true_label")
    keep = [c for c in wanted if c in scored.columns]
    scored.select(*keep, F.lit(round_number).alias("round")).write.mode("append").partitionBy("round").parquet(path)


def write_metrics(spark: SparkSession, path: str, run: str, round_number: int, metrics: Mapping[str, float]) -> None:
    """One long row per metric of a round, stamped with the time."""
    now = datetime.now(timezone.utc).isoformat()
    rows = [(run, round_number, now, name, float(value)) for name, value in metrics.items()]
    spark.createDataFrame(rows, METRIC_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def write_history(history: DataFrame, path: str, run: str) -> None:
    """Append a (source, round, metric, value) table under its run."""
    history.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def read_history(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.where(F.col("run") == run) if run else table
