"""Session set-up and the shared folder for tables that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# One scratch folder per local application, used only when the cluster names none.
_local_folders: dict[str, str] = {}


def build_session(app: str = "flowlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on (adaptive plans, skew joins, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the cluster sets it.

    A local session (tests, bench) that sets none gets a scratch folder of its own; on a
    cluster a missing setting is an error, never a machine-local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="flowlake-")
    return _local_folders[app]


def shuffle_width(spark: SparkSession) -> int:
    """Number of slices for range layouts: the session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
