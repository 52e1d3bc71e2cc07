"""Readers: delimited files, JSON records, captured payloads."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: characters kept from each end of a payload that does not parse.
QUARANTINE_CHARS = 1000


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, header: bool = True) -> DataFrame:
    """Delimited files. Types are inferred, at the cost of one more scan, only without a schema."""
    reader = spark.read.option("header", header)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(list(path) if not isinstance(path, str) else path)


def read_parts(
    spark: SparkSession, parts: Sequence[str], dictionary: str, name_column: str = "Name", schema_types: str | None = None
) -> DataFrame:
    """Headerless part files whose column names come from a single-byte encoded dictionary file.

    All parts are one scan. ``schema_types`` gives the comma-separated types in order;
    without it they are inferred. Dictionaries come in windows-1252, which Spark no longer
    decodes; ISO-8859-1 reads the same names (the two differ only in 0x80-0x9f).
    """
    names_table = (
        spark.read.option("header", True)
        .option("encoding", "iso-8859-1")
        .csv(dictionary)
        .select(F.trim(F.col(name_column)).alias("n"))
    )
    names = [r["n"] for r in names_table.collect()]  # one row per column of the parts
    if schema_types:
        kinds = [t.strip() for t in schema_types.split(",")]
        ddl = ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds))
        return read_csv(spark, parts, ddl, header=False)
    return read_csv(spark, parts, header=False).toDF(*names)


def _literal(path: str) -> str:
    """A found path as a pattern that matches only itself: readers take brackets, braces and wildcards for patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def latest_csv(spark: SparkSession, folder: str, header: bool = True) -> DataFrame:
    """All parts of the newest CSV report of a folder; older reports are listed but not read.

    A report is the run folder that the newest file lies in, or, where reports share one folder,
    the part files of one write (their names carry its id); a file of any other name stands alone.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
        .load(folder).select("path", "modificationTime")
    )
    newest = files.agg(F.max(F.struct("modificationTime", "path")).alias("last")).first()["last"]
    if newest is None:
        raise FileNotFoundError(f"no CSV file in {folder}")
    parent, _, name = newest["path"].rpartition("/")
    part = re.fullmatch(r"part-[0-9]+-([0-9a-f-]{36})[-.].*", name)
    if part:
        return read_csv(spark, f"{_literal(parent)}/part-*-{part[1]}*", header=header)
    return read_csv(spark, _literal(newest["path"]), header=header)


def json_fields(df: DataFrame, column: str) -> list[str]:
    """Union of the top-level keys of the JSON objects in a column, sorted.

    The key set is as small as the schema of the resulting table.
    """
    keys = df.select(F.explode(F.map_keys(F.from_json(column, "map<string,string>"))).alias("k")).distinct()
    return [r["k"] for r in keys.orderBy("k").collect()]


def json_table(df: DataFrame, column: str, keep: Sequence[str] = (), fields: Sequence[str] | None = None) -> DataFrame:
    """JSON objects of mixed kinds as columns; keys an object lacks are null, values stay text."""
    fields = list(fields) if fields is not None else json_fields(df, column)
    parsed = df.withColumn("_m", F.from_json(column, "map<string,string>"))
    return parsed.select(*keep, *[F.col("_m")[f].alias(f) for f in fields])


def json_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; without a schema the union of all keys and their types is inferred."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def payload_records(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split payload texts (JSON arrays of objects) into records and quarantined payloads.

    Records come as (keep..., record: map). A bad payload, one that is no bracketed array or
    does not parse, keeps its length and both ends.
    """
    text = F.trim(F.col(payload))
    framed = text.startswith("[") & text.endswith("]")
    parsed = df.withColumn("_records", F.when(framed, F.from_json(payload, "array<map<string,string>>")))
    good = parsed.where(F.col("_records").isNotNull()).select(*keep, F.explode("_records").alias("record"))
    bad = parsed.where(F.col("_records").isNull()).select(
        *keep,
        F.length(payload).alias("n_chars"),
        F.left(F.col(payload), F.lit(QUARANTINE_CHARS)).alias("head"),
        F.right(F.col(payload), F.lit(QUARANTINE_CHARS)).alias("tail"),
    )
    return good, bad
