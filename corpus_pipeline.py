"""From raw documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlake.llm import mixing, quality, secret_scan, simhash
from flowlake.llm.queries import packed, quality_fold, table
from flowlake.sources.durable import fresh_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the positive-unlabelled classifier accepts; null texts are scored as empty, without labels all are kept."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), quality_fold)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group: 3-word shingles, at most 3 differing bits, links followed through.

    Null, empty and blank texts have fingerprint zero and form one group; a row without id can be the one that stays.
    """
    return simhash.deduplicated(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; a null text stays null."""
    return secret_scan.redacted(docs)


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies, and one cut text a shard, that bring every source to its target; null is a source of its own."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; a null or empty text is its end token alone."""
    return packed(docs)


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("secret scans", harmless),
    ("mixing sources", balanced),
    ("packing", sequences),
]

# the first stage is a fitted classifier, the last a tokenizer and a dynamic program
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is written and read again. No documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
