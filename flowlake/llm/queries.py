"""Registered results of the text operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import alignment, digest, ego, lm, mixing, packing, quality, secret_scan, simhash, token_counts, toxicity, warc, whitening
from flowlake.llm.rows import remainder
from flowlake.sources.durable import fresh_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def twin(name: str, sql: str) -> None:
    ORACLES[name] = sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.histogram(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts.context_table(counts)


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.clusters(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op6_embedding_dups(spark: SparkSession, folder: str) -> DataFrame:
    found = ego.near_duplicates(table(spark, folder, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


twin(
    "op6_embedding_dups",
    """
    WITH RECURSIVE vectors AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
    ), usable AS MATERIALIZED (
        SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS size FROM vectors
        WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b
        FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93
    ), reach(vec_id, other) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
    ), components AS (
        SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
    ), degrees AS (
        SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN components USING (vec_id) LEFT JOIN degrees USING (vec_id)
    """,
)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` in sequences of 4096 tokens, with a checksum of each piece's ids."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    planned = mixing.plan(docs)
    return planned.select(
        F.col(f"_column{docs.columns.index('doc_id')}").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.spans(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: ~s["linked"])

    def count(kind: str):
        return F.size(F.filter("found", lambda s: ~s["linked"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind) for kind in secret_scan.BASE],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("found")).alias("spans"),
    )


@query
def op4_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digest.neighbours(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = remainder(F.col("doc_id"), 5)
    model, counts = lm.train_model(docs.where(fold != 1).select("text"))
    scored = lm.score(docs, model, counts)
    return scored.select(
        F.col("id").alias("doc_id"),
        (remainder(F.col("id"), 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def _judged(scored: DataFrame, usable) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"),
        (~usable(F.col("id"))).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def quality_fold(key: Column) -> Column:
    """Rows whose quality label may be learnt from."""
    return remainder(key, 3) != 1


def toxic_fold(key: Column) -> Column:
    """Rows whose toxicity label may be learnt from."""
    return remainder(key, 5) != 0


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.learn_and_score(table(spark, folder, "documents"), table(spark, folder, "labels"), quality_fold)
    return _judged(scored, quality_fold)


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.learn_and_score(table(spark, folder, "documents"), table(spark, folder, "labels"), toxic_fold)
    return _judged(scored, toxic_fold)


@query
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = fresh_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive)
    return warc.read(spark, archive).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# five hexadecimal digits of the SHA-1 are four digits of base 32
twin(
    "op11_warc",
    """
    WITH hashed AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
    ), placed AS (
        SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS first_id
        FROM hashed WINDOW same AS (PARTITION BY payload ORDER BY page_id NULLS LAST)
    )
    SELECT page_id,
        strlen(payload)::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
        CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN place > 1 THEN first_id END AS refers_to
    FROM placed
    """,
)


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    # a sum of squares beyond 63 bits has no place in a bigint
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)")).withColumnRenamed("id", "vec_id")


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")
