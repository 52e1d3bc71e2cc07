"""Fitted preprocessing state: fitted once, stored as small tables, applied to any table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.numeric import finite
from flowlake.operators.clean import cap_outliers, drop_columns, impute, standard_label
from flowlake.operators.encode import encode, encode_label, fit_codes, fit_labels
from flowlake.operators.profile import numeric_stats, range_stats

# Feature columns of the two table kinds.
RAW_CATEGORIES = "proto service state is_ftp_login is_sm_ips_ports".split()
RAW_NUMBERS = (
    "dur spkts dpkts sbytes dbytes rate sttl dttl sload dload sloss dloss sinpkt dinpkt sjit djit swin stcpb dtcpb "
    "dwin tcprtt synack ackdat smean dmean trans_depth response_body_len ct_srv_src ct_state_ttl ct_dst_ltm "
    "ct_src_dport_ltm ct_dst_sport_ltm ct_dst_src_ltm ct_ftp_cmd ct_flw_http_mthd ct_src_ltm ct_srv_dst"
).split()
ENGINEERED_NUMBERS = (
    "dur sbytes dbytes Sload swin smeansz Sjit Stime ct_srv_src ct_srv_dst ct_dst_ltm ct_src_ltm ct_dst_src_ltm "
    "duration jit_ratio inter_pkt_ratio tcp_setup_ratio byte_pkt_interaction_dst load_jit_interaction_dst tcp_seq_diff"
).split()


@dataclass
class Processor:
    """Category codes, number statistics and label codes.

    ``engineered`` tables are scaled already: only missing values become 0.
    """

    categories: list[str]
    numbers: list[str]
    engineered: bool
    codes: DataFrame | None
    stats: DataFrame
    labels: DataFrame | None

    @staticmethod
    def fit(
        df: DataFrame,
        categories: Sequence[str] = (),
        numbers: Sequence[str] = (),
        engineered: bool = False,
        order: str | None = None,
        label: str = "label",
        split: str | None = "split",
    ) -> Processor:
        """Fit on the training rows (``split = 'train'`` when there is a split column)."""
        df = standard_label(df)
        if split and split in df.columns:
            df = df.where(F.col(split) == "train")
        categories = [] if engineered else [c for c in categories if c in df.columns]
        numbers = [c for c in numbers if c in df.columns]
        text_label = label in df.columns and df.schema[label].dataType.simpleString() == "string"
        return Processor(
            categories,
            numbers,
            engineered,
            fit_codes(df, categories, order) if categories else None,
            range_stats(df, numbers) if engineered else numeric_stats(df, numbers),
            fit_labels(df, label) if text_label else None,
        )

    def transform(self, df: DataFrame, label: str = "label") -> DataFrame:
        """Rename the label, drop the id, encode categories, cap and fill numbers, encode a text label."""
        df = drop_columns(standard_label(df), ["id"])
        if self.codes is not None:
            df = encode(df, self.codes, [c for c in self.categories if c in df.columns])
        numbers = [c for c in self.numbers if c in df.columns]
        if self.engineered:
            df = impute(df, dict.fromkeys(numbers, 0))
        else:
            fitted = {r["column"]: r for r in self.stats.collect()}  # one row per number column
            df = df.withColumns({c: finite(c).cast(df.schema[c].dataType) for c in numbers})
            df = cap_outliers(df, {c: fitted[c]["q99"] for c in numbers})
            df = impute(df, {c: fitted[c]["median"] for c in numbers})
        if self.labels is not None and label in df.columns:
            df = encode_label(df, self.labels, label, "_code").withColumn(label, F.col("_code")).drop("_code")
        return df

    def save(self, path: str, force: bool = False) -> None:
        """Store under ``path``; an existing state is kept unless ``force``."""
        mode = "overwrite" if force else "errorifexists"
        spark = self.stats.sparkSession
        columns = [("category", c) for c in self.categories] + [("number", c) for c in self.numbers]
        meta = [(i, kind, c, self.engineered) for i, (kind, c) in enumerate(columns)]
        spark.createDataFrame(meta, "pos int, kind string, column string, engineered boolean").coalesce(1).write.mode(
            mode
        ).parquet(f"{path}/columns")
        self.stats.write.mode(mode).parquet(f"{path}/num_stats")
        empty = spark.createDataFrame([], "column string, value string, code bigint")
        (self.codes if self.codes is not None else empty).write.mode(mode).parquet(f"{path}/code_map")
        labels = self.labels if self.labels is not None else spark.createDataFrame([], "value string, code bigint")
        labels.write.mode(mode).parquet(f"{path}/label_map")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Processor:
        columns = spark.read.parquet(f"{path}/columns").orderBy("pos").collect()
        codes, labels = spark.read.parquet(f"{path}/code_map"), spark.read.parquet(f"{path}/label_map")
        return Processor(
            [r["column"] for r in columns if r["kind"] == "category"],
            [r["column"] for r in columns if r["kind"] == "number"],
            bool(columns and columns[0]["engineered"]),
            None if codes.isEmpty() else codes,
            spark.read.parquet(f"{path}/num_stats"),
            None if labels.isEmpty() else labels,
        )
