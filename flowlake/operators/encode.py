"""Category and label codes as tables; lookups as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.ordering import with_rank
from flowlake.sources.durable import counted_broadcast, durable

# Traffic class names by id.
CLASS_NAMES = {
    0: "Normal",
    1: "Generic",
    2: "Exploits",
    3: "Reconnaissance",
    4: "Fuzzers",
    5: "DoS",
    6: "Analysis",
    7: "Backdoor",
    8: "Backdoors",
    9: "Worms",
    10: "Shellcode",
}


def _pairs(columns: Sequence[str]) -> Column:
    """The category columns of a row as (column, value) pairs."""
    return F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])


def fit_codes(df: DataFrame, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Code table (column, value, code), in order of first appearance by ``order``.

    Without an order column the codes are alphabetical.
    """
    first = F.col(order) if order else F.lit(0)
    seen = (
        df.select(F.explode(_pairs(columns)).alias("p"), first.alias("_at"))
        .select("p.column", "p.value", "_at")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.min("_at").alias("_at"))
    )
    return with_rank(seen, ["_at", "value"], ["column"], out="code").select("column", "value", "code")


def encode(df: DataFrame, codes: DataFrame, columns: Sequence[str], unknown: int = -1) -> DataFrame:
    """Replace category values by their code; unseen and null values get ``unknown``."""
    for c in columns:
        dim = codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = (
            df.join(counted_broadcast(dim), F.col(c).cast("string") == F.col("_value"), "left")
            .withColumn(c, F.coalesce(F.col("_code"), F.lit(unknown)))
            .drop("_value", "_code")
        )
    return df


def fit_labels(df: DataFrame, label: str) -> DataFrame:
    """Sorted label codes (value, code) by code point."""
    distinct = df.select(F.col(label).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_rank(distinct, ["value"], out="code")


def encode_label(df: DataFrame, codes: DataFrame, label: str, out: str = "label_code") -> DataFrame:
    """Label code per row, -1 for a label the fit never saw."""
    dim = codes.select(F.col("value").alias("_value"), F.col("code").alias(out))
    return (
        df.join(counted_broadcast(dim), F.col(label).cast("string") == F.col("_value"), "left")
        .drop("_value")
        .withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
    )


def class_name(code: str | Column, names: Mapping[int, str] = CLASS_NAMES) -> Column:
    """Name of a class id, ``unknown_<id>`` outside the map."""
    c = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(x) for item in names.items() for x in item]
    named = F.try_element_at(F.create_map(*pairs), c.cast("int"))
    return F.coalesce(named, F.concat(F.lit("unknown_"), c.cast("string")))


def unique_labels(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels, one row each."""
    return df.select(label).distinct().orderBy(label)


def leaky_categories(
    df: DataFrame, columns: Sequence[str], label: str, share: float = 0.9, max_values: int = 9
) -> DataFrame:
    """Values of low-cardinality columns that almost determine the label.

    A column qualifies with 2 to ``max_values`` values (null counts as one of them, as a
    value it is not reported); a value is reported when one label has more than ``share`` of its rows.
    """
    cells = (
        df.select(F.explode(_pairs(columns)).alias("p"), F.col(label).alias("_label"))
        .groupBy("p.column", "p.value", "_label")
        .agg(F.count("*").alias("_c"))
    )
    values = cells.groupBy("column", "value").agg(
        F.sum("_c").alias("n_rows"),
        F.max("_c").alias("_top"),
        F.max_by("_label", F.struct(F.col("_c"))).alias("top_label"),
    )
    values = durable(values, "values")
    cardinality = values.groupBy("column").agg(F.count("*").alias("_values"))
    # one row per named column
    return (
        values.join(F.broadcast(cardinality), "column")
        .where(F.col("_values").between(2, max_values) & F.col("value").isNotNull())
        .withColumn("label_share", F.col("_top") / F.col("n_rows"))
        .where(F.col("label_share") > share)
        .select("column", "value", "top_label", "n_rows", "label_share")
    )


def class_weights_join(
    df: DataFrame, weights: DataFrame, label: str, out: str = "weight", by: Sequence[str] = (), known: DataFrame | None = None
) -> DataFrame:
    """Attach the class weight to each row; ``weights`` holds one row per class (and ``by`` group).

    ``known`` is a written table with as many rows as ``weights``, to be counted in its place.
    """
    dim = weights.select(*[F.col(c).alias(f"_at_{c}") for c in by], F.col(label).alias("_class"), F.col("weight").alias(out))
    on = df[label] == F.col("_class")
    for c in by:
        on = on & df[c].eqNullSafe(F.col(f"_at_{c}"))
    return df.join(counted_broadcast(dim, known=known), on, "inner").drop("_class", *[f"_at_{c}" for c in by])


def require_labels(df: DataFrame, label: str, classes: int | None = None) -> DataFrame:
    """``df`` itself, after one count has shown that every label lies in 0..classes-1 (or is not negative).

    Training on an unseen label's -1 would silently train the last class.
    """
    value = F.col(label).cast("int")
    outside = value.isNull() | (value < 0)
    if classes is not None:
        outside = outside | (value >= classes)
    refuse_labels(df.where(outside).count(), label)
    return df


def refuse_labels(bad: int, label: str) -> None:
    """An error if any rows (``bad`` of them) have no label of the classes."""
    if bad:
        raise ValueError(f"{bad} rows have a label in {label} that is null or outside the classes; drop or map them first")
