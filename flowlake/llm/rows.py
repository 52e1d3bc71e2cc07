"""Small helpers shared by the text operators: Arrow kernels over chosen columns, word bytes, hash marks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that separate words everywhere in these operators.
WORD = r"[^\x20\x09-\x0D]+"


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under private names: extra columns, whatever they are called, cannot clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, null as the empty text."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [t or b"" for t in column.to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes know only ASCII letters and blanks."""
    return text.lower().split()


def field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def arrow_map(
    df: DataFrame,
    kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    fields: list[T.StructField],
) -> DataFrame:
    return df.mapInArrow(kernel, T.StructType(fields))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def once_per_worker(key: tuple, make: Callable):
    """What ``make`` builds, kept for the life of the worker process: task functions themselves arrive anew with each task."""
    kept = vars(sys.modules.setdefault("flowlake_worker_state", ModuleType("flowlake_worker_state")))
    if key not in kept:
        kept[key] = make()
    return kept[key]
