"""What the operators of this subpackage share: reading, cutting lineage, and walking Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.checkpoints import cut, shared_folder  # noqa: F401
from weftline.sources.sinks import delete_folder as drop_folder  # noqa: F401

#: Bytes of text that a Python operator holds as numpy arrays at a time. One longer document is a slice of its own.
SLICE_BYTES = 1 << 18


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nested(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``row``, with columns of the operator's own beside it, so that no name of ``df`` can clash.

    Column names inside ``columns`` are those of ``df``.
    """
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in columns.items()])


def unnested(df: DataFrame, **columns: Column) -> DataFrame:
    """Back to the columns of the struct ``row``, and ``columns``, which replace those of their names."""
    fields = [f for f in df.schema["row"].dataType.names if f not in columns]
    return df.select(*[F.col("row")[f].alias(f) for f in fields], *[c.alias(k) for k, c in columns.items()])


def own_exchange(key: str) -> Column:
    """The long column ``key`` unchanged, as an expression that Spark takes for another one.

    A join of an aggregate by its key uses the aggregate's exchange, and adaptive execution splits a hot key only where both
    sides of a join come straight from exchanges of their own.
    """
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows and end) of consecutive rows; null texts are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    rows = len(column)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + rows + 1] if rows else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of raw bytes; ``offsets`` in elements of ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
