"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows of one side of a join up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000

#: Name of the content key that operators add; a prefix that no table is expected to have.
KEY = "__llm_key"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def content_key(*columns: str) -> Column:
    """SHA-256 over the given columns, nulls told apart from empty strings.

    It depends on content alone, so it names the same row in every recomputation; rows that agree in all
    the columns share it and get the same decisions.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def small(df: DataFrame) -> DataFrame:
    """A staged ``df``, marked for broadcast if a count shows that it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def checked_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a staged ``right``: broadcast if a count shows it small, else shuffled. The rows are the same."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copying, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column holds about ``most`` bytes in each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rows_of(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The column's texts as bytes, one row at a time."""
    data, at = utf8(column(batch, name))
    view = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield view[a:b]
