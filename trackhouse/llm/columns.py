"""Small helpers around column names, Arrow batches and sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_with(df: DataFrame, added: dict[str, T.DataType]) -> T.StructType:
    """The schema of ``df`` with ``added`` columns; a column of the same name is replaced."""
    lower = {name.lower() for name in added}
    kept = [field for field in df.schema.fields if field.name.lower() not in lower]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in added.items()])


def batch_with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``added`` columns at its end, as ``schema_with`` orders them."""
    lower = {name.lower() for name in added}
    kept = [i for i, name in enumerate(batch.schema.names) if name.lower() not in lower]
    arrays = [batch.column(i) for i in kept] + list(added.values())
    return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + list(added))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array and ``len + 1`` bounds; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` units each, whole texts only, in order."""
    first = 0
    n = len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def batch_slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts hold about ``size`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0)
    bounds = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) + 16)])
    for first, last in slices(bounds, size):
        yield batch.slice(first, last - first)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one column scan."""
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0)


def buckets_for(amount: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``amount``; it grows with the input."""
    return max(least, math.ceil(amount / each))


def quoted(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
