"""Byte-level BPE over DataFrames: texts to ids (with offsets) and ids back to bytes.

Ids travel as binary columns of little-endian unsigned 32-bit numbers: a third of the size of an
array column and ready to be hashed, stored or viewed by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackhouse.llm import bpe
from trackhouse.llm.columns import batch_slices, batch_with, schema_with


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every token of a rank file one after another, and where each begins."""
    ranks = bpe.read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return np.frombuffer(b"".join(tokens), np.uint8), bounds


def token_bytes(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ``ids`` in a row, and the border of each token in them."""
    held, bounds = byte_table(path)
    if len(ids) and int(ids.max()) >= len(bounds) - 1:
        raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {len(bounds) - 1} tokens")
    first = bounds[ids]
    closes = np.concatenate([[0], np.cumsum(bounds[ids + 1] - first)])
    return held[np.repeat(first - closes[:-1], np.diff(closes)) + np.arange(closes[-1])], closes


def char_offsets(data: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token; the parts of a character that is split
    over tokens all carry that character."""
    chars = np.cumsum((data & 0xC0) != 0x80)
    return chars[closes[:-1]] - 1, chars[closes[1:] - 1]


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column over ``data`` cut at ``bounds`` (in bytes), without a copy per row."""
    buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``; with ``offsets`` also ``char_start`` and ``char_end``.

    ``path`` names a rank file (``.tiktoken``) or a tokenizer file. Null and empty texts have no
    ids. Every row is kept; columns of these names are replaced. A text is encoded whole, in the
    task that reads it: no shuffle. ``offsets`` needs a rank file.
    """
    added: dict[str, T.DataType] = {"n_tokens": T.LongType(), "ids": T.BinaryType()}
    if offsets:
        added |= {"char_start": T.ArrayType(T.IntegerType()), "char_end": T.ArrayType(T.IntegerType())}
    kept = docs if keep_text else docs.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = bpe.encoder(path)
        for batch in batches:
            for part in batch_slices(batch, text, bpe.SLICE):
                column = part.column(part.schema.names.index(text))
                found = library.encode([x or "" for x in column.to_pylist()])
                values = {"n_tokens": pa.array(np.diff(found.bounds)), "ids": _binary(found.ids, found.bounds * 4)}
                if offsets:
                    data, closes = token_bytes(found.ids, path)
                    begin, end = char_offsets(data, closes)
                    base = begin[np.minimum(found.bounds[:-1], max(0, len(begin) - 1))] if len(begin) else begin
                    shift = np.repeat(base, np.diff(found.bounds)) if len(begin) else 0
                    cuts = pa.array(found.bounds.astype(np.int32))
                    for name, at in (("char_start", begin), ("char_end", end)):
                        values[name] = pa.ListArray.from_arrays(cuts, pa.array((at - shift).astype(np.int32)))
                if not keep_text:
                    part = part.drop_columns([text])
                yield batch_with(part, values)

    return docs.mapInArrow(run, schema_with(kept, added))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids by a rank file. Null ids give no bytes.

    Bytes, not text: ids cut anywhere may end inside a character, which ``decode_text`` mends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids)).cast(pa.large_binary())
            raw, bounds = utf8_like(column)
            for first in range(0, len(bounds) - 1, 512):
                last = min(first + 512, len(bounds) - 1)
                part = np.frombuffer(raw[bounds[first] : bounds[last]].tobytes(), np.uint32)
                data, closes = token_bytes(part, path)
                cuts = closes[(bounds[first : last + 1] - bounds[first]) // 4]
                yield batch_with(batch.slice(first, last - first), {"decoded": _binary(data, cuts)})

    return encoded.mapInArrow(run, schema_with(encoded, {"decoded": T.BinaryType()}))


def utf8_like(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a binary column; null is empty."""
    if column.null_count:
        column = pa.array([x or b"" for x in column.to_pylist()], pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)), bounds


def decode_text(ids: np.ndarray, path: str) -> str:
    """Text of some ids; a character whose bytes are cut off at an end becomes U+FFFD."""
    return token_bytes(ids, path)[0].tobytes().decode("utf-8", errors="replace")


