"""Compression as a yardstick: how short a window of text becomes beside a dictionary."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackhouse.llm.columns import quoted

#: Lower case, and every white space sign a space, so that words match wherever they stand.
FOLD = bytes(0x20 if b in b"\t\n\v\f\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Search settings that find nearly every match of a short window.
THOROUGH = {"strategy": zs.STRATEGY_BTLAZY2, "min_match": 5, "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 6}
#: Least shingle hashes of a text that near copies are known by.
SKETCH = 8


def compressor(content: bytes, settings: dict) -> zs.ZstdCompressor:
    """A compressor with ``content`` as raw history; frames carry no size, checksum or number."""
    params = zs.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **settings)
    if not content:
        return zs.ZstdCompressor(compression_params=params)
    history = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    history.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(compression_params=params, dict_data=history)


def windows(raw: bytes, size: int) -> Iterator[bytes]:
    """All of a text in windows of at least ``size`` bytes, cut before a space; each begins with one.

    Text without spaces is cut at twice the size all the same, so windows stay bounded.
    """
    at, n = 0, len(raw)
    while at < n:
        end = raw.find(b" ", at + size, at + 2 * size)
        if end < 0:
            end = min(n, at + 2 * size)
        part = raw[at:end]
        yield part if part[:1] == b" " else b" " + part
        at = end


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(quoted(id_col).cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(rows: DataFrame, id_col: str, label: str, most: dict) -> DataFrame:
    """Rows by a hash of their id so that about ``most[value]`` of each label are left; where a
    label has fewer, all. ``most`` bounds what later goes to the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(quoted(label)).count().collect()}
    keep = F.lit(False)
    share = F.pmod(F.xxhash64(quoted(id_col), F.lit(97)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    for value, n in counts.items():
        if value is not None:
            bound = most.get(value, most.get("*", 0))
            keep = keep | ((quoted(label) == F.lit(value)) & (share < min(1.0, bound / n)))
    return rows.where(keep)


def unlike(texts: Iterable[str]) -> Iterator[list[str]]:
    """The words of every text that is no near copy of earlier ones: of the ``SKETCH`` least hashes of
    its three-word shingles fewer than half were among theirs. One shared phrase folds nothing."""
    seen: set[int] = set()
    for text in texts:
        words = text.split()
        marks = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:SKETCH]
        if 2 * len(seen.intersection(marks)) < len(marks):
            yield words
        seen.update(marks)


def logistic(features: np.ndarray, truth: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression (the first is the constant), by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.05
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (truth - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return w
