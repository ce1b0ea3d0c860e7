"""What Python workers keep between tasks, and giving it back.

Spark reuses its Python workers, so tables that one stage made for speed (powers for hashes, encoded
pieces, compressors) would lie in memory through all later ones.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from trackhouse.llm import bpe, language, toxicity, words

#: Small tasks per slot, and how long each waits, so that they run side by side in all idle workers.
ROUNDS, WAIT_S = 4, 0.05


def forget() -> None:
    """Drop this process's tables and hand free memory back to the system."""
    for kept in (words._powers, bpe._classes, bpe._values, bpe.encoder, bpe.tokenizer_from_json, bpe.tokenizer_from_ranks, language._compressors, toxicity._pair):
        kept.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # no glibc: memory goes back as the allocator sees fit


def release(spark: SparkSession) -> None:
    """Let the idle workers of every executor forget. Results never depend on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        forget()
        time.sleep(WAIT_S)
        yield from ()

    tasks = ROUNDS * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()
