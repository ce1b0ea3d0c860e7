"""Directory trees listed by tasks, without an index on the driver.

A round deals the directories that are still open over tasks. A task lists each of them and goes on
into what it finds, breadth first, until it has listed a set number of directories; what is left
open goes back and is dealt anew, so one deep or wide branch is shared out among all tasks. The
driver only learns how many directories are open. Every round is written before the next begins.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackhouse.session import durable
from trackhouse.sources.storage import filesystem

#: Directories that a task lists before it hands on the rest: few at first, so that work spreads.
FIRST_ROUND, LATER_ROUNDS = 32, 512
#: Directories that a task gets to start from where there are very many.
SHARE = 64
#: Files in a batch that goes to Spark.
BATCH = 20_000

#: A row is a file, or, without a name, a directory that is still open.
ENTRIES = "dir string, name string, length bigint, modified timestamp"
_ARROW = pa.schema([("dir", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def _is_link(store: fs.FileSystem, path: str) -> bool:
    return isinstance(store, fs.LocalFileSystem) and os.path.islink(path)


def _files(folder: str, found: list[fs.FileInfo]) -> pa.RecordBatch:
    sizes = np.array([f.size for f in found], np.int64)
    times = np.array([f.mtime_ns // 1000 for f in found], np.int64)
    names = pa.array([f.base_name for f in found], pa.string())
    where = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(found), np.int32)), pa.array([folder])).cast(pa.string())
    return pa.RecordBatch.from_arrays([where, names, pa.array(sizes), pa.array(times).cast(pa.timestamp("us", "UTC"))], schema=_ARROW)


def _opened(folders: list[str]) -> pa.RecordBatch:
    empty = [pa.nulls(len(folders), kind) for kind in _ARROW.types[1:]]
    return pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), *empty], schema=_ARROW)


def _lister(root: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(root)
        place = place.rstrip("/")
        spent = 0
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting = deque(batch.column(0).to_pylist())
            # A directory that was dealt is always listed; those found on the way only as far as the share goes.
            due = len(waiting)
            while waiting and (due > 0 or spent < most):
                folder = waiting.popleft()
                due -= 1
                spent += 1
                files = []
                for entry in store.get_file_info(fs.FileSelector(f"{place}/{folder}" if folder else place or "/")):
                    if entry.type == fs.FileType.File:
                        files.append(entry)
                    elif entry.type == fs.FileType.Directory and not _is_link(store, entry.path):
                        waiting.append(f"{folder}/{entry.base_name}" if folder else entry.base_name)
                if files:
                    held.append(_files(folder, files))
                    n += len(files)
                if n >= BATCH:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
            if waiting:
                yield _opened(list(waiting))
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``dir, name, length, modified`` of every file below ``root``, whatever its name or size.

    ``dir`` is relative to ``root``. Links to directories are not followed. The tree is listed when
    this is called and then read from the written copy. A directory's own entries are listed at once
    by one task.
    """
    store, place = filesystem(root)
    if store.get_file_info(place).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no directory {root}")
    rounds = []
    waiting, n, most = spark.range(1).select(F.lit("").alias("dir")), 1, FIRST_ROUND
    while n:
        tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-n // SHARE)))
        dealt = waiting if n == 1 else waiting.repartition(tasks)
        rounds.append(durable(dealt.mapInArrow(_lister(root, most), ENTRIES)))
        waiting = rounds[-1].where("name IS NULL").select("dir")
        n, most = waiting.count(), LATER_ROUNDS
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionAll(more)
    return out.where("name IS NOT NULL")
