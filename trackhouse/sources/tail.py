"""A streaming source that follows growing text files on any file system.

Spark's file stream reads each file once; a run log keeps growing. The offset of a file is the byte
after its last complete line, with short digests of its first 1, 2, 4, ... bytes. So each line is
delivered exactly once, a line still being written is held back, and a file that was replaced, be it
shorter or longer than before, is known by its beginning and read from its start.

Usage: ``spark.dataSource.register(TailSource)``, then
``spark.readStream.format("tail").option("path", "hdfs:///runs/*/events.jsonl").load()``.
``maxBytesPerBatch`` bounds what a micro-batch takes. Spark does not tell a Python source where it
stopped before a restart, so the first micro-batch after one takes all that is new; and with the
``availableNow`` trigger a run ends where its first budget does, so leave the budget out there.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trackhouse.sources.storage import filesystem

SLICE = 32 << 20
BLOCK = 64 << 10
#: Longest beginning of a file that is compared, and bytes of a digest.
HEAD, DIGEST = 1024, 4
WILD = "*?["


@dataclass
class Slice(InputPartition):
    """Lines of ``path`` that start in ``[start, stop)``."""

    path: str
    begin: int
    start: int
    stop: int


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, pos bigint, line string"

    def streamReader(self, schema) -> TailReader:
        budget = self.options.get("maxBytesPerBatch")
        return TailReader(self.options["path"], int(budget) if budget else None)


class TailReader(DataSourceStreamReader):
    """An offset maps paths to ``{"at": bytes delivered, "head": digests}``."""

    def __init__(self, pattern: str, budget: int | None = None) -> None:
        self.pattern, self.budget = pattern, budget
        #: Where the last planned micro-batch ends, once known.
        self.reached: dict | None = None

    def initialOffset(self) -> dict:
        self.reached = {}
        return {}

    def latestOffset(self) -> dict:
        known = self.reached if self.budget is not None and self.reached is not None else None
        left = self.budget
        end = {}
        for path in matching(self.pattern):
            now = state_of(path)
            if known is not None:
                begin = resumed(known.get(path), now)
                if now["at"] - begin > left:
                    # Whole lines only, and at least one line of the first file that has any.
                    now = state_of(path, begin, begin + left, least=1 if left == self.budget else 0)
                left = max(0, left - (now["at"] - begin))
            end[path] = now
        self.reached = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.reached = end
        slices = []
        for path, now in end.items():
            begin = resumed(start.get(path), now)
            slices += [Slice(path, begin, at, min(at + SLICE, now["at"])) for at in range(begin, now["at"], SLICE)]
        return slices

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        places, lines = [], []
        size = 0
        with opened(part.path) as f:
            if part.start > part.begin:
                # A line that began in the slice before belongs to that slice.
                f.seek(part.start - 1)
                f.readline()
            else:
                f.seek(part.start)
            while (at := f.tell()) < part.stop:
                raw = f.readline()
                if not raw.endswith(b"\n"):
                    break
                places.append(at)
                lines.append(raw[:-1].decode("utf-8", "replace"))
                size += len(raw)
                if size >= BLOCK * 64:
                    yield _batch(part.path, places, lines)
                    places, lines, size = [], [], 0
        if lines:
            yield _batch(part.path, places, lines)

    def commit(self, end: dict) -> None:
        self.reached = self.reached if self.reached is not None else end


def _batch(path: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path] * len(lines), "pos": pa.array(places, pa.int64()), "line": lines})


def opened(path: str) -> io.BufferedReader:
    store, place = filesystem(path)
    return io.BufferedReader(store.open_input_file(place), BLOCK)


def matching(pattern: str) -> list[str]:
    """The files that fit a pattern of ``*``, ``?`` and ``[]`` in any part of the path, sorted."""
    parts = pattern.split("/")
    wild = next((i for i, part in enumerate(parts) if any(c in part for c in WILD)), len(parts))
    found = ["/".join(parts[:wild])]
    for depth in range(wild, len(parts)):
        last = depth == len(parts) - 1
        more = []
        for folder in found:
            store, place = filesystem(folder or "/")
            for entry in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                kind = fs.FileType.File if last else fs.FileType.Directory
                if entry.type == kind and fnmatch.fnmatchcase(entry.base_name, parts[depth]):
                    more.append(f"{folder}/{entry.base_name}")
        found = more
    if wild == len(parts):
        store, place = filesystem(pattern)
        found = [p for p in found if store.get_file_info(place).type == fs.FileType.File]
    return sorted(found)


def state_of(path: str, begin: int = 0, limit: int | None = None, least: int = 0) -> dict:
    """Where the last complete line ends (by ``limit``, if given; then ``least`` lines from ``begin`` on
    count all the same) and the digests of the beginning."""
    with opened(path) as f:
        stop = complete_bytes(f, limit)
        if limit is not None and stop <= begin:
            f.seek(begin)
            line = f.readline() if least else b""
            stop = begin + len(line) if line.endswith(b"\n") else begin
        f.seek(0)
        head = f.read(min(HEAD, stop))
    sizes = [1 << k for k in range(HEAD.bit_length()) if 1 << k <= len(head)]
    return {"at": stop, "head": [hashlib.md5(head[:n]).hexdigest()[: 2 * DIGEST] for n in sizes]}


def resumed(before: dict | None, now: dict) -> int:
    """Where reading goes on: 0 for a new file and for one that is shorter or begins otherwise."""
    if before is None or before["at"] > now["at"] or before["head"] != now["head"][: len(before["head"])]:
        return 0
    return before["at"]


def complete_bytes(source: str | io.BufferedReader, limit: int | None = None) -> int:
    """Size of a file up to and including its last newline (before ``limit``)."""
    if isinstance(source, str):
        with opened(source) as f:
            return complete_bytes(f, limit)
    end = source.seek(0, io.SEEK_END)
    end = end if limit is None else min(end, limit)
    while end > 0:
        start = max(0, end - BLOCK)
        source.seek(start)
        found = source.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0
