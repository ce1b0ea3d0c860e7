"""Files on any file system that pyarrow reaches, under the names that Spark gives them, and a base
for sinks that publish whole files only when their job commits."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

#: Files that the driver moves at once when a job commits.
MOVERS = 32
#: Schemes of Spark's connectors by the names pyarrow has for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}

#: Stores whose paths begin with the bucket.
BUCKETS = ("s3", "s3a", "s3n", "gs", "gcs")


@lru_cache(maxsize=64)
def _store(scheme: str, host: str) -> fs.FileSystem:
    if scheme in ("", "file"):
        return fs.LocalFileSystem()
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{host}/")[0]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path on it; a path without a scheme is local. Names are
    taken as they stand: ``#``, ``?`` and per cent signs mean nothing."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return _store("", ""), path
    host = ""
    if rest.startswith("//"):
        host, _, rest = rest[2:].partition("/")
        rest = f"/{rest}"
    return _store(scheme, host), f"{host}{rest}" if scheme in BUCKETS else rest


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of Spark's default file system where it names none."""
    if ":" in path.partition("/")[0]:
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def below(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def exists(path: str) -> bool:
    store, place = filesystem(path)
    return store.get_file_info(place).type != fs.FileType.NotFound


def listed(folder: str, suffix: str = "") -> list[str]:
    """Names of the files right in ``folder`` that end in ``suffix``, sorted; none if it is absent."""
    store, place = filesystem(folder)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix))


def write_whole(path: str, data: bytes) -> None:
    """Write ``data`` aside and move it to ``path``, so that a reader sees all of it or nothing."""
    store, place = filesystem(path)
    parent = posixpath.dirname(place)
    store.create_dir(parent, recursive=True)
    aside = posixpath.join(parent, f"_aside-{uuid.uuid4().hex}")
    with store.open_output_stream(aside, compression=None) as out:
        out.write(data)
    store.move(aside, place)


def read_whole(path: str) -> bytes:
    store, place = filesystem(path)
    with store.open_input_stream(place, compression=None) as stream:
        return stream.read()


@dataclass
class Staged(WriterCommitMessage):
    """The files of one task: staged path, final name, and what the sink says about each."""

    files: list[tuple[str, str, dict]] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """A sink of whole files.

    A task writes below a staging folder of its job and reports what it wrote. The driver moves the
    files of the tasks that count to their final names and removes the folder, with all that killed,
    repeated or failed attempts left in it. Nothing of a failed job is published.
    """

    suffix = ""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.staging = f"{self.folder}/_staged-{uuid.uuid4().hex}"

    @contextmanager
    def staged(self, done: Staged, name: str, about: dict) -> Iterator[pa.NativeFile]:
        """An output stream of a new file; ``about`` may be filled until it is closed."""
        store, place = filesystem(f"{self.staging}/{uuid.uuid4().hex}")
        store.create_dir(posixpath.dirname(place), recursive=True)
        with store.open_output_stream(place, compression=None) as out:
            yield out
        done.files.append((place, name, about))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, place = filesystem(self.folder)
        store.create_dir(place, recursive=True)
        ready = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name, _ in ready]
        if len(set(names)) != len(names):
            raise ValueError(f"two tasks wrote files of one name below {self.folder}")
        if self.overwrite:
            for old in listed(self.folder, self.suffix):
                store.delete_file(posixpath.join(place, old))
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda f: store.move(f[0], posixpath.join(place, f[1])), ready))
        self._clear()
        self.published([(name, about) for _, name, about in ready])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def published(self, files: list[tuple[str, dict]]) -> None:
        """Called on the driver with the names and facts of all files after they are in place."""

    def _clear(self) -> None:
        store, place = filesystem(self.staging)
        if store.get_file_info(place).type != fs.FileType.NotFound:
            store.delete_dir(place)
