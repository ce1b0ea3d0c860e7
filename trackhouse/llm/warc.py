"""WARC archives of pages, compressed record by record with a Zstandard dictionary of their own.

An archive is one file: a skippable frame that holds the dictionary, then one frame per record, so a
record can be read alone by its offset. A task gathers the first records of an archive, builds the
dictionary from them, and then streams; it never holds more than these records and the one at hand.
Files are staged and published when the job commits.

Of records with equal payloads from some size on, the one of the smallest id is a response and the
others are revisits that carry its record id and no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, WriterCommitMessage

from trackhouse.llm.columns import batch_slices, quoted
from trackhouse.llm.exact import attach
from trackhouse.session import durable
from trackhouse.sources.storage import Staged, StagedWriter, filesystem, qualified

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this are always stored.
LEAST_PAYLOAD = 100
#: Bytes of records that a dictionary is built from, its size, and the level of compression.
LEARNED, DICTIONARY, LEVEL = 4 << 20, 64 << 10, 3
#: Compressed bytes after which a new archive begins.
ARCHIVE = 1 << 30
#: Names the ids are made in, the date where no column gives one, and the field that keeps the row's id.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
UNDATED = "1970-01-01T00:00:00Z"
ID_FIELD, REFERS_FIELD = "X-Page-ID", "X-Refers-To-Page-ID"
#: Bytes read at once.
READ = 1 << 20

INPUT = "id string, url string, html string, digest string, refers string"
RECORDS = (
    "archive string, offset long, stored long, record_type string, record_id string, target_uri string, id string, "
    "refers string, payload_digest string, payload_bytes long, payload binary"
)


def _line(value: str) -> str:
    """A header value: control characters and per cent signs as per cent codes."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _unlined(value: str) -> str:
    out, rest = [], value
    while "%" in rest:
        plain, _, rest = rest.partition("%")
        out += [plain, chr(int(rest[:2], 16))]
        rest = rest[2:]
    return "".join(out) + rest


def record_id(row_id: str | None, digest: str) -> str:
    """The record id of a row and its payload; it can be named before the record is written."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{row_id} {digest}')}>"


def record(row_id: str | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(row_id, digest)), ("WARC-Date", UNDATED)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if row_id is not None:
        fields.append((ID_FIELD, _line(row_id)))
    if refers is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers, digest)), (REFERS_FIELD, _line(refers))]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    payload_bytes: int
    payload: bytes | None


def parse(data: bytes) -> Record:
    """The fields and payload of a record; one that breaks the format or a digest raises ``ValueError``."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields.get("Content-Length", "-1"))
    if not gap or not version.startswith("WARC/1.") or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    block = rest[:length]
    if fields.get("WARC-Block-Digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {fields.get('WARC-Record-ID')} does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if fields["WARC-Type"] == "revisit":
        return Record(fields, sizes[0], None)
    if fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not fit")
    return Record(fields, len(payload), payload)


def dictionary(records: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; records that are too few or too small to train on serve as they are."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, records)) // 8)), records, level=LEVEL, d=8, k=256, steps=1, threads=0)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def leading_frame(words: zstandard.ZstdCompressionDict) -> bytes:
    """The skippable frame that opens an archive: the dictionary, itself compressed."""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


class _Archive:
    """Records on their way into one open file."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.held, self.size, self.written, self.records = out, [], 0, 0, 0
        self.packer: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.packer is not None:
            self._write(self.packer.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= LEARNED:
            self.learn()

    def learn(self) -> None:
        """Build the dictionary from the records held, and write it and them."""
        words = dictionary(self.held)
        self._write(leading_frame(words))
        words.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
        for data in self.held:
            self._write(self.packer.compress(data))
        self.held = []

    def close(self) -> None:
        if self.packer is None:
            self.learn()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)


class ArchiveWriter(StagedWriter):
    suffix = ".warc.zst"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = Staged()
        records = (
            record(row_id, url, (html or "").encode(), digest, refers)
            for batch in iterator
            for part in batch_slices(batch, "html", 4 << 20)
            for row_id, url, html, digest, refers in zip(*(c.to_pylist() for c in part.columns))
        )
        data = next(records, None)
        while data is not None:
            about: dict = {}
            with self.staged(done, f"{uuid.uuid4().hex}{self.suffix}", about) as out:
                archive = _Archive(out)
                while data is not None and archive.written < ARCHIVE:
                    archive.add(data)
                    data = next(records, None)
                archive.close()
                about.update(records=archive.records, bytes=archive.written)
        return done


class ArchiveSink(DataSource):
    """``df.write.format("warc-zstd")``: rows of ``INPUT`` into a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "warc-zstd"

    def schema(self) -> str:
        return INPUT

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def revisited(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """``pages`` as rows ``(id, url, html, digest, refers)``: ``refers`` is the id whose payload a row
    repeats. One digest may hold any share of the rows: they are counted before the shuffle, and only
    digests that repeat are joined back, hot ones by broadcast (``exact.attach``)."""
    payload = F.coalesce(quoted(html), F.lit("")).cast("binary")
    rows = pages.select(
        quoted(id_col).alias("id"), quoted(url).cast("string").alias("url"), quoted(html).alias("html"),
        F.sha2(payload, 256).alias("digest"), (F.length(payload) >= least).alias("large"),
    )
    groups = rows.where("large").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    found = attach(rows, durable(groups.where("n > 1 and first is not null")), "digest", "n", "first")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return found.select("id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAYLOAD
) -> str:
    """Write a record per row of ``pages`` into archives below ``folder``, and return its full path.

    A null payload is an empty one; rows without an id are kept and can revisit but never be revisited;
    a null url gives no target. Rows that share id and payload of a response are all responses of one
    record id. A very long payload is held alone, once. Other columns are ignored. An empty table gives
    a folder without archives.
    """
    spark = pages.sparkSession
    spark.dataSource.register(ArchiveSink)
    place = qualified(spark, folder)
    rows = revisited(pages, id_col, url, html, least)
    text = [F.col(c).cast("string").alias(c) for c in ("id", "url", "html", "digest", "refers")]
    rows.select(*text).write.format("warc-zstd").mode("append").save(place)
    return place


def frames(stream: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every frame of an open file, read forward in blocks."""
    held, at, offset = b"", 0, 0

    def need(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            more = stream.read(max(READ, n))
            if not more:
                return False
            held, at = held[at:] + more, 0
        return True

    while need(1):
        if not need(8):
            raise ValueError("an archive ends inside a frame")
        magic, length = struct.unpack_from("<II", held, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = 8 + length
        else:
            need(18)
            about = zstandard.get_frame_parameters(held[at : at + 18])
            size, last = zstandard.frame_header_size(held[at : at + 18]), False
            while not last:
                if not need(size + 3):
                    raise ValueError("an archive ends inside a frame")
                block = int.from_bytes(held[at + size : at + size + 3], "little")
                last = bool(block & 1)
                size += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            size += 4 * about.has_checksum
        if not need(size):
            raise ValueError("an archive ends inside a frame")
        yield offset, held[at : at + size]
        at += size
        offset += size


def _unpacker(frame: bytes) -> zstandard.ZstdDecompressor:
    words = frame[8:]
    if words[:4] == FRAME_MAGIC:
        words = zstandard.ZstdDecompressor().decompress(words)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))


def records(stream: pa.NativeFile) -> Iterator[tuple[int, int, Record]]:
    """Offset, stored size and record of every frame, with the dictionary of the leading frame."""
    unpacker = zstandard.ZstdDecompressor()
    for offset, frame in frames(stream):
        magic = struct.unpack_from("<I", frame)[0]
        if magic == DICTIONARY_FRAME and offset == 0:
            unpacker = _unpacker(frame)
        elif magic & 0xFFFFFFF0 != 0x184D2A50:
            yield offset, len(frame), parse(unpacker.decompress(frame))


def read_record(path: str, offset: int, stored: int) -> Record:
    """One record of an archive by its place, reading only the dictionary and its own frame."""
    store, place = filesystem(path)
    with store.open_input_file(place) as file:
        head = file.read(8)
        magic, length = struct.unpack("<II", head)
        unpacker = _unpacker(head + file.read(length)) if magic == DICTIONARY_FRAME else zstandard.ZstdDecompressor()
        file.seek(offset)
        return parse(unpacker.decompress(file.read(stored)))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``folder``, as ``RECORDS``; digests are checked on the way.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, also for revisits, whose payload
    is null; ``payload`` is null everywhere if it is not wanted. An archive is one task's work and is
    read forward, a block at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = pa.schema([(n, pa.int64() if n in ("offset", "stored", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = filesystem(path)
                rows, size = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for offset, stored, found in records(stream):
                        get = lambda name: _unlined(x) if (x := found.fields.get(name)) is not None else None  # noqa: B023, E731
                        rows.append((
                            path, offset, stored, found.fields["WARC-Type"], found.fields["WARC-Record-ID"], get("WARC-Target-URI"),
                            get(ID_FIELD), get(REFERS_FIELD), found.fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                            found.payload_bytes, found.payload if with_payload else None,
                        ))
                        size += 200 + (found.payload_bytes if with_payload else 0)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

    return files.mapInArrow(run, RECORDS)
