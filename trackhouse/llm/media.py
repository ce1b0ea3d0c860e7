"""Matroska files in binary columns: a lossless muxer, and a parser into packet tables.

The parser knows variable-length ids and sizes, unknown sizes of segments and clusters, simple
blocks and block groups, all three lacings, and cues. It copies nothing: packets are byte ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackhouse.llm.columns import batch_slices, batch_with, schema_with

# Element ids of the format. Fixed values.
EBML = 0x1A45DFA3
EBML_VERSION = 0x4286
EBML_READ_VERSION = 0x42F7
EBML_MAX_ID = 0x42F2
EBML_MAX_SIZE = 0x42F3
DOC_TYPE = 0x4282
DOC_TYPE_VERSION = 0x4287
DOC_TYPE_READ_VERSION = 0x4285
SEGMENT = 0x18538067
INFO = 0x1549A966
TIMESTAMP_SCALE = 0x2AD7B1
DURATION = 0x4489
MUXING_APP = 0x4D80
WRITING_APP = 0x5741
TRACKS = 0x1654AE6B
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
FLAG_LACING = 0x9C
CODEC_ID = 0x86
DEFAULT_DURATION = 0x23E383
AUDIO = 0xE1
SAMPLING_FREQUENCY = 0xB5
CHANNELS = 0x9F
BIT_DEPTH = 0x6264
CLUSTER = 0x1F43B675
TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
CUES = 0x1C53BB6B
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1

#: Samples of a packet and its length in time: 8-bit samples at 8,000 per second.
FRAME, RATE = 576, 8000
FRAME_MS = FRAME * 1000 // RATE
LACED, BLOCKS = 8, 50
PAD = 255
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def size_bytes(value: int, width: int = 0) -> bytes:
    """A number as a variable-length size; all ones are kept for unknown sizes."""
    while not width or value >= (1 << (7 * width)) - 1:
        width += 1
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _header() -> bytes:
    parts = [uint(EBML_VERSION, 1), uint(EBML_READ_VERSION, 1), uint(EBML_MAX_ID, 4), uint(EBML_MAX_SIZE, 8),
             element(DOC_TYPE, b"matroska"), uint(DOC_TYPE_VERSION, 4), uint(DOC_TYPE_READ_VERSION, 2)]
    return element(EBML, b"".join(parts))


def _tracks() -> bytes:
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)
    entry = [uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(FLAG_LACING, 1),
             uint(DEFAULT_DURATION, FRAME_MS * 1_000_000), element(CODEC_ID, b"A_PCM/INT/LIT"), element(AUDIO, audio)]
    return element(TRACKS, element(TRACK_ENTRY, b"".join(entry)))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing header and the frames of a block."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0])
        for before, now in zip(sizes[:-1], sizes[1:-1]):
            delta, width = now - before, 1
            while not -(1 << (7 * width - 1)) < delta < 1 << (7 * width - 1):
                width += 1
            head += size_bytes_exact(delta + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def size_bytes_exact(value: int, width: int) -> bytes:
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def block(track: int, time: int, frames: list[bytes], kind: int) -> bytes:
    return element(SIMPLE_BLOCK, size_bytes(track) + struct.pack(">hB", time, 0x80 | kind << 1) + lace(frames, kind))


def mux(payload: bytes) -> bytes:
    """A file of one 8-bit track with ``payload`` in packets of ``FRAME`` samples, laced, with cues.
    Only the payload decides its bytes."""
    n = len(payload) // FRAME
    duration = element(DURATION, struct.pack(">d", n * FRAME_MS))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + duration + element(MUXING_APP, b"mux") + element(WRITING_APP, b"mux"))
    body, cues = [info, _tracks()], []
    at = sum(map(len, body))
    for first in range(0, n, LACED * BLOCKS):
        start = first * FRAME_MS
        parts = [uint(TIMESTAMP, start)]
        for f in range(first, min(n, first + LACED * BLOCKS), LACED):
            frames = [payload[i * FRAME : (i + 1) * FRAME] for i in range(f, min(n, f + LACED, first + LACED * BLOCKS))]
            parts.append(block(1, f * FRAME_MS - start, frames, FIXED if len(frames) > 1 else NO_LACING))
        cluster = element(CLUSTER, b"".join(parts))
        place = element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + place))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _header() + element(SEGMENT, b"".join(body))


@dataclass
class Parsed:
    """Tracks, packets ``(track, timestamp_ns, start, length, keyframe)`` and cues ``(time_ns, track,
    cluster start)`` of a file; starts are from its first byte."""

    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    duration_ns: int = 0


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """A variable-length number: its value, the place after it, and whether all its bits are ones."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"number cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & ((1 << (7 * width)) - 1)
    return (value if keep_marker else bare), at + width, bare == (1 << (7 * width)) - 1


#: What may hold other elements, and what ends an element of unknown size.
_PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}


def elements(data: bytes, start: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """``(id, body start, body end)`` of the elements in a range. An element of unknown size ends
    where an element begins that cannot lie in it."""
    at = start
    while at < end:
        number, at, _ = _number(data, at, True)
        size, body, unknown = _number(data, at, False)
        if unknown:
            stop = end if number != CLUSTER else _unknown_end(data, body, end)
        else:
            stop = body + size
            if stop > end:
                raise ValueError(f"element {number:#x} at byte {at} runs past its parent")
        yield number, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        number, after, _ = _number(data, at, True)
        if number in _TOP:
            return at
        size, after, _ = _number(data, after, False)
        at = after + size
    return end


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges ``(start, length)`` of the frames of a block."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                before = at
                value, at, _ = _number(data, at, False)
                size = value if i == 0 else sizes[-1] + value - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run past their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Parsed:
    """Tables of a file; a broken one raises ``ValueError``."""
    out, scale, raw_cues, segment = Parsed(), 1_000_000, [], 0
    durations: dict[int, int] = {}

    def value(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def real(a: int, b: int) -> float:
        return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0

    def add_block(a: int, b: int, time: int, simple: bool) -> None:
        track, at, _ = _number(data, a, False)
        shift, flags = struct.unpack_from(">hB", data, at)
        step = durations.get(track, 0)
        for i, (first, length) in enumerate(_laces(data, at + 3, b, flags >> 1 & 3)):
            out.packets.append((track, (time + shift) * scale + i * step, first, length, bool(flags & 0x80) or not simple))

    for number, a, b in elements(data, 0, len(data)):
        if number != SEGMENT:
            continue
        segment = a
        for part, c, d in elements(data, a, b):
            if part == INFO:
                for n, x, y in elements(data, c, d):
                    if n == TIMESTAMP_SCALE:
                        scale = value(x, y)
                    elif n == DURATION:
                        out.duration_ns = real(x, y)
                out.duration_ns = int(out.duration_ns * scale)
            elif part == TRACKS:
                for n, x, y in elements(data, c, d):
                    if n == TRACK_ENTRY:
                        track = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0}
                        for m, p, q in elements(data, x, y):
                            if m == TRACK_NUMBER:
                                track["number"] = value(p, q)
                            elif m == TRACK_TYPE:
                                track["type"] = value(p, q)
                            elif m == CODEC_ID:
                                track["codec"] = data[p:q].decode("ascii", "replace")
                            elif m == DEFAULT_DURATION:
                                durations[track["number"]] = value(p, q)
                            elif m == AUDIO:
                                for k, s, t in elements(data, p, q):
                                    if k == SAMPLING_FREQUENCY:
                                        track["rate"] = real(s, t)
                                    elif k == CHANNELS:
                                        track["channels"] = value(s, t)
                                    elif k == BIT_DEPTH:
                                        track["bits"] = value(s, t)
                        out.tracks.append(track)
            elif part == CLUSTER:
                time = 0
                for n, x, y in elements(data, c, d):
                    if n == TIMESTAMP:
                        time = value(x, y)
                    elif n == SIMPLE_BLOCK:
                        add_block(x, y, time, True)
                    elif n == BLOCK_GROUP:
                        for m, p, q in elements(data, x, y):
                            if m == BLOCK:
                                add_block(p, q, time, False)
            elif part == CUES:
                for n, x, y in elements(data, c, d):
                    if n == CUE_POINT:
                        time = 0
                        for m, p, q in elements(data, x, y):
                            if m == CUE_TIME:
                                time = value(p, q)
                            elif m == CUE_TRACK_POSITIONS:
                                pair = {k: value(s, t) for k, s, t in elements(data, p, q)}
                                raw_cues.append((time, pair.get(CUE_TRACK, 0), pair.get(CUE_CLUSTER_POSITION, 0)))
    out.cues = [(time * scale, track, segment + place) for time, track, place in raw_cues]
    return out


def payload_of(text: bytes) -> bytes:
    """A text's bytes, filled up with ``PAD`` to a positive multiple of ``FRAME``."""
    return text + bytes([PAD]) * (-len(text) % FRAME if text else FRAME)


def store(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes`` (of the text in UTF-8) and ``media`` (a Matroska file of its padded
    bytes). A null text counts as empty. Columns of these names are replaced; no shuffle."""
    added = {"n_bytes": T.LongType(), "media": T.BinaryType()}
    kept = docs if keep_text else docs.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, text, 4 << 20):
                raw = [x or b"" for x in part.column(part.schema.names.index(text)).cast(pa.binary()).to_pylist()]
                files = [mux(payload_of(x)) for x in raw]
                part = part if keep_text else part.drop_columns([text])
                yield batch_with(part, {"n_bytes": pa.array([len(x) for x in raw]), "media": pa.array(files, pa.binary())})

    return docs.mapInArrow(run, schema_with(kept, added))


def packets(files: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """One row per packet: the file's id, ``track``, ``number``, ``timestamp_ns``, ``start``,
    ``length``, ``keyframe`` and ``error``. A null file has no rows; a broken one has a single row
    that says why in ``error``."""
    schema = T.StructType([
        T.StructField(id_col, files.schema[id_col].dataType), T.StructField("track", T.IntegerType()), T.StructField("number", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("keyframe", T.BooleanType()), T.StructField("error", T.StringType())])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = [(t, n, ns, s, size, key, None) for n, (t, ns, s, size, key) in enumerate(parse(data).packets)]
                except (ValueError, IndexError, struct.error) as e:
                    found = [(None, None, None, None, None, None, str(e))]
                owner += [i] * len(found)
                rows += found
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select(id_col, media).mapInArrow(run, schema)


def read_back(files: DataFrame, media: str = "media") -> DataFrame:
    """``files`` with ``payload`` (its packets' bytes in order) and ``feature``: packets, length in
    time, cues, then mean, energy and sign changes of the samples around 128. Null or broken files
    give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, media, 4 << 20):
                payloads, features = [], []
                for data in part.column(part.schema.names.index(media)).to_pylist():
                    try:
                        found = parse(data) if data is not None else None
                    except (ValueError, IndexError, struct.error):
                        found = None
                    if found is None:
                        payloads.append(None)
                        features.append(None)
                        continue
                    raw = b"".join(data[s : s + n] for _, _, s, n, _ in found.packets)
                    x = np.frombuffer(raw, np.uint8).astype(np.int32) - 128
                    numbers = (len(found.packets), found.duration_ns // 1_000_000, len(found.cues), int(x.sum()), int((x.astype(np.int64) ** 2).sum()),
                               int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))))
                    payloads.append(raw)
                    features.append(":".join(map(str, numbers)))
                yield batch_with(part, {"payload": pa.array(payloads, pa.binary()), "feature": pa.array(features, pa.string())})

    return files.mapInArrow(run, schema_with(files, {"payload": T.BinaryType(), "feature": T.StringType()}))
