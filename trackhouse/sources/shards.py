"""Tar shards of paired samples: indexing by headers, reading by byte range, and packing."""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, WriterCommitMessage

from trackhouse.operators.ranking import global_rank
from trackhouse.operators.taxonomy import IGNORE_ID
from trackhouse.session import durable, ensure_checkpoint_dir
from trackhouse.sources.storage import Staged, StagedWriter, filesystem, qualified, write_whole
from trackhouse.sources.tree import walk

# Fixed values.
SAMPLES_PER_SHARD = 500
IMAGE, MASK = "jpg", "png"

#: Bytes of payload in a batch.
BATCH_BYTES = 16 << 20
#: Most runs of shards that payloads are dealt into; the keys where runs begin go to every task.
MOST_RUNS = 4096
#: Unpaired samples that an error names.
LISTED = 3

PLACE = "struct<offset: bigint, size: bigint>"
INDEX = f"shard string, key string, image {PLACE}, mask {PLACE}"
_PLACE = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
STATS = "shard string, samples bigint, bytes bigint, sequences array<string>, class_pixels array<bigint>, ignore_pixels bigint"


def tar_places(stream: io.RawIOBase) -> dict[str, dict[str, dict[str, int]]]:
    """Offset and size of every image and mask by sample key. Only headers are read: payloads are
    passed over by seeking."""
    found: dict[str, dict[str, dict[str, int]]] = {}
    with tarfile.open(fileobj=stream, mode="r:") as tar:
        for member in tar:
            key, _, ext = member.name.rpartition(".")
            if member.isfile() and ext in (IMAGE, MASK):
                found.setdefault(key, {})[ext] = {"offset": member.offset_data, "size": member.size}
    return found


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    """Where the two members of every sample lie: ``shard, key, image, mask``; NULL for a missing one.

    A shard is one task's work. Its headers are walked once and paired on the way, whatever the order
    of members.
    """
    base = qualified(spark, path).rstrip("/")
    name = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    shards = walk(spark, base).where(F.col("name").endswith(".tar")).select(F.concat(F.lit(f"{base}/"), name).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                store, place = filesystem(shard)
                with store.open_input_file(place) as stream:
                    found = tar_places(stream)
                keys = sorted(found)
                columns = [pa.array([found[k].get(ext) for k in keys], _PLACE) for ext in (IMAGE, MASK)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(keys), pa.string()), pa.array(keys, pa.string()), *columns], names=["shard", "key", "image", "mask"])

    return shards.repartition("shard").mapInArrow(run, INDEX)


def fetch(index: DataFrame) -> DataFrame:
    """``index`` with the bytes of images and masks in place of where they lie, read by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, opened = None, None
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for shard, key, image, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != opened:
                    if stream is not None:
                        stream.close()
                    store, place = filesystem(shard)
                    stream, opened = store.open_input_file(place), shard
                parts = [stream.read_at(p["size"], p["offset"]) for p in (image, mask)]
                rows.append((shard, key, *parts))
                size += sum(map(len, parts))
                if size >= BATCH_BYTES:
                    yield _samples(rows)
                    rows, size = [], 0
        if stream is not None:
            stream.close()
        if rows:
            yield _samples(rows)

    dealt = index.select("shard", "key", "image", "mask").repartition("shard").sortWithinPartitions("shard", "image.offset")
    return dealt.mapInArrow(run, "shard string, key string, image binary, mask binary")


def _samples(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "key", "image", "mask"])


def read_samples(spark: SparkSession, path: str, *, with_data: bool = True) -> DataFrame:
    """Paired samples; an unpaired one is an error that names examples. Without data, ``image`` and
    ``mask`` are offset and size. Every shard is indexed once, when this is called."""
    index = durable(shard_index(spark, path))
    odd = index.where("image IS NULL OR mask IS NULL").select("shard", "key")
    examples = [f"{r.shard}:{r.key}" for r in odd.orderBy("shard", "key").limit(LISTED).collect()]
    if examples:
        raise ValueError(f"{odd.count()} unpaired samples, e.g. {examples}")
    return fetch(index) if with_data else index


def grey_png(pixels: bytes, width: int, height: int) -> bytes:
    """A grey image of eight bits, losslessly."""
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


class Collapse:
    """The lookup table on whole masks: gate, collapse, count."""

    def __init__(self, lut: dict[int, int]):
        self.known = np.zeros(256, bool)
        self.known[list(lut)] = True
        self.table = bytes(lut.get(i, IGNORE_ID) for i in range(256))

    def __call__(self, key: str, pixels: bytes) -> tuple[bytes, np.ndarray]:
        bins = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        unknown = np.flatnonzero((bins > 0) & ~self.known).tolist()
        if unknown:
            raise ValueError(f"the mask of {key} holds ids outside the taxonomy: {unknown}")
        collapsed = pixels.translate(self.table)
        return collapsed, np.bincount(np.frombuffer(collapsed, np.uint8), minlength=256)


class ShardWriter(StagedWriter):
    """Runs of ``run, key, sequence, image, mask, width, height`` in order, a tar per ``per_shard``."""

    suffix = ".tar"

    def __init__(self, folder: str, split: str, per_shard: int, shards_per_run: int, collapse: Collapse | None, report: Callable):
        super().__init__(folder, overwrite=True)
        self.split, self.per_shard, self.shards_per_run, self.collapse, self.report = split, per_shard, shards_per_run, collapse, report

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = Staged()
        rows = (
            row
            for batch in iterator
            for first in range(0, batch.num_rows, 64)
            for row in zip(*(c.to_pylist() for c in batch.slice(first, 64).columns))
        )
        row = next(rows, None)
        run, place, before = None, 0, None
        while row is not None:
            if row[0] != run:
                run, place = row[0], 0
            number = run * self.shards_per_run + place // self.per_shard
            about = {"samples": 0, "bytes": 0, "sequences": set(), "pixels": np.zeros(256, np.int64)}
            with self.staged(done, f"{self.split}-{number:05d}{self.suffix}", about) as out:
                counted = _Counted(out)
                with tarfile.open(fileobj=counted, mode="w|") as tar:
                    while row is not None and row[0] == run and run * self.shards_per_run + place // self.per_shard == number:
                        if row[1] == before:
                            raise ValueError(f"two samples have the key {before}")
                        self._add(tar, about, *row[1:])
                        before, place, row = row[1], place + 1, next(rows, None)
                about.update(bytes=counted.written, sequences=sorted(about["sequences"]), pixels=about["pixels"].tolist())
        return done

    def _add(self, tar: tarfile.TarFile, about: dict, key: str, sequence: str | None, image: bytes, mask: bytes, width: int, height: int) -> None:
        if self.collapse is not None:
            if len(mask) != width * height:
                raise ValueError(f"the mask of {key} has {len(mask)} pixels, not {width} x {height}")
            pixels, counts = self.collapse(key, mask)
            mask = grey_png(pixels, width, height)
            about["pixels"] += counts
        for ext, payload in ((IMAGE, image), (MASK, mask)):
            info = tarfile.TarInfo(f"{key}.{ext}")
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))
        about["samples"] += 1
        if sequence is not None:
            about["sequences"].add(sequence)

    def published(self, files: list[tuple[str, dict]]) -> None:
        self.report(files)


class _Counted(io.RawIOBase):
    """A stream that knows how much went through it."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.written = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.written += len(data)
        return len(data)


class ShardSink(DataSource):
    """``df.write.format("tar-shards")``; see ``pack``, which deals and orders the rows."""

    @classmethod
    def name(cls) -> str:
        return "tar-shards"

    def schema(self) -> str:
        return "run int, key string, sequence string, image binary, mask binary, width int, height int"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        o = self.options
        table = {int(k): int(v) for k, _, v in (pair.partition(":") for pair in o.get("lut", "").split(",") if pair)}
        place = o["report"]

        def report(files: list[tuple[str, dict]]) -> None:
            rows = [(n, a["samples"], a["bytes"], a["sequences"], a["pixels"]) for n, a in files]
            facts = pa.table({name: [r[i] for r in rows] for i, name in enumerate(("shard", "samples", "bytes", "sequences", "pixels"))}, schema=_REPORT)
            out = io.BytesIO()
            pq.write_table(facts, out)
            write_whole(place, out.getvalue())

        return ShardWriter(o["path"], o["split"], int(o["pershard"]), int(o["shardsperrun"]), Collapse(table) if table else None, report)


_REPORT = pa.schema([("shard", pa.string()), ("samples", pa.int64()), ("bytes", pa.int64()), ("sequences", pa.list_(pa.string())), ("pixels", pa.list_(pa.int64()))])


def pack(
    samples: DataFrame, split: str, out_dir: str, *, per_shard: int = SAMPLES_PER_SHARD, lut: DataFrame | None = None, classes: Sequence[int] = ()
) -> DataFrame:
    """Write ``{split}-{i:05d}.tar`` files of ``key, sequence, image, mask`` rows in key order; one row of
    ``STATS`` per shard.

    With ``lut`` (``level3_id, train_id``, at most 256 rows) ``mask`` is grey pixels of ``width`` times
    ``height``: an id outside the table stops the run, the rest is collapsed, counted by train id
    (``class_pixels`` in the order of ``classes``) and stored as PNG. Otherwise masks are stored as they are.

    Keys alone are ranked first. From the ranks come the keys at which runs of whole shards begin, at
    most ``MOST_RUNS`` of them, so every payload is exchanged once, straight to the task that writes it.
    Files are staged and published together with their statistics when the job commits: a killed task or
    a failed job leaves no tar, and those of an earlier run stay until then. Two samples of one key are
    an error.
    """
    spark = samples.sparkSession
    spark.dataSource.register(ShardSink)
    target = qualified(spark, f"{out_dir.rstrip('/')}/{split}")
    ranked = durable(global_rank(samples.select("key"), ["key"], "_at"))
    shards = -(-ranked.count() // per_shard)
    shards_per_run = max(1, -(-shards // MOST_RUNS))
    heads = [r.key for r in ranked.where(F.col("_at") % (per_shard * shards_per_run) == 0).orderBy("_at").select("key").collect()]
    if len(set(heads)) < len(heads):
        raise ValueError("many samples have one key")

    def run_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        order = np.array([h.encode() for h in heads], object)
        for keys in batches:
            yield pa.array((np.searchsorted(order, np.array([k.encode() for k in keys.to_pylist()], object), "right") - 1).astype(np.int32))

    has = lambda name, kind: F.col(name).cast(kind) if name in samples.columns else F.lit(None).cast(kind)
    rows = samples.select(
        F.arrow_udf(run_of, "int")("key").alias("run"), "key", has("sequence", "string").alias("sequence"), "image", "mask",
        has("width", "int").alias("width"), has("height", "int").alias("height"),
    ) if heads else spark.createDataFrame([], ShardSink({}).schema())
    report = f"{ensure_checkpoint_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}.parquet"
    table = "" if lut is None else ",".join(f"{r[0]}:{r[1]}" for r in lut.select("level3_id", "train_id").distinct().collect())
    (
        rows.repartition("run").sortWithinPartitions("run", "key").write.format("tar-shards").mode("append")
        .option("split", split).option("perShard", per_shard).option("shardsPerRun", shards_per_run).option("lut", table).option("report", report).save(target)
    )
    found = spark.read.parquet(report)
    pixels = F.array(*[F.coalesce(F.get("pixels", F.lit(c)), F.lit(0)) for c in classes]) if classes else F.array().cast("array<bigint>")
    return found.select("shard", "samples", "bytes", "sequences", pixels.alias("class_pixels"), F.col("pixels")[IGNORE_ID].alias("ignore_pixels"))
