"""Packing of documents into sequences of fixed size by a grouping genetic algorithm on islands.

Pieces are dealt to blocks of bounded size, and several islands evolve packings of each block. A
crossover takes whole well-filled sequences from one parent, drops the other parent's sequences
that hold the same pieces, and best-fits what that displaced. Between epochs each island's best
packing migrates to the next island of its block. What stands in poorly filled sequences at the
end is pooled from all blocks and packed again, so only the last pool keeps a partly filled one.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.llm import bpe
from trackhouse.llm.columns import batch_slices, fresh, quoted
from trackhouse.session import durable

#: Pieces per block, on average; a block is what one task packs.
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
CROSSOVERS = 8
#: Sequences at least this full stay as they are; the pieces of others are pooled.
WELL_FILLED = 0.98
FULL = "__well_filled"


def cut(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, text: str = "text",
        keep: Sequence[str] = ("doc_id",), keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: the columns ``keep``, ``piece``, ``start``,
    ``length``, ``ids_crc32`` and, with ``keep_ids``, ``ids`` (little-endian unsigned 32 bits).

    Every row gives its ids without special tokens, then ``end_id``; a null or empty text is that
    id alone. Longer documents are cut so that only the first piece is short. No shuffle.
    """
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
        + ([T.StructField("ids", T.BinaryType())] if keep_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = bpe.encoder(path)
        for batch in batches:
            for part in batch_slices(batch, text, bpe.SLICE):
                names = part.schema.names
                found = library.encode([x or "" for x in part.column(names.index(text)).to_pylist()])
                ids = np.full(len(found.ids) + len(part), end_id, "<u4")
                bounds = found.bounds + np.arange(len(found.bounds))
                inner = np.ones(len(ids), bool)
                inner[bounds[1:] - 1] = False
                ids[inner] = found.ids
                sizes = np.diff(bounds)
                counts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(part)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                short = (sizes - capacity * (counts - 1))[doc]
                start = np.where(piece == 0, 0, short + capacity * (piece - 1))
                length = np.where(piece == 0, short, capacity)
                raw = memoryview(ids.tobytes())
                first = (bounds[doc] + start) * 4
                blobs = [raw[a:b] for a, b in zip(first.tolist(), (first + length * 4).tolist())]
                columns = [part.column(names.index(c)).take(pa.array(doc)) for c in keep]
                columns += [pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                            pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(b) for b in blobs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


class Packing:
    """Pieces in sequences: ``bins`` of piece numbers, the room left in each."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins or []
        self.rooms = [capacity - sum(lengths[i] for i in b) for b in self.bins]

    def best_fit(self, pieces: list[int]) -> Packing:
        """Put ``pieces`` in the given order, each where the least room is left over."""
        capacity, lengths, bins, rooms = self.capacity, self.lengths, self.bins, self.rooms
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        open_rooms = 0  # bit r is set if a sequence has room r
        for b, room in enumerate(rooms):
            if room:
                by_room[room].append(b)
                open_rooms |= 1 << room
        for i in pieces:
            length = lengths[i]
            fitting = open_rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    open_rooms ^= 1 << room
                bins[b].append(i)
            else:
                b, room = len(bins), capacity
                bins.append([i])
                rooms.append(room)
            rooms[b] = room = room - length
            if room:
                by_room[room].append(b)
                open_rooms |= 1 << room
        return self

    def fitness(self) -> tuple[int, int]:
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.rooms)

    def least(self) -> int:
        return -(-sum(self.lengths) // self.capacity)


def _fresh(lengths: list[int], capacity: int, noise: int, rng: random.Random) -> Packing:
    order = sorted(range(len(lengths)), key=lambda i: -(lengths[i] + (rng.randrange(noise) if noise else 0)))
    return Packing(lengths, capacity).best_fit(order)


def crossover(one: Packing, other: Packing, rng: random.Random) -> Packing:
    """A child with whole well-filled sequences of ``other`` and as much of ``one`` as they leave."""
    tight = one.capacity // 128
    good = [b for b, room in zip(other.bins, other.rooms) if room <= tight]
    good = rng.sample(good, (len(good) + 1) // 2)
    taken = bytearray(len(one.lengths))
    for b in good:
        for i in b:
            taken[i] = 1
    kept, displaced = [list(b) for b in good], []
    worst = sorted(one.rooms)[-max(2, len(one.rooms) // 50) :][0]
    for b, room in zip(one.bins, one.rooms):
        if (room and room >= worst) or any(taken[i] for i in b):
            displaced += [i for i in b if not taken[i]]
        else:
            kept.append(list(b))
    rng.shuffle(displaced)
    displaced.sort(key=one.lengths.__getitem__, reverse=True)
    return Packing(one.lengths, one.capacity, kept).best_fit(displaced)


def evolve(lengths: list[int], capacity: int, seed: int, elites: Sequence[np.ndarray] = ()) -> np.ndarray:
    """One epoch of one island: the sequence number of every piece in its best packing."""
    rng = random.Random(seed)
    people = []
    for numbers in elites:
        bins: list[list[int]] = [[] for _ in range(int(numbers.max()) + 1)]
        for i, b in enumerate(numbers.tolist()):
            bins[b].append(i)
        people.append(Packing(lengths, capacity, bins))
    if not people:
        people.append(_fresh(lengths, capacity, 0, rng))
    least = people[0].least()
    while len(people) < POPULATION and all(len(p.bins) > least for p in people):
        people.append(_fresh(lengths, capacity, capacity // 16, rng))
    people.sort(key=Packing.fitness)
    for _ in range(CROSSOVERS):
        if len(people[-1].bins) <= least:
            break
        one, other = rng.sample(people, 2)
        people[0] = crossover(one, other, rng)
        people.sort(key=Packing.fitness)
    numbers = np.zeros(len(lengths), np.int32)
    for b, held in enumerate(people[-1].bins):
        numbers[held] = b
    return numbers


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in as few sequences as the search finds.

    Every row is kept. Sequences are gapless from offset 0; ids are unique but otherwise have no
    meaning. A row whose length is null, below 1 or above ``capacity`` fits nowhere: both columns
    are null. Rows equal in everything are packed one by one. The rows are written once to the
    checkpoint folder, as later steps read them several times.
    """
    drop = [c for c in pieces.columns if c.lower() in ("sequence_id", "offset")]
    pieces = pieces.drop(*drop)
    key, block = fresh(pieces, "row_key"), fresh(pieces, "block")
    rows = durable(pieces.withColumn(key, F.monotonically_increasing_id()))
    size = quoted(length).cast("long")
    fits = size.between(1, capacity - 1)
    order = [*pieces.columns, "sequence_id", "offset"]
    whole = (
        rows.where(fits.isNull() | ~fits)
        .withColumn("sequence_id", F.when(size == capacity, -1 - F.col(key)))
        .withColumn("offset", F.when(size == capacity, F.lit(0)).cast("long"))
        .select(order)
    )
    left = rows.where(fits)
    n = left.count()
    parts, level = [whole], 0
    while n:
        blocks = -(-n // BLOCK)
        packed = _pack_blocks(left, key, block, length, blocks, level, capacity)
        if blocks == 1:
            parts.append(packed.select(order))
            break
        packed = durable(packed)
        parts.append(packed.where(F.col(FULL)).select(order))
        left = packed.where(~F.col(FULL)).drop("sequence_id", "offset", FULL)
        before, n, level = n, left.count(), level + 1
        if n > before // 2:  # too little was well filled for another level to help
            parts.append(packed.where(~F.col(FULL)).select(order))
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _pack_blocks(left: DataFrame, key: str, block: str, length: str, blocks: int, level: int, capacity: int) -> DataFrame:
    dealt = left.withColumn(block, F.pmod(F.xxhash64(F.col(key), F.lit(level)), F.lit(blocks)))
    small = dealt.select(F.col(key).alias("key"), F.col(block).alias("block"), quoted(length).cast("long").alias("length"))
    islands = small.withColumn("island", F.explode(F.lit(list(range(ISLANDS)))))
    elite_schema = "block long, island int, n int, fill long, numbers binary"
    elite_arrow = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("n", pa.int32()),
                             ("fill", pa.int64()), ("numbers", pa.binary())])

    def best(number: int, island: int, table: pa.Table, epoch: int, elites: Sequence[np.ndarray]) -> pa.Table:
        lengths = _by_key(table, "key", "length")[1].tolist()
        found = evolve(lengths, capacity, hash((level, number, island, epoch)), elites)
        sums = np.bincount(found, weights=lengths)
        row = [number, island, len(sums), int((sums**2).sum()), found.tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, elite_arrow)], schema=elite_arrow)

    def begin(at: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return best(at[0].as_py(), at[1].as_py(), table, 0, ())

    def later(epoch: int):
        def run(at: tuple[pa.Scalar, ...], own: pa.Table, elites: pa.Table) -> pa.Table:
            came = [np.frombuffer(x, np.int32) for x in elites.column("numbers").to_pylist()]
            return best(at[0].as_py(), at[1].as_py(), own, epoch, came)

        return run

    grouped = islands.groupBy("block", "island")
    elites = grouped.applyInArrow(begin, elite_schema)
    for epoch in range(1, EPOCHS):
        moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
        met = elites.unionByName(moved).groupBy("block", "island")
        elites = grouped.cogroup(met).applyInArrow(later(epoch), elite_schema)
    chosen = elites.groupBy("block").agg(
        F.max_by("numbers", F.struct(-F.col("n"), "fill", -F.col("island"))).alias("numbers")
    )
    kept_names = list(left.columns)
    names = [*kept_names, "sequence_id", "offset", FULL]
    schema = T.StructType(
        [*left.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
         T.StructField(FULL, T.BooleanType())]
    )

    def place(at: tuple[pa.Scalar, ...], table: pa.Table, best_of: pa.Table) -> pa.Table:
        table, sizes = _by_key(table, key, length)
        numbers = np.frombuffer(best_of.column("numbers")[0].as_py(), np.int32)
        order = np.argsort(numbers, kind="stable")
        closes = np.cumsum(sizes[order])
        heads = np.flatnonzero(np.diff(numbers[order], prepend=-1))
        base = (closes - sizes[order])[heads]
        offset = np.empty(len(numbers), np.int64)
        offset[order] = closes - sizes[order] - np.repeat(base, np.diff(np.append(heads, len(order))))
        full = np.bincount(numbers, weights=sizes) >= WELL_FILLED * capacity
        sequence = (level << 56) + (at[0].as_py() << 16) + numbers.astype(np.int64)
        added = [pa.array(sequence), pa.array(offset), pa.array(full[numbers])]
        held = [table.column(c) for c in kept_names]
        return pa.table([*held, *added], names=names)

    return dealt.groupBy(F.col(block)).cogroup(chosen.groupBy("block")).applyInArrow(place, schema)


def _by_key(table: pa.Table, key: str, length: str) -> tuple[pa.Table, np.ndarray]:
    """The rows in key order, so that a packing's numbers fit every copy of the block."""
    table = table.take(pa.array(np.argsort(np.asarray(table.column(key)))))
    return table, np.asarray(table.column(length)).astype(np.int64)
