"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

Per document ``HASHES`` minima are taken; bands of ``ROWS`` whole minima give candidates, and the
low ``BITS`` bits of all minima, packed into longs, tell by counting bits how similar a candidate
pair is once chance agreement of low bits is taken out. Pairs that could reach the threshold are
compared on their full sets.

Equal sets are folded first. Then every document meets the most central member of its buckets, the
one that shares most buckets, and what links falls into components. Only members of different
components are left to compare: in a bucket, those outside its largest component meet the others,
by counting bits in blocks of bounded size, and only pairs that could be links come out, each from
the first band that it shares. These are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.llm import words as W
from trackhouse.llm.columns import quoted, slices, utf8
from trackhouse.llm.components import components
from trackhouse.session import durable

#: Bands of rows of minima: a pair of similarity 0.8 shares no band with probability 6e-7.
BANDS, ROWS = 36, 5
#: All minima: those of the bands, and more for the estimate alone.
HASHES = 768
#: Bits kept of a minimum, and longs that hold them all.
BITS = 2
LONGS = -(-HASHES * BITS // 64)
#: Chance of dropping a pair at the threshold by its estimate.
MISS = 1e-6
#: Members of a block that is compared at once, and rows of a unit of work.
CHUNK, UNIT = 256, 4096
SLICE = 1 << 20


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4242)
    odd = rng.integers(0, 2**31, HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``length`` lower-cased words of each text, repeated ones included, and
    their bounds by text. A text with fewer words is one shingle; one without words has none."""
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, bounds, W.SPACED)
    hashes = W.word_hashes(data, starts, ends)
    counts = np.diff(firsts)
    at = np.flatnonzero(W.run_starts(firsts, length))
    runs = W.run_hashes(hashes, length)[at] if len(at) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(at, firsts)
    few = np.flatnonzero((counts > 0) & (counts < length))
    if len(few):
        whole = []
        for i in few.tolist():
            own = hashes[firsts[i] : firsts[i + 1]]
            whole.append(W.run_hashes(own, len(own))[0] ^ np.uint64(len(own)))
        runs = np.insert(runs, cuts[few], np.array(whole, np.uint64))
        cuts = cuts + np.concatenate([[0], np.cumsum((counts > 0) & (counts < length))])
    return runs, cuts


def _sets(runs: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and their bounds."""
    out = np.empty_like(runs)
    keep = np.ones(len(runs), bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            out[a:b] = np.sort(runs[a:b])
            keep[a + 1 : b] = out[a + 1 : b] != out[a : b - 1]
    sizes = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], sizes[cuts]


def _signatures(runs: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of every text that has shingles."""
    odd, add = _functions()
    base = (runs >> np.uint64(32)).astype(np.uint32)
    first = cuts[:-1][np.diff(cuts) > 0]
    minima = np.empty((len(first), HASHES), np.uint32)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat(base * odd[k] + add[k], first)
    used = np.arange(BANDS * ROWS, dtype=np.uint64)
    rows = W.mixed(minima[:, : BANDS * ROWS].astype(np.uint64) + used * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((len(first), BANDS), np.uint64)
    for r in range(ROWS):
        keys = W.mixed(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, r :: ROWS])
    low = np.zeros((len(first), LONGS * 64 // BITS), np.uint64)
    low[:, :HASHES] = minima & np.uint32((1 << BITS) - 1)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    packed = (low.reshape(len(first), LONGS, -1) << shifts).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def least_matches(threshold: float) -> int:
    """Matching low bits below which a pair of that similarity falls with probability ``MISS``."""
    p = threshold + (1 - threshold) / (1 << BITS)
    total = 0.0
    for m in range(HASHES + 1):
        total += comb(HASHES, m) * p**m * (1 - p) ** (HASHES - m)
        if total > MISS:
            return m
    return HASHES


def matches(one: Column, other: Column) -> Column:
    """How many of the packed low bits agree: differing groups are folded to one bit and counted."""
    ones = int("".join(["0" * (BITS - 1) + "1"] * (64 // BITS)), 2)
    differ = []
    for i in range(LONGS):
        x = one[i].bitwiseXOR(other[i])
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        differ.append(F.bit_count(x.bitwiseAND(F.lit(ones))))
    return F.lit(HASHES) - reduce(lambda a, b: a + b, differ)


def estimate(agreed: Column) -> Column:
    """Similarity by the share of agreeing low bits, without what agrees by chance."""
    chance = 1.0 / (1 << BITS)
    return (agreed / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def sketches(docs: DataFrame, id_col: str, text: str, length: int) -> DataFrame:
    """Per row: ``doc``, ``n`` (set size), ``x`` and ``y`` (hashes of the whole set), ``keys``, ``sig``."""
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("doc", "n", "x", "y")]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("keys", "sig")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            ids = batch.column(0)
            for first, last in slices(bounds, SLICE):
                runs, cuts = shingles(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], length)
                distinct, borders = _sets(runs, cuts)
                sizes = np.diff(borders)
                has = sizes > 0
                folded = []
                for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    sums = np.zeros(len(distinct) + 1, np.uint64)
                    np.cumsum(W.mixed(distinct ^ np.uint64(seed)), out=sums[1:])
                    folded.append((sums[borders[1:]] - sums[borders[:-1]]).view(np.int64))
                keys, packed = _signatures(runs, cuts) if has.any() else (np.zeros((0, BANDS), np.int64), np.zeros((0, LONGS), np.int64))
                lists = []
                for values, width in ((keys, BANDS), (packed, LONGS)):
                    at = np.concatenate([[0], np.cumsum(has * width)]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel())))
                columns = [ids.slice(first, last - first), pa.array(sizes), *map(pa.array, folded), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text).alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, id_col: str, text: str, length: int, wanted: DataFrame) -> DataFrame:
    """``(doc, items)``: the shingle sets of the documents in ``wanted``."""
    schema = "doc long, items array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            for first, last in slices(bounds, SLICE):
                runs, cuts = shingles(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], length)
                distinct, borders = _sets(runs, cuts)
                items = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(distinct.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), items], names=["doc", "items"])

    texts = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text).alias("text"))
    return texts.join(wanted, "doc", "left_semi").mapInArrow(run, schema)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 4, percent: int = 80
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    Words are parted by white space, A to Z in lower case. Two documents are linked when the sets
    of their runs of ``length`` words have ``100 * common >= percent * united``; a component is
    named by its smallest id and that document is ``kept``. A null, empty or wordless text has an
    empty set and is linked with nothing. Rows with one id count as one document, linked with what
    any of them is linked with; a null id is linked with nothing, has no component and is kept. An
    empty table gives an empty result.
    """
    all_rows = durable(sketches(docs, id_col, text, length))
    known = all_rows.where((F.col("n") > 0) & F.col("doc").isNotNull())
    folded = known.groupBy("x", "y").agg(F.min("doc").alias("rep"))
    labels = _link(docs, id_col, text, length, percent, known, folded)
    classes = all_rows.select("doc", "n", "x", "y").join(folded, ["x", "y"], "left")
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc"))
    return named.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("doc") == own, F.lit(True)).alias("kept"),
    )


def _link(
    docs: DataFrame, id_col: str, text: str, length: int, percent: int, known: DataFrame, folded: DataFrame
) -> DataFrame:
    """``(node, component)`` of the class representatives that are linked with others."""
    reps = folded.select(F.col("rep").alias("doc"), "x", "y")
    heads = known.join(reps, ["doc", "x", "y"], "left_semi")
    bands = heads.select("doc", F.posexplode("keys").alias("band", "key"))
    filled = bands.groupBy("band", "key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    members = durable(bands.join(filled.select("band", "key"), ["band", "key"]))
    degrees = members.groupBy("doc").agg(F.count("*").alias("degree"))
    # Folded sets may share an id (rows that repeat one); each keeps its own signature.
    signatures = durable(heads.join(degrees, "doc", "left_semi").select("doc", "sig", "keys"))
    wanted = degrees.select("doc")
    sets = full_sets(docs, id_col, text, length, wanted).repartition("doc").persist(StorageLevel.DISK_ONLY)
    # An id with several texts ties their classes together.
    tied = known.join(folded, ["x", "y"]).select("doc", "rep")
    several = tied.groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last")
    ties = tied.join(several, "doc").select(F.col("rep").alias("a"), "b").where("a != b")

    def compared(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("doc").alias("a"), F.col("items").alias("set_a"))
        two = sets.select(F.col("doc").alias("b"), F.col("items").alias("set_b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        united = F.size("set_a") + F.size("set_b") - common
        return pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("common"), united.alias("united"))

    linked = 100 * F.col("common") >= percent * F.col("united")
    least = least_matches(percent / 100)
    spot = F.struct("degree", (-F.col("doc")).alias("rank"))
    central = members.join(degrees, "doc").groupBy("band", "key").agg(F.max(spot).alias("top"))
    met = members.join(central, ["band", "key"]).groupBy("doc").agg(F.max("top").alias("top"))
    met = met.select(F.col("doc").alias("a"), (-F.col("top.rank")).alias("b"))
    stars = durable(compared(met.where("a != b")))
    joined = stars.where(linked).select("a", "b")
    labels = durable(components(durable(ties.unionByName(joined).distinct())))
    # How far a document is from its centre bounds its distance from others around that centre.
    far = stars.select(F.col("a").alias("doc"), F.col("b").alias("centre"), (1 - F.col("common") / F.col("united")).alias("distance"))
    centred = signatures.join(far, "doc", "left").withColumns(
        {"centre": F.coalesce("centre", "doc"), "distance": F.coalesce("distance", F.lit(0.0))}
    )
    rest = _across(members, labels, centred, least, 1 - percent / 100)
    edges = durable(compared(rest.distinct()).where(linked).select("a", "b"))
    if not edges.isEmpty():
        labels = durable(_merged(labels, edges))
    sets.unpersist()
    return labels


def _across(members: DataFrame, labels: DataFrame, signatures: DataFrame, least: int, reach: float) -> DataFrame:
    """Pairs ``(a, b)`` that share a bucket, lie in different components and could be links.

    The members of a bucket outside its largest component are cut into chunks, and so are all its
    members; each pair of chunks is compared in one task, as bits. Jaccard distance is a metric, so
    two documents whose distances from one centre differ by more than ``reach`` are passed over.
    """
    labelled = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(
        "band", "key", "doc", F.coalesce("component", "doc").alias("component")
    )
    mixed = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    held = durable(labelled.join(mixed.select("band", "key"), ["band", "key"]))
    sizes = held.groupBy("band", "key", "component").agg(F.count("*").alias("size"))
    facts = sizes.groupBy("band", "key").agg(
        F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all")
    )
    chunks = facts.select(
        "band", "key", F.col("top.component").alias("largest"),
        F.ceil((F.col("all") - F.col("top.size")) / CHUNK).cast("int").alias("n_left"),
        F.ceil(F.col("all") / CHUNK).cast("int").alias("n_right"),
    )
    placed = held.join(chunks, ["band", "key"]).withColumn("outside", F.col("component") != F.col("largest"))
    chunk = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    count_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["band", "key", "doc", "component", "outside", "left", "right", "side"]
    lefts = placed.where("outside").withColumn("left", chunk("n_left")).withColumn("right", count_to("n_right")).withColumn("side", F.lit(0))
    rights = placed.withColumn("right", chunk("n_right")).withColumn("left", count_to("n_left")).withColumn("side", F.lit(1))
    work = lefts.select(names).unionByName(rights.select(names))
    units = max(1, -(-work.count() // UNIT))
    unit = F.pmod(F.xxhash64("band", "key", "left", "right"), F.lit(units))
    work = work.withColumn("unit", unit).join(signatures, "doc")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(at: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = {c: np.asarray(table.column(c)) for c in ("band", "key", "doc", "component", "outside", "left", "right", "side", "centre", "distance")}
        order = np.lexsort(tuple(columns[c] for c in ("side", "right", "left", "key", "band")))
        columns = {c: v[order] for c, v in columns.items()}
        sig = np.asarray(table.column("sig").combine_chunks().flatten()).reshape(-1, LONGS)[order].view(np.uint64)
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(-1, BANDS)[order]
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in ("band", "key", "left", "right"):
            new[1:] |= columns[c][1:] != columns[c][:-1]
        heads = np.append(np.flatnonzero(new), len(order))
        found: list[np.ndarray] = []
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            cut = a + int(np.searchsorted(columns["side"][a:b], 1))
            if a < cut < b:
                found.append(_candidates(columns, sig, keys, slice(a, cut), slice(cut, b), least, reach))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=out)

    return work.groupBy("unit").applyInArrow(run, "a long, b long")


def _candidates(
    columns: dict, sig: np.ndarray, keys: np.ndarray, left: slice, right: slice, least: int, reach: float
) -> np.ndarray:
    """Pairs of one bucket's chunks that could be links, the smaller document first."""
    x, y = columns["doc"][left], columns["doc"][right]
    apart = columns["component"][left][:, None] != columns["component"][right][None, :]
    # Two members outside the largest component meet twice: once is enough.
    apart &= (x[:, None] < y[None, :]) | ~columns["outside"][right][None, :]
    centre, distance = columns["centre"], columns["distance"]
    spread = np.abs(distance[left][:, None] - distance[right][None, :]) > reach + 1e-9
    apart &= ~(spread & (centre[left][:, None] == centre[right][None, :]))
    i, j = np.nonzero(apart)
    band = int(columns["band"][left.start])
    if band:
        first = np.ones(len(i), bool)
        for k in range(band):
            first &= keys[left][i, k] != keys[right][j, k]
        i, j = i[first], j[first]
    ones = np.uint64(int("".join(["0" * (BITS - 1) + "1"] * (64 // BITS)), 2))
    differ = np.zeros(len(i), np.int64)
    for k in range(LONGS):
        z = sig[left][i, k] ^ sig[right][j, k]
        step = 1
        while step < BITS:
            z |= z >> np.uint64(step)
            step *= 2
        differ += np.bitwise_count(z & ones)
    near = HASHES - differ >= least
    p, q = x[i[near]], y[j[near]]
    return np.column_stack([np.minimum(p, q), np.maximum(p, q)])


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after new edges: only the components that these tie together are worked on."""
    ends = edges
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias("c"))
        ends = ends.join(named, end, "left").withColumn(f"{end}_component", F.coalesce("c", end)).drop("c")
    tied = components(ends.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    tied = durable(tied)
    moved = labels.join(tied.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    moved = moved.select("node", F.coalesce("now", "component").alias("component"))
    return moved.unionByName(tied.join(labels, "node", "left_anti"))
