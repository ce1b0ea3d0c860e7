"""Near-duplicate vectors by spherical-cap filters from random product codes.

After a random rotation a vector is cut into two halves, each scored against its own codebook; a
filter is a pair of code directions and its score the sum. A vector passes all filters above a
threshold, found by list decoding: only codes that could still reach it are paired. Vectors that
share a filter are compared in double precision. Several rotations with codebooks of their own
are used one beside the other. Their number and the threshold follow the size and width of each
group: the tail is taken from unit vectors put through the codebooks, and pairs at exactly the
wanted cosine tell how often a codebook misses one, so that all of them together miss no more than
``MISS``. Of the crowds that filters may have, the one with the fewest copies of a vector is taken.
A group of no more than ``CHUNK`` vectors is one unit of comparison, hence one filter.

Equal vectors are folded first. A filter with many members is cut into chunks and compared chunk
by chunk, and each linked pair is counted only in the smallest filter that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.llm.columns import quoted
from trackhouse.llm.components import components
from trackhouse.session import durable

#: Filters that a vector passes on average in a codebook, and unrelated vectors of its group in each.
FILTERS, CROWD = 8, 64.0
#: The best filters of a codebook always count, so every vector has some.
BEST = 4
#: The share of pairs at exactly the wanted cosine that may share no filter.
MISS = 1e-3
#: Unit vectors that give the tail, and pairs over as many codebooks that give the miss rate.
DRAWN, PAIRS, BOOKS = 256, 1000, 4
#: Members of a chunk, and rows of a unit of work.
CHUNK, UNIT = 256, 4096


@lru_cache(maxsize=16)
def _rotation(width: int, book: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng((width, book)).standard_normal((width, width)))[0]


@lru_cache(maxsize=64)
def codes(width: int, size: int, book: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation of ``width`` and two codebooks of ``size`` unit directions for its halves."""
    rng = np.random.default_rng((width, size, book))
    half = (width + 1) // 2
    books = []
    for n in (half, width - half):
        directions = rng.standard_normal((size, max(1, n)))
        books.append(directions / np.linalg.norm(directions, axis=1, keepdims=True) / math.sqrt(2))
    # Wide vectors fall evenly on both halves by any rotation, and a large one is costly to hold.
    return _rotation(width, book if width <= 512 else 0), books[0], books[1]


def _sphere(rng: np.random.Generator, n: int, width: int) -> np.ndarray:
    x = rng.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=256)
def plan(largest: int, width: int = 64, crowd: float = CROWD) -> tuple[int, float]:
    """Codes per book and the threshold, in standard deviations, that gives ``FILTERS`` filters of
    ``crowd`` members in a group of ``largest`` on the sphere of ``width``."""
    share = min(1.0, crowd / max(1, largest))
    size = max(2, math.ceil(math.sqrt(FILTERS / share)))
    left, right = _scores(_sphere(np.random.default_rng((width, size)), DRAWN, width), size, 0)
    right = np.sort(right, axis=1)
    low, high = -2.0, 2.0
    for _ in range(30):
        middle = (low + high) / 2
        passed = sum(int((size - np.searchsorted(r, middle - l)).sum()) for l, r in zip(left, right))
        low, high = (middle, high) if passed > share * DRAWN * size * size else (low, middle)
    return size, low * math.sqrt(width)


@dataclass(frozen=True)
class Layout:
    """Codebooks of a group with their size and threshold; a group of one chunk needs none."""

    books: int
    size: int = 0
    deviations: float = 0.0


def trial(width: int, size: int, deviations: float, cosine: float) -> tuple[float, float]:
    """An upper estimate of the share of pairs at ``cosine`` that share no filter of one codebook,
    and the mean number of filters that a vector passes in it."""
    rng = np.random.default_rng((width, size, 1))
    missed = passed = 0
    for book in range(BOOKS):
        one, two = pairs_at(rng, PAIRS // BOOKS, width, cosine)
        found, others = decode(one, size, deviations, book), decode(two, size, deviations, book)
        passed += sum(map(len, found))
        missed += sum(not np.intersect1d(a, b).size for a, b in zip(found, others))
    rate = (missed + 1) / (PAIRS + 1)
    return min(1.0, rate + 2 * math.sqrt(rate * (1 - rate) / PAIRS)), passed / PAIRS


def pairs_at(rng: np.random.Generator, n: int, width: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of unit vectors at ``cosine`` (in one dimension: equal ones)."""
    one, side = _sphere(rng, n, width), _sphere(rng, n, width)
    if width == 1:
        return one, one
    side -= (side * one).sum(axis=1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = max(-1.0, min(1.0, cosine))
    return one, cosine * one + math.sqrt(1 - cosine * cosine) * side


@lru_cache(maxsize=256)
def layout(largest: int, width: int, cosine: float) -> Layout:
    """What misses at most ``MISS`` of the pairs at ``cosine`` in groups of up to ``largest`` with
    the fewest copies of a vector: filters of some crowd, at every size above one chunk."""
    if largest <= CHUNK:
        return Layout(0)
    best, fewest, crowd = None, math.inf, CROWD
    while crowd < largest or best is None:
        size, deviations = plan(largest, width, min(crowd, largest))
        missed, passed = trial(width, size, deviations, cosine)
        books = math.ceil(math.log(MISS) / math.log(missed)) if missed < 1 else math.inf
        copies = books * passed * math.ceil(crowd / CHUNK)
        if books < math.inf and copies < fewest:
            best, fewest = Layout(books, size, deviations), copies
        crowd *= 4
    return best


def _scores(units: np.ndarray, size: int, book: int) -> tuple[np.ndarray, np.ndarray]:
    """What every code of either half scores for each unit vector."""
    width = units.shape[1]
    rotation, one, two = codes(width, size, book)
    half = (width + 1) // 2
    turned = units @ rotation
    return turned[:, :half] @ one.T, turned[:, half:] @ two.T if width > half else np.zeros((len(units), size))


def decode(units: np.ndarray, size: int, threshold: float, book: int = 0) -> list[np.ndarray]:
    """The sorted filters of each unit vector: all with a score from the threshold on, and the best."""
    width = units.shape[1]
    left, right = _scores(units, size, book)
    limit = threshold / math.sqrt(width)
    out = []
    for a, b in zip(left, right):
        least = min(limit, _nth_best(a, b)) - 1e-9  # rounding must not part equal directions
        i = np.flatnonzero(a >= least - b.max())
        j = np.flatnonzero(b >= least - a.max())
        p, q = np.nonzero(a[i][:, None] + b[j][None, :] >= least)
        out.append(np.sort(i[p] * size + j[q]))
    return out


def _nth_best(a: np.ndarray, b: np.ndarray) -> float:
    """The score of the ``BEST``-th best pair: it lies among the best codes of both halves."""
    n = min(BEST, len(a))
    sums = np.sort(a)[-n:][:, None] + np.sort(b)[-n:][None, :]
    return float(np.sort(sums, axis=None)[-n])


def _unit_rows(flat: np.ndarray, width: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    # The largest component first, so that squares neither overflow nor vanish.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filters_of(units: np.ndarray, how: Layout) -> list[np.ndarray]:
    """The sorted filters of each unit vector over all codebooks of a layout."""
    if not how.books:
        return [np.zeros(1, np.int64)] * len(units)
    found = [[f + book * how.size**2 for f in decode(units, how.size, how.deviations, book)] for book in range(how.books)]
    return [np.concatenate(f) for f in zip(*found)]


def _filters(rows: DataFrame, layouts: dict[tuple[int, int], Layout]) -> DataFrame:
    """``rows`` (rep, grp, width, mult, vec, level) with ``filters``; layouts by width and level."""
    schema = T.StructType([*rows.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            widths, levels = (np.asarray(batch.column(names.index(c))) for c in ("width", "level"))
            for width, level in sorted(set(zip(widths.tolist(), levels.tolist()))):
                part = batch.filter(pa.array((widths == width) & (levels == level)))
                for first in range(0, len(part), 512):
                    rows = part.slice(first, 512)
                    flat = np.asarray(rows.column(names.index("vec")).flatten())
                    found = filters_of(_unit_rows(flat, width), layouts[width, level])
                    cuts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                    filters = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(found).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, filters], names=[*names, "filters"])

    return rows.mapInArrow(run, schema)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For every member the least member that it reaches."""
    label = np.arange(len(linked))
    big = len(linked)
    while True:
        near = np.where(linked, label[None, :], big).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(reps, mult, units, filters, filter_no, chunk, low, high, threshold) -> list[tuple[int, int | None, int]]:
    """Links of one filter and chunk pair: ``(rep, None, links)`` and ``(rep, root, 0)``."""
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    if low != high:
        linked &= chunk[:, None] != chunk[None, :]
    has = linked.any(axis=1)
    if not has.any():
        return []
    keep = np.flatnonzero(has)
    linked, reps, mult = linked[np.ix_(keep, keep)], reps[keep], mult[keep]
    lower = [f[f < filter_no] for f in (filters[i] for i in keep)]
    distinct, slot = np.unique(np.concatenate(lower), return_inverse=True)
    shared = np.zeros((len(keep), max(1, len(distinct))), np.float32)
    shared[np.repeat(np.arange(len(keep)), [len(f) for f in lower]), slot] = 1
    owned = linked & (shared @ shared.T < 0.5)
    links = owned @ mult
    out = [(int(r), None, int(n)) for r, n in zip(reps, links) if n]
    root = _roots(linked)
    return out + [(int(r), int(reps[k]), 0) for r, k in zip(reps, root) if r != reps[k]]


def _links(held: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, n)``: partial link counts (``b`` null) and ties of components."""
    passed = held.select("rep", "grp", "width", F.explode("filters").alias("filter"))
    crowds = passed.groupBy("grp", "width", "filter").agg(F.count("*").alias("size")).where("size > 1")
    crowds = crowds.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    members = durable(passed.join(crowds, ["grp", "width", "filter"]))
    own = F.pmod(F.xxhash64("rep", "filter"), F.col("chunks")).cast("int")
    dealt = members.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    n = dealt.select(F.count("*")).first()[0]
    units = max(1, math.ceil(n / UNIT))
    unit = F.pmod(F.xxhash64("grp", "width", "filter", "low", "high"), F.lit(units))
    work = dealt.select("rep", "grp", "width", "filter", "chunk", "low", "high", unit.alias("unit")).join(
        held.select("rep", "mult", "vec", "filters"), "rep"
    )
    out_arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = ("grp", "width", "filter", "low", "high")
        keys = [np.asarray(table.column(c)) for c in names]
        reps = np.asarray(table.column("rep"))
        order = np.lexsort((reps, *keys[::-1]))
        table = table.take(pa.array(order))
        keys, reps = [k[order] for k in keys], reps[order]
        mult, chunk = np.asarray(table.column("mult")), np.asarray(table.column("chunk"))
        new = np.zeros(len(reps), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        heads = np.append(np.flatnonzero(new), len(reps))
        vectors, lists = table.column("vec").combine_chunks(), table.column("filters").combine_chunks()
        rows: list[tuple] = []
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            if b - a < 2:
                continue
            width = int(keys[1][a])
            units_here = _unit_rows(np.asarray(vectors.slice(a, b - a).flatten()), width)
            part = lists.slice(a, b - a)
            cuts = np.asarray(part.offsets)
            flat = np.asarray(part.values)
            filters = [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
            rows += _compare(reps[a:b], mult[a:b], units_here, filters, keys[2][a], chunk[a:b], keys[3][a], keys[4][a], threshold)
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=out_arrow)

    return work.groupBy("unit").applyInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows are compared when labels are equal and not null and vectors have the same width; they are
    linked from a cosine of ``threshold`` on; at most ``MISS`` of the pairs at just this cosine are
    expected to be missed, in groups of up to ``CHUNK`` vectors none. A vector that is null, empty,
    zero or holds a null or non-finite component links with nothing, as does one with a null label
    or null id: no links, its own component. Other columns are not read, whatever their names. Rows that share an id are vectors of their own but one node for components.
    An empty table gives an empty result. Ids are whole numbers; a null id has no component and is
    kept.
    """
    vec = quoted(vector).cast("array<double>")
    fine = (
        quoted(label).isNotNull() & quoted(id_col).isNotNull() & (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vec, lambda x: x != 0)
    )
    # Single precision travels as it is; it is widened where cosines are taken.
    stored = "array<float>" if vectors.select(quoted(vector)).schema[0].dataType == T.ArrayType(T.FloatType(), True) else "array<double>"
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), F.coalesce(fine, F.lit(False)).alias("fine"), quoted(label).alias("grp"), vec.alias("vec"))
    keyed = rows.withColumn("x", F.xxhash64("grp", "vec")).withColumn("y", F.xxhash64("vec", "grp", F.lit(11)))
    classes = keyed.where("fine").groupBy("x", "y").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    tops = keyed.where("fine").join(classes, ["x", "y"]).where("id = rep").dropDuplicates(["x", "y"])
    # A node per class: ids may repeat, so classes are numbered, and named by their least id later.
    tops = durable(tops.select("rep", "mult", "x", "y", F.xxhash64("grp").alias("grp"), F.size("vec").alias("width"), F.col("vec").cast(stored).alias("vec")))
    nodes = durable(tops.withColumn("node", F.monotonically_increasing_id()))
    # Groups of one width whose sizes round up to the same power of two share a layout.
    groups = durable(nodes.groupBy("grp", "width").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("level")))
    layouts = {(r.width, r.level): layout(2**r.level, r.width, threshold) for r in groups.select("width", "level").distinct().collect()}
    found = nodes.join(groups, ["grp", "width"]).select(F.col("node").alias("rep"), "grp", "width", "mult", "vec", "level")
    held = durable(_filters(found, layouts))
    partial = durable(_links(held, threshold))
    counts = partial.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    named = nodes.select("node", "rep")
    ties = partial.where("b is not null").select("a", "b").distinct()
    ties = ties.join(named.toDF("a", "rep_a"), "a").join(named.toDF("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    joined = durable(components(ties.where("a != b")))
    per_class = (
        nodes.select("x", "y", "node", "rep", "mult")
        .join(counts.withColumnRenamed("a", "node"), "node", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("x", "y", "rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = keyed.select("id", "x", "y", "fine").join(per_class.withColumn("fine", F.lit(True)), ["x", "y", "fine"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
