"""Product codes of whole-number vectors by a trie over their distinct parts.

The parts of one position are sorted, equal ones folded, and read as a lexicographic trie: a node
stands for a prefix of components. Going down, a node adds the squared gap of its component to the
distances that its parent has to all entries of the codebook, so a shared prefix is paid once. The
walk is depth-first over blocks of siblings: at any time one block per depth is held. A leaf takes
the nearest entry and adds its part, weighted by how often it occurs, to that entry's sums.

Vectors are never shuffled. Every task folds, walks and sums its own slices; what it sends on is one
row per position, entry and component. Codebooks and these sums are bounded by the parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackhouse.llm.columns import quoted
from trackhouse.llm.exact import as_stored, attach, finite, gathered, totals, whole
from trackhouse.session import durable

#: Consecutive parts of a vector, entries of a codebook, rounds of learning.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose parts make one trie, and siblings that are expanded at once.
SLICE, BLOCK = 32_768, 2048


class Trie:
    """The distinct rows of a matrix of whole numbers as a lexicographic trie."""

    def __init__(self, parts: np.ndarray):
        order = _sorted_order(parts)
        rows = parts[order]
        n, width = rows.shape
        new = np.zeros(n, bool)
        new[:1] = True
        marks = []
        for d in range(width):
            new[1:] |= rows[1:, d] != rows[:-1, d]
            marks.append(new.copy())
        starts = [np.flatnonzero(m) for m in marks]
        #: Per depth: the component of every node, its parent, and where the children of a parent begin.
        self.values = [rows[s, d] for d, s in enumerate(starts)]
        self.parents = [np.zeros(len(starts[0]), np.int64)]
        self.parents += [np.searchsorted(a, b, "right") - 1 for a, b in zip(starts, starts[1:])]
        counts = [1] + [len(s) for s in starts[:-1]]
        self.heads = [np.searchsorted(p, np.arange(c + 1)) for p, c in zip(self.parents, counts)]
        self.distinct = rows[starts[-1]]
        self.weights = np.diff(np.append(starts[-1], n))
        #: The leaf of every row of the matrix.
        self.leaf = np.empty(n, np.int64)
        self.leaf[order] = np.cumsum(marks[-1]) - 1

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of ``entries`` for every leaf, ties to the lower index, and its squared distance."""
        chosen = np.empty(len(self.distinct), np.int64)
        distance = np.empty(len(self.distinct), np.int64)
        last = len(self.values) - 1

        def visit(depth: int, low: int, high: int, reached: np.ndarray) -> None:
            head = self.heads[depth]
            for a in range(head[low], head[high], BLOCK):
                b = min(head[high], a + BLOCK)
                gaps = self.values[depth][a:b, None] - entries[None, :, depth]
                here = reached[self.parents[depth][a:b] - low] + gaps * gaps
                if depth == last:
                    chosen[a:b] = here.argmin(axis=1)
                    distance[a:b] = here.min(axis=1)
                else:
                    visit(depth + 1, a, b, here)

        if len(self.distinct):
            visit(0, 0, 1, np.zeros((1, len(entries)), np.int64))
        return chosen, distance

    def sums(self, chosen: np.ndarray, size: int) -> np.ndarray:
        """Per entry the number of parts and, component by component, their sum."""
        out = np.zeros((size, 1 + self.distinct.shape[1]), np.int64)
        np.add.at(out[:, 0], chosen, self.weights)
        np.add.at(out[:, 1:], chosen, self.distinct * self.weights[:, None])
        return out


def _sorted_order(parts: np.ndarray) -> np.ndarray:
    """The lexicographic order of the rows, by one packed key where their ranges allow it."""
    low, high = parts.min(axis=0), parts.max(axis=0)
    spans = [int(x) for x in high - low + 1]
    room = 1
    for s in spans:
        room *= s
    if room >= 1 << 62:
        return np.lexsort(parts.T[::-1])
    key = np.zeros(len(parts), np.int64)
    for d, s in enumerate(spans):
        key = key * s + (parts[:, d] - low[d])
    return np.argsort(key, kind="stable")


def _learned(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: exact floors of the means, entries without parts unchanged."""
    parts, size, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros((parts, size, 1 + step), np.int64)
        seen = False
        for batch in gathered(batches, SLICE):
            seen = True
            rows = whole(batch.column(0), parts * step)
            for p in range(parts):
                trie = Trie(rows[:, p * step : (p + 1) * step])
                summed[p] += trie.sums(trie.nearest(books[p])[0], size)
        if seen:
            at = np.indices(summed.shape).reshape(3, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(summed.ravel())], names=["part", "entry", "place", "total"])

    partial = kept.select("vec").mapInArrow(run, "part int, entry int, place int, total long")
    found = totals(partial, ["part", "entry", "place"], "total")
    new = books.copy()
    for p in range(parts):
        for e in range(size):
            if n := found.get((p, e, 0), 0):
                new[p, e] = [found[p, e, 1 + d] // n for d in range(step)]
    return new


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """``(id_col, code, error, label_error, codebooks_sha256)`` of every usable vector, and the codebooks.

    Vectors that are null or hold a null or non-finite component are dropped; so are those whose width
    is not that of the smallest id with a width that is a positive multiple of ``parts``. Codebooks
    start from the ``entries`` smallest ids (rows that share an id in the order of their vectors; rows
    without an id start none, but are coded), fewer where there are fewer. Repeated rows count as often
    as they stand. Null labels are one label. Components of 2**18 and more stop the run with a message,
    because distances would leave 64 bits. Other columns are ignored, whatever their names. Without
    usable rows the result is empty.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    session = vectors.sparkSession
    rows = vectors.where(finite(vector)).select(
        quoted(id_col).alias("id"), quoted(label).alias("grp"), as_stored(vectors, vector).alias("vec")
    )
    fitting = rows.where((F.size("vec") > 0) & (F.size("vec") % parts == 0) & F.col("id").isNotNull())
    first = fitting.orderBy("id", "vec").select(F.size("vec").alias("width")).first()
    out = f"`{id_col}` {vectors.select(quoted(id_col)).schema[0].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if first is None:
        return session.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64)
    width = first.width
    kept = rows.where(F.size("vec") == width)
    start = kept.where("id is not null").orderBy("id", "vec").limit(entries).select("vec").toArrow()["vec"]
    seeds = np.concatenate([whole(c, width) for c in start.chunks])
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _learned(kept, books)
    step = width // parts
    digits = np.array([f"{e:02x}" for e in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, SLICE):
            rows = whole(batch.column(2), width)
            codes, error = np.empty((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
            for p in range(parts):
                trie = Trie(rows[:, p * step : (p + 1) * step])
                chosen, distance = trie.nearest(books[p])
                codes[:, p] = chosen[trie.leaf]
                error += distance[trie.leaf]
            text = ["".join(r) for r in digits[codes]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(error)], names=["id", "grp", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    coded = durable(kept.mapInArrow(run, f"id {kinds['id']}, grp {kinds['grp']}, code string, error long"))
    sums = durable(coded.groupBy("grp").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    found = attach(coded, sums, "grp", "n", "label_error")
    return found.select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256")
    ), books
