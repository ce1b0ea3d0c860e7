"""Exact centroid clustering of whole-number vectors behind a PCA-rotated filter.

The covariance of all vectors gives a rotation. Per vector the leading rotated coordinates and the
norm of the rest are stored once beside it. For a centroid the squared distance of these coordinates
plus the squared difference of the residual norms is never more than the squared distance of the
whole vectors, so centroids whose bound lies above an exact distance at hand are out; those that
survive are compared in whole numbers. The filter only saves work: results do not depend on it.

Vectors are never shuffled. A round reads the stored table once and sends on one row per task,
centroid and component. The rotation, centroids and sums are bounded by the parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackhouse.llm.columns import quoted
from trackhouse.llm.exact import as_stored, finite, gathered, totals, whole
from trackhouse.session import durable

WIDTH, CENTROIDS, ROUNDS = 64, 40, 5
#: Leading rotated coordinates that are stored.
LEADING = 16
#: Share of the squared norms by which rounding may lift a bound (single precision: about 1e-7).
SLACK = 1e-5
#: Vectors of a slice, and pairs that are verified at once.
SLICE, PAIRS = 8192, 8192


@dataclass(frozen=True)
class Rotation:
    """The mean, and the directions of largest spread as columns."""

    mean: np.ndarray
    axes: np.ndarray

    def turn(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of what they leave."""
        centred = rows - self.mean
        lead = centred @ self.axes
        rest = (centred * centred).sum(axis=1) - (lead * lead).sum(axis=1)
        return lead, np.sqrt(np.maximum(rest, 0))


def rotation(kept: DataFrame, width: int, leading: int) -> Rotation:
    """Principal directions from the moments of all rows of ``kept`` (``vec``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One more component, always 1, so that the moments hold sums and count too.
        moments = np.zeros((width + 1, width + 1))
        for batch in gathered(batches, SLICE):
            rows = np.ones((batch.num_rows, width + 1))
            rows[:, :width] = whole(batch.column(0), width)
            moments += rows.T @ rows
        if moments[width, width]:
            i, j = np.triu_indices(width + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(moments[i, j])], names=["i", "j", "total"]
            )

    partial = kept.select("vec").mapInArrow(run, "i int, j int, total double")
    moments = np.zeros((width + 1, width + 1))
    for r in partial.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        moments[r.i, r.j] = moments[r.j, r.i] = r.total
    mean = moments[:width, width] / moments[width, width]
    spread = moments[:width, :width] / moments[width, width] - np.outer(mean, mean)
    return Rotation(mean, np.linalg.eigh(spread)[1][:, ::-1][:, :leading])


def _distances(rows: np.ndarray, centroids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs ``rows[i]``, ``centroids[j]`` in whole numbers."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), PAIRS):
        gaps = rows[i[a : a + PAIRS]] - centroids[j[a : a + PAIRS]]
        out[a : a + PAIRS] = np.einsum("ij,ij->i", gaps, gaps)
    return out


def nearest(
    rows: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turned: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every row (ties: the smaller number), its squared distance, and how
    many pairs were verified."""
    c_lead, c_rest = turned
    own = (lead * lead).sum(axis=1)
    theirs = (c_lead * c_lead).sum(axis=1)
    least = own[:, None] + theirs - 2 * (lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    least -= SLACK * ((own + rest * rest)[:, None] + theirs + c_rest * c_rest) + 1e-3
    every = np.arange(len(rows))
    guess = least.argmin(axis=1)
    at_most = _distances(rows, centroids, every, guess)
    alive = least <= at_most[:, None]
    alive[every, guess] = True
    i, j = np.nonzero(alive)
    found = _distances(rows, centroids, i, j)
    heads = np.searchsorted(i, every)
    best = np.minimum.reduceat(found, heads) if len(i) else found
    # Pairs stand by row and centroid, so the first hit of a row has the smallest number.
    hits = np.flatnonzero(found == best[i])
    return j[hits[np.searchsorted(i[hits], every)]], best, len(i)


def _prepared(kept: DataFrame, turn: Rotation, width: int) -> DataFrame:
    """``id, vec`` with ``lead`` and ``rest``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                lead, rest = turn.turn(whole(part.column(1), width))
                cuts = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1])
                leads = pa.ListArray.from_arrays(cuts, pa.array(lead.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, leads, pa.array(rest.astype(np.float32))], names=["id", "vec", "lead", "rest"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return durable(kept.select("id", "vec").mapInArrow(run, f"id {kinds['id']}, vec {kinds['vec']}, lead array<float>, rest float"))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            part = batch.slice(first, SLICE)
            named = dict(zip(part.schema.names, part.columns))
            lead = np.asarray(named["lead"].flatten()).astype(np.float64).reshape(part.num_rows, -1)
            yield part, whole(named["vec"], width), lead, np.asarray(named["rest"]).astype(np.float64)


def _moved(stored: DataFrame, centroids: np.ndarray, turn: Rotation) -> np.ndarray:
    """Centroids after one round: exact floors of the means, empty ones unchanged."""
    k, width = centroids.shape
    turned = turn.turn(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros((k, width + 1), np.int64)
        for _, rows, lead, rest in _slices(batches, width):
            chosen = nearest(rows, lead, rest, centroids, turned)[0]
            np.add.at(summed, chosen, np.column_stack([rows, np.ones(len(rows), np.int64)]))
        if summed[:, width].any():
            at = np.indices(summed.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(summed.ravel())], names=["cluster", "place", "total"])

    partial = stored.select("vec", "lead", "rest").mapInArrow(run, "cluster int, place int, total long")
    found = totals(partial, ["cluster", "place"], "total")
    new = centroids.copy()
    for c in range(k):
        if n := found.get((c, width), 0):
            new[c] = [found[c, d] // n for d in range(width)]
    return new


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", width: int = WIDTH,
    centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2:", leading: int = LEADING,
) -> tuple[DataFrame, np.ndarray]:
    """``(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable
    vector, and the final centroids.

    Vectors that are null, of another width, or hold a null or non-finite component are dropped.
    Centroids start from the ids with the smallest SHA-256 of ``salt`` and the id in decimal (rows that
    share an id in the order of their vectors; rows without an id start none, but are clustered), fewer
    where there are fewer. Repeated rows count as often as they stand. Components of 2**18 and more stop
    the run with a message, because distances would leave 64 bits. Other columns are ignored, whatever
    their names. Without usable rows the result is empty.
    """
    session = vectors.sparkSession
    kept = vectors.where(finite(vector) & (F.size(quoted(vector)) == width)).select(
        quoted(id_col).alias("id"), as_stored(vectors, vector).alias("vec")
    )
    place = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    start = kept.where("id is not null").orderBy(place, "vec").limit(centroids).select("vec").toArrow()["vec"]
    out = f"`{id_col}` {kept.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(start):
        return session.createDataFrame([], out), np.zeros((0, width), np.int64)
    centres = np.concatenate([whole(c, width) for c in start.chunks])
    turn = rotation(kept, width, min(leading, width))
    stored = _prepared(kept, turn, width)
    for _ in range(rounds):
        centres = _moved(stored, centres, turn)
    turned = turn.turn(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, lead, rest in _slices(batches, width):
            chosen, distance, _ = nearest(rows, lead, rest, centres, turned)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chosen.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    found = durable(stored.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    inertia = totals(found, ["cluster"], "distance")
    total = sum(inertia.values())
    facts = [
        (c, inertia.get((c,), 0), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centres.tolist())
    ]
    named = session.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most one row per centroid, so its size is bounded by the parameter.
    joined = found.join(F.broadcast(named), "cluster", "left")
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centres
