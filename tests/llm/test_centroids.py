"""The filter never loses the nearest centroid; clusters equal plain loops; odd rows."""

import hashlib
import math

import numpy as np
import pytest

from trackhouse.llm import centroids
from trackhouse.llm.centroids import Rotation, cluster, nearest


@pytest.mark.parametrize("scale, leading", [(3, 2), (300, 5), (1 << 25, 3), (40, 12)])
def test_filter_keeps_the_nearest(scale, leading, monkeypatch):
    monkeypatch.setattr(centroids, "PAIRS", 100)
    rng = np.random.default_rng(scale)
    rows = rng.integers(-scale, scale, (400, 12)) * np.array([4, 3, 2] + [1] * 9) // 4
    centres = rows[rng.integers(0, 400, 30)].copy()
    centres[17] = centres[3]
    spread = np.cov(rows.T)
    turn = Rotation(rows.mean(axis=0), np.linalg.eigh(spread)[1][:, ::-1][:, :leading])
    lead, rest = (x.astype(np.float32).astype(np.float64) for x in turn.turn(rows))
    chosen, distance, verified = nearest(rows, lead, rest, centres, turn.turn(centres))
    every = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (chosen == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert verified < every.size


def test_filter_spares_most_pairs():
    """Vectors around separated centres: hardly more than one survivor each."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (40, 64)).astype(np.int64)
    rows = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 4, (3000, 64)).astype(np.int64)
    turn = Rotation(rows.mean(axis=0), np.linalg.eigh(np.cov(rows.T))[1][:, ::-1][:, :16])
    assert nearest(rows, *turn.turn(rows), centres, turn.turn(centres))[2] < 1.05 * len(rows)


def plain(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    order = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None))
    centres = [q for _, q in order][:k]
    assign = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        chosen = [assign(q)[1] for _, q in kept]
        mine = [[q for (_, q), c in zip(kept, chosen) if c == n] for n in range(len(centres))]
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else centres[n] for n, m in enumerate(mine)]
    found = [(i, *assign(q)) for i, q in kept]
    inertia = [sum(d for _, d, c in found if c == n) for n in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inertia[c], sum(inertia), names[c]) for i, d, c in found], centres


def test_equals_plain_loops_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(centroids, "SLICE", 40)
    rng = np.random.default_rng(8)
    fine = [(int(i), rng.normal(0, 0.3, 6).tolist()) for i in range(150)]
    fine += [(7, fine[0][1]), (7, fine[0][1]), (None, fine[1][1]), (900, [0.0] * 6)] + [(1000 + i, [0.25] * 6) for i in range(70)]
    bad = [(1, None), (2, [None] + [0.0] * 5), (3, [float("nan")] * 6), (4, [float("-inf")] * 6), (5, []), (200, [0.5] * 7)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in fine + bad], "vec_id long, embedding array<double>, cluster int, id string").repartition(5)
    found, centres = cluster(frame, width=6, centroids=9, leading=2)
    want, plain_centres = plain(fine, 9, 5)
    assert centres.tolist() == plain_centres
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))


def test_few_rows_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    empty, centres = cluster(spark.createDataFrame([], schema), width=2)
    assert empty.collect() == [] and len(centres) == 0
    found, centres = cluster(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], schema), width=2)
    assert len(centres) == 2 and [r.cluster for r in found.collect()] == [0, 0]
    with pytest.raises(ValueError, match="64 bits"):
        cluster(spark.createDataFrame([(1, [1e9, 1.0])], schema), width=2)
