"""Trie against plain distances, codes against a plain loop, and rows that are not as expected."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from trackhouse.llm import exact, trie_codes
from trackhouse.llm.trie_codes import Trie

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


@pytest.mark.parametrize("spread, block", [(3, 2048), (3, 1), (1000, 5), (1 << 25, 7)])
def test_trie_equals_all_distances(spread, block, monkeypatch):
    monkeypatch.setattr(trie_codes, "BLOCK", block)
    rng = np.random.default_rng(spread)
    parts, entries = rng.integers(-spread, spread, (700, 4)), rng.integers(-spread, spread, (9, 4))
    entries[5] = entries[2]
    trie = Trie(parts)
    chosen, distance = trie.nearest(entries)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (chosen[trie.leaf] == every.argmin(axis=1)).all()
    assert (distance[trie.leaf] == every.min(axis=1)).all()
    assert len(trie.distinct) == len(np.unique(parts, axis=0)) and trie.weights.sum() == len(parts)
    sums = trie.sums(chosen, 9)
    for e in range(9):
        mine = parts[every.argmin(axis=1) == e]
        assert sums[e, 0] == len(mine) and (sums[e, 1:] == mine.sum(axis=0)).all()


def plain(rows, parts, entries, rounds):
    """Codes by single loops over whole numbers: ``[(id, label, code, error)]`` and the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows]
    step = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * step : (p + 1) * step]
    first = [q for i, q, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))][:entries]
    books = [[cut(q, p) for q in first] for p in range(parts)]
    assign = lambda q, p: min((sum((a - b) ** 2 for a, b in zip(cut(q, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            chosen = [assign(q, p)[1] for _, q, _ in kept]
            mine = [[cut(q, p) for (_, q, _), c in zip(kept, chosen) if c == k] for k in range(len(first))]
            new.append([[sum(x) // len(m) for x in zip(*m)] if m else books[p][k] for k, m in enumerate(mine)])
        books = new
    out = []
    for i, q, g in kept:
        found = [assign(q, p) for p in range(parts)]
        out.append((i, g, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def test_equals_plain_loops_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie_codes, "SLICE", 50)
    rng = np.random.default_rng(3)
    fine = [(int(i), rng.normal(0, 0.2, 8).astype(np.float32).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(120)]
    fine += [(7, fine[0][1], 1), (7, fine[0][1], 1), (None, fine[1][1], None), (9999, [0.0] * 8, 2)] + [(500 + i, [0.25] * 8, 0) for i in range(60)]
    bad = [
        (1, None, 1), (2, [None] + [0.0] * 7, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, None), (5, [], 1),
        (200, [0.5] * 4, 1), (201, [0.5] * 7, 1),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in fine + bad], SCHEMA).repartition(5)
    found, books = trie_codes.compress(frame, parts=4, entries=12)
    want, plain_books = plain(fine, 4, 12, 2)
    assert books.tolist() == plain_books
    label = {}
    for _, g, _, e in want:
        label[g] = label.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in plain_books for e in p for x in e).encode()).hexdigest()
    got = sorted(map(repr, (tuple(r) for r in found.collect())))
    assert got == sorted(repr((i, c, e, label[g], digest)) for i, g, c, e in want)


def test_facts_of_hot_and_cold_keys(spark, monkeypatch):
    """More facts than may be broadcast: hot keys by broadcast, the rest by a shuffle, null included."""
    monkeypatch.setattr(exact, "SMALL", 2)
    monkeypatch.setattr(exact, "HOT", 4)
    keys = ["a"] * 50 + ["b"] * 2 + ["c"] + [None] * 3 + ["d"]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    facts = spark.createDataFrame([("a", 50, 1), ("b", 2, 2), ("c", 1, 3), (None, 3, 4)], "k string, n long, fact int")
    got = {(r.id, r.k, r.fact) for r in exact.attach(rows, facts, "k", "n", "fact").collect()}
    want = {"a": 1, "b": 2, "c": 3, None: 4}
    assert got == {(i, k, want.get(k)) for i, k in enumerate(keys)}


def test_empty_table_and_limits(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    found, books = trie_codes.compress(empty)
    assert found.collect() == [] and books.size == 0
    assert [f.dataType for f in found.schema.fields] == [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    with pytest.raises(ValueError, match="two hex digits"):
        trie_codes.compress(empty, entries=257)
    with pytest.raises(ValueError, match="64 bits"):
        trie_codes.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], "vec_id long, embedding array<double>, label int"))
