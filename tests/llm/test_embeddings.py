"""Vector links against all pairs."""

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import pytest

from trackhouse.llm import embeddings, queries

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("rep", T.StringType())])


def brute(rows, threshold=0.93):
    """Links of every row (by position), and components by id."""
    n = len(rows)
    fine = [r[0] is not None and r[2] is not None and bool(r[1]) and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) for r in rows]
    links, parent = [0] * n, {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if f else None for r, f in zip(rows, fine)]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return links, {i: root(i) for i in parent}


def sample():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(14):
        base = rng.standard_normal(24)
        for _ in range(rng.choice([1, 3, 30])):
            noise = rng.choice([0.0, 0.1, 0.25])
            rows.append((n, (base + noise * rng.standard_normal(24)).tolist(), int(rng.integers(2))))
            n += 1
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(20)] + [(2000, rows[3][1], None), (2001, [2 * x for x in rows[3][1]], rows[3][2])]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [float("nan")] * 24, 1), (3004, [None] + [1.0] * 23, 1), (3005, [float("inf")] + [1.0] * 23, 1),
             (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [1e-30] * 24, 1), (3009, [1e30] * 24, 1), (3010, [1.0], 1), (3011, [2.0], 1)]
    return rows


@pytest.mark.parametrize("chunk", [256, 7])
def test_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = sample()
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    links, component = brute(rows)
    assert {i: r.n_links for i, r in got.items()} == {r[0]: n for r, n in zip(rows, links)}
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (i == component[i]) for i, r in got.items())


def test_repeated_and_null_ids(spark):
    v, w = [1.0, 2.0, 3.0], [-1.0, 0.5, 0.0]
    rows = [(5, v, 1, ""), (5, v, 1, ""), (5, w, 1, ""), (4, w, 1, ""), (None, v, 1, "")]
    got = sorted((r.vec_id or -1, r.n_links) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0), (4, 1), (5, 1), (5, 1), (5, 1)]


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_list_decoding_finds_every_filter():
    rng = np.random.default_rng(1)
    units = rng.standard_normal((40, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    size, deviations = embeddings.plan(300)
    rotation, one, two = embeddings.codes(16, size)
    turned = units @ rotation
    scores = (turned[:, :8] @ one.T)[:, :, None] + (turned[:, 8:] @ two.T)[:, None, :]
    for own, found in zip(scores, embeddings.decode(units, size, deviations)):
        flat = own.ravel()
        least = min(deviations / 4, np.sort(flat)[-embeddings.BEST])
        assert set(np.flatnonzero(flat >= least + 1e-12)) <= set(found) and len(found) >= embeddings.BEST


def test_query_recall(spark, small_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    links, component = brute(rows)
    got = {r.vec_id: r for r in queries.all_queries()["op7_embedding_dedup"](spark, small_dir).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    assert all(got[r[0]].n_links <= n for r, n in zip(rows, links))
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links)


@pytest.mark.parametrize("largest", [300, 1000, 10_000, 100_000, 1_000_000])
@pytest.mark.parametrize("width", [24, 64])
def test_pairs_share_a_filter_at_every_size(largest, width):
    how = embeddings.layout(largest, width, 0.93)
    assert how.books
    one, two = embeddings.pairs_at(np.random.default_rng(7), 1000, width, 0.931)
    found = zip(embeddings.filters_of(one, how), embeddings.filters_of(two, how))
    assert np.mean([np.intersect1d(a, b).size > 0 for a, b in found]) >= 0.995


@pytest.mark.parametrize("width", [1, 2, 3])
def test_narrow_vectors_have_filters_too(width):
    how = embeddings.layout(2048, width, 0.93)
    assert how.books
    one, two = embeddings.pairs_at(np.random.default_rng(8), 500, width, 0.931)
    found = zip(embeddings.filters_of(one, how), embeddings.filters_of(two, how))
    assert np.mean([np.intersect1d(a, b).size > 0 for a, b in found]) >= 0.995


def test_links_through_filters_equal_all_pairs(spark):
    """Labels of 1,500 and 40 vectors with groups of near copies: links and components by brute force."""
    rng = np.random.default_rng(5)
    rows = []
    for label, groups in ((0, 300), (1, 8)):
        for _ in range(groups):
            base = rng.standard_normal(32)
            rows += [(len(rows) + i, (base + 0.2 * rng.standard_normal(32)).astype(np.float32).tolist(), label) for i in range(5)]
    assert embeddings.layout(2048, 32, 0.93).books
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert linked.sum() > 1000
    assert all(got[i] <= n for i, n in enumerate(linked.sum(axis=1)))
    assert sum(got.values()) >= 0.998 * linked.sum()


def test_planted_pairs_in_a_large_label(spark):
    """Random vectors of width 64 are never near each other, so the planted pairs are all links."""
    rng = np.random.default_rng(11)
    n, planted, width = 100_000, 1000, 64
    one, two = zip(*(embeddings.pairs_at(rng, planted // 4, width, c) for c in (0.931, 0.94, 0.95, 0.96)))
    rest = rng.standard_normal((n - 2 * planted, width))
    vectors = np.concatenate([*one, *two, rest]).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), width).cast(pa.list_(pa.float32())), "label": np.zeros(n, np.int32)})
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(table)).where("n_links > 0 or not kept").collect()}
    hits = [i for i in range(planted) if i in got and got[i].n_links == 1 and got[planted + i].component_id == i]
    assert set(got) <= set(range(2 * planted)) and len(got) == 2 * len(hits)
    assert len(hits) >= 0.99 * planted
