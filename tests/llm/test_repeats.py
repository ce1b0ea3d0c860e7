"""Substring removal against a plain loop over all windows."""

import random
import re

import pyspark.sql.types as T
import pytest

from trackhouse.llm import repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("slice_no", T.StringType()), T.StructField("n_words", T.StringType())])


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1500)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2500)


def brute(rows, window=20):
    """Kept words by document, rows in corpus order."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def sample():
    rng = random.Random(5)
    word = lambda: rng.choice(["la", "é", "über", "x" * 50, "The", "the"]) + str(rng.randrange(400))
    passages = [" ".join(word() for _ in range(rng.choice([19, 20, 21, 35, 60]))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(2), rng.choice(passages))
        rows.append((i, rng.choice(["  ", "\n", "\t "]).join(parts)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a " * 900), (204, "a " * 30), (205, "a b " * 40)]
    rows += [(300 + i, passages[0] + " " + passages[1]) for i in range(40)]
    return rows


def test_equals_all_windows(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], SCHEMA).repartition(5)
    out = repeats.remove_repeats(docs)
    got = out.collect()
    assert out.columns == ["doc_id", "slice_no", "text", "n_words", "n_removed", "removed"]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in got) == sorted(brute(rows))
    assert all(r.slice_no == "c" for r in got)
    assert [r.text for r in got if r.doc_id == 200] == [None]
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.removed)


def test_ties_nulls_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text), (7, text), (None, text), (None, text), (3, text)]
    got = repeats.remove_repeats(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [
        (False, 3, 0), (False, 7, 30), (False, 7, 30), (True, 0, 30), (True, 0, 30)]
    same = repeats.remove_repeats(spark.createDataFrame([(7, text, "", "")] * 3, SCHEMA)).collect()
    assert sorted(r.n_removed for r in same) == [0, 30, 30]


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, small_dir):
    from trackhouse.llm import queries

    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    expected = {d: (n, r) for d, n, r, _ in brute(sorted((x.doc_id, x.text) for x in docs))}
    rows = queries.all_queries()["op8_substring_dedup"](spark, small_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in rows} == expected
