"""The pipeline stage by stage against plain versions of what each should keep."""

import random
import re
from collections import defaultdict

import corpus_pipeline as p
import pytest

from trackhouse.llm import bpe, packing, words

from .test_minhash import shingle_set
from .test_packing import check
from .test_repeats import brute as repeats_brute


@pytest.fixture(scope="module")
def tables(spark, small_dir):
    """The result of every stage over the small table, the input first."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in p.STAGES:
        rows = stage(spark, docs, small_dir).collect()
        out.append(rows)
        if "sequence_id" not in rows[0].asDict():
            assert rows[0].asDict().keys() == out[0][0].asDict().keys()
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def groups_of(rows):
    sets = {r.doc_id: shingle_set(r.text, 5) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


def test_filters_keep_clean_documents(tables, spark, small_dir):
    docs, known, mild = tables[:3]
    lettered = {r.doc_id for r in docs if r.text and re.search(r"[^\W\d_]", r.text)}
    kept = {r.doc_id for r in known}
    assert kept <= lettered and len(kept) >= 0.97 * len(lettered)
    toxic = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("toxic = 1").collect()}
    clean = kept - toxic
    assert len({r.doc_id for r in mild} & clean) >= 0.97 * len(clean)
    by_id = {r.doc_id: r for r in docs}
    assert all(r == by_id[r.doc_id] for r in mild)


def test_near_copies(tables):
    root = groups_of(tables[2])
    assert sorted(r.doc_id for r in tables[3]) == sorted({r for r in root.values()})


def test_repeats(tables):
    expected = {d: text for d, _, _, text in repeats_brute(sorted((r.doc_id, r.text) for r in tables[3]))}
    assert {r.doc_id: r.text for r in tables[4]} == expected
    assert all(r.n_chars == len(r.text) for r in tables[4])


def test_packing(tables):
    assert {r.doc_id for r in tables[5]} == {r.doc_id for r in tables[4]}
    pieces = defaultdict(list)
    for r in tables[5]:
        pieces[r.doc_id].append((r.start, r.length))
    for own in pieces.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
    check(tables[5], 1024)


def test_repeated_rows_null_ids_and_empty_tables(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    text = " ".join(f"w{random.Random(1).randrange(99)}{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text, "en", "s", 1), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, docs.schema)
    assert sorted(str(r.doc_id) for r in p.one_of_near_copies(spark, table, small_dir).collect()) == ["1", "None", "None"]
    for _, stage in p.STAGES:
        assert stage(spark, table.limit(0), small_dir).count() == 0


def test_run(spark, small_dir, tables):
    rows = p.run(spark, small_dir).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in rows} == {(r.doc_id, r.piece, r.ids_crc32) for r in tables[5]}


def test_near_copies_do_not_depend_on_ids(spark, small_dir):
    schema = spark.read.parquet(f"{small_dir}/documents.parquet").schema
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(5, two), (5, one), (1, one + " end"), (5, three), (7, three), (7, two + " end"), (5, three)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    got = p.one_of_near_copies(spark, docs, small_dir).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, one + " end"), (5, two), (5, three)]


def test_stages_begin_with_workers_that_forgot(spark, small_dir, monkeypatch):
    """The first stage drops what an earlier run left in the workers, and the search for a packing begins without encoders."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    held = []

    def look(batches):
        for b in batches:
            yield type(b).from_pydict({"id": [bpe.encoder.cache_info().currsize + words._powers.cache_info().currsize] * b.num_rows})

    def seen():
        return {r.id for r in spark.range(0, 8, 1, 8).mapInArrow(look, "id long").collect()}

    def pack(pieces, **options):
        held.append(seen())
        return pieces

    packing.cut(docs.repartition(8), p.TOKENIZER).count()
    assert seen() != {0}
    p.known_language(spark, docs, small_dir)
    assert seen() == {0}
    monkeypatch.setattr(p.packing, "pack", pack)
    p.packed(spark, docs.repartition(8), small_dir).count()
    assert held == [{0}]
