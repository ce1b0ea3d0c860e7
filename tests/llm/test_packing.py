"""Pieces and their packing: every token once, no gaps, near the least number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyspark.sql.types as T
from tokenizers import Tokenizer

from trackhouse.llm import packing

PATH = P.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("offset", T.StringType())])


def check(rows, capacity):
    """Sequences are gapless and within capacity; returns how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_cut_pieces(spark):
    texts = [None, "", "a b c", "word " * 40, "word " * 31 + "x", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = packing.cut(docs, PATH, capacity=16, keep_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert np.concatenate([np.frombuffer(bytes(r.ids), np.uint32) for r in own]).tolist() == ids
        assert all(r.length == 16 for r in own[1:]) and own[0].length <= 16
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], np.uint32)
            assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_pack_many_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    rng = random.Random(3)
    rows = [(i, rng.choice([rng.randrange(1, 100), 100, 50, 3])) for i in range(700)] + [(1, 50)] * 5
    table = spark.createDataFrame(rows, "doc_id long, length long").repartition(3)
    out = packing.pack(table, capacity=100).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted(rows)
    least = -(-sum(n for _, n in rows) // 100)
    assert check(out, 100) <= least * 1.03 + 1


def test_lengths_that_fit_nowhere_and_clashing_names(spark):
    table = spark.createDataFrame([(1, None, "x"), (2, 0, "y"), (3, 101, "z"), (4, 100, "u"), (5, 7, "v")],
                                  "doc_id long, length long, offset string")
    out = {r.doc_id: r for r in packing.pack(table, capacity=100).collect()}
    assert [out[i].sequence_id for i in (1, 2, 3)] == [None] * 3
    assert out[4].offset == 0 and out[5].offset == 0 and out[4].sequence_id != out[5].sequence_id


def test_empty_table(spark):
    assert packing.pack(packing.cut(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


def test_crossover_keeps_every_piece():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 64) for _ in range(200)]
    one, other = (packing._fresh(lengths, 64, noise, rng) for noise in (0, 30))
    for _ in range(20):
        child = packing.crossover(one, other, rng)
        assert sorted(i for b in child.bins for i in b) == list(range(200))
        assert all(0 <= r == 64 - sum(lengths[i] for i in b) for b, r in zip(child.bins, child.rooms))
        one, other = other, child


def test_query(spark, small_dir):
    from trackhouse.llm import queries

    rows = queries.all_queries()["op6_best_fit_packing"](spark, small_dir).collect()
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").count()
    assert len({r.doc_id for r in rows}) == docs
    n = check(rows, 1024)
    assert n <= sum(r.length for r in rows) / 1024 * 1.03 + 1
