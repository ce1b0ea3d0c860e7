"""Matroska: exact round trips, every lacing, unknown sizes, broken files."""

import hashlib
import random
import struct
import zlib

import pytest

from trackhouse.llm import media as m


def file_of(*clusters, unknown=False):
    body = m._tracks() + b"".join(clusters)
    head = m.SEGMENT.to_bytes(4, "big")
    return m._header() + (head + b"\x01" + b"\xff" * 7 + body if unknown else m.element(m.SEGMENT, body))


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACING, m.FIXED])
@pytest.mark.parametrize("unknown", [False, True])
def test_lacing(kind, unknown):
    rng = random.Random(kind)
    frames = [bytes(rng.randrange(256) for _ in range(300 if kind == m.FIXED else rng.choice([1, 254, 255, 256, 700, 9000]))) for _ in range(6)]
    block = m.block(1, 5, frames, kind)
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.size_bytes(1) + struct.pack(">hB", -2, 0) + b"tail"))
    cluster = m.uint(m.TIMESTAMP, 100) + block + group
    raw = m.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster if unknown else m.element(m.CLUSTER, cluster)
    data = file_of(raw, raw, unknown=unknown)
    found = m.parse(data)
    assert [data[s : s + n] for _, _, s, n, _ in found.packets] == (frames + [b"tail"]) * 2
    step = m.FRAME_MS * 1_000_000
    assert [t for _, t, *_ in found.packets[:7]] == [105_000_000 + i * step for i in range(6)] + [98_000_000]
    assert found.tracks[0]["codec"] == "A_PCM/INT/LIT" and found.tracks[0]["bits"] == 8


def test_mux_and_cues():
    payload = m.payload_of(bytes(range(256)) * 3000)
    data = m.mux(payload)
    found = m.parse(data)
    assert b"".join(data[s : s + n] for _, _, s, n, _ in found.packets) == payload
    assert [t for _, t, *_ in found.packets] == [i * m.FRAME_MS * 1_000_000 for i in range(len(payload) // m.FRAME)]
    assert len(found.cues) > 1
    assert all(data[at : at + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, at in found.cues)
    assert m.mux(payload) == data


def test_corner_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 288, "x"), (3, "é" * 288, "x"), (None, "z" * 500_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    out = m.read_back(m.store(docs)).collect()
    assert sorted((r.n_bytes, len(r.payload)) for r in out) == [(0, 576), (0, 576), (576, 576), (576, 576), (500_000, 500_544)]
    assert len({(bytes(r.media), r.feature) for r in out if r.doc_id == 3}) == 1
    broken = spark.createDataFrame([(1, b"\x1a"), (2, None), (3, m.mux(b"a" * 576)[:-5])], "doc_id long, media binary")
    assert [r.payload for r in m.read_back(broken).collect()] == [None] * 3
    table = m.packets(broken, "doc_id").collect()
    assert sorted(r.doc_id for r in table) == [1, 3] and all(r.error for r in table)
    assert m.read_back(m.store(docs.limit(0))).count() == 0


def test_query(spark, small_dir):
    from trackhouse.llm import queries

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.all_queries()["op9_matroska"](spark, small_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = m.payload_of(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(docs[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes > r.payload_bytes
