"""Ids, offsets and decoding against the reference library, with awkward texts."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyspark.sql.types as T
import tiktoken

from trackhouse.llm import bpe, tokens

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", "it's 's 'sample ''s\n's", "x" * 5000, "éà 中文 😀 ½ Ⅷ​\x1c\x85", "  two  \n\n b ", "<|endoftext|>"]


def _library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def _docs(spark, texts):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("ids", T.StringType())])
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], schema)


def test_round_trip_and_offsets(spark):
    library, texts = _library(), TEXTS * 3
    out = tokens.decode(tokens.encode(_docs(spark, texts), RANKS, offsets=True), RANKS).collect()
    assert len(out) == len(texts)
    for row in out:
        text = texts[row.doc_id] or ""
        ids = np.frombuffer(bytes(row.ids), np.uint32).tolist()
        assert ids == library.encode_ordinary(text) and row.n_tokens == len(ids)
        assert bytes(row.decoded) == text.encode()
        assert row.text == texts[row.doc_id]
        _, starts = library.decode_with_offsets(ids) if ids else ("", [])
        assert row.char_start == starts
        assert all(s < e for s, e in zip(row.char_start, row.char_end))
        assert not ids or row.char_end[-1] == len(text)


def test_tokenizer_file_gives_the_same_ids(spark):
    library = _library()
    for row in tokens.encode(_docs(spark, TEXTS), P.path("byte_bpe_50k.json")).collect():
        assert np.frombuffer(bytes(row.ids), np.uint32).tolist() == library.encode_ordinary(TEXTS[row.doc_id] or "")


def test_small_table_of_pieces_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    library, own = _library(), bpe.PieceEncoder(bpe.tokenizer_from_ranks(RANKS))
    for k in range(20):
        texts = [f"word{k} other{j} 's" for j in range(30)] + TEXTS[1:]
        found = own.encode(texts)
        for i, text in enumerate(texts):
            assert found.ids[found.bounds[i] : found.bounds[i + 1]].tolist() == library.encode_ordinary(text)


def test_split_character():
    ids = np.array(_library().encode_ordinary("😀"), np.uint32)
    assert len(ids) > 1
    assert tokens.decode_text(ids, RANKS) == "😀"
    assert "�" in tokens.decode_text(ids[:1], RANKS)


def test_query(spark, small_dir):
    from trackhouse.llm import queries

    library = _library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.all_queries()["op1_byte_bpe"](spark, small_dir).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = np.array(library.encode_ordinary(docs[row.doc_id]), np.uint32)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()
