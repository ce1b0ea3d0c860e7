"""The registered queries of this subpackage, one per operator, over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackhouse.llm import (
    centroids, embeddings, language, licenses, media, minhash, packing, repeats, tokens, toxicity, trie_codes, urls, warc,
)
from trackhouse.llm.compression import remainder
from trackhouse.llm.sql import CENTROIDS, PRODUCT_CODES, WARC_RECORDS
from trackhouse.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes that decoding gives, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = tokens.encode(docs, RANKS, keep_text=False)
    digests = encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    return tokens.decode(digests, RANKS).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without passages of 20 words seen earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.cut(docs, TOKENIZER)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op2_minhash_dedup")
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the component of its near copies."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; documents whose crc32 modulo 3 is 1 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; documents whose crc32 modulo 4 is 2 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(remainder("doc_id", 4) != 2))
    guessed = language.predict(docs.select("doc_id", "text"), model)
    return guessed.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op9_matroska")
def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a Matroska file and read back, as digests and features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media.read_back(media.store(docs, keep_text=False))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


@query("op10_link_trust")
def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule, or by what reaches its host over links."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and covered templates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query("op7_embedding_dedup")
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component within its label."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_trie_codes", PRODUCT_CODES)
def op11_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's product code of 16 parts, by codebooks of 64 entries learned in two rounds."""
    return trie_codes.compress(table(spark, sf_dir, "embeddings"))[0]


@query("op12_pca_centroids", CENTROIDS)
def op12_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest of 40 centroids after five rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


@query("op13_warc_archives", WARC_RECORDS)
def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into dictionary-compressed archives, as read back from them."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    place = warc.write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, place, with_payload=False).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to")
    )
