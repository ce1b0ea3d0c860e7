"""From raw documents to packed sequences: language, toxicity, near copies, passages, packing.

Every stage takes all that the one before it kept and, but for the last, returns the columns of
documents. Stages are written as Parquet and read again, so a lost executor costs one stage at most.

Null and empty texts, and texts without a letter, have no language and go in the first stage; the other
stages would keep them. Texts of any length are read whole. Rows are judged one by one, repeated ones
too: of equal rows the near-copy stage keeps one. Ties go as the operator of the stage says. An empty
table gives an empty result in every stage, and other columns travel along until packing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackhouse.llm import language, minhash, packing, repeats, toxicity, workers
from trackhouse.llm.compression import remainder
from trackhouse.session import durable, ensure_checkpoint_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or between two languages go."""
    workers.release(spark)  # of what an earlier job of the session left, such as the packing of another run
    model = language.train(docs.where(remainder("doc_id", 4) != 2))
    return language.predict(docs, model).where(~F.col("rejected")).select(docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    workers.release(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 3) != 1)
    return toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 0").select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of near copies (five-word shingles, similarity 0.8), that of the
    smallest id. Rows that share an id are compared like any others; documents without an id stay."""
    workers.release(spark)
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = minhash.near_duplicates(named.select("doc_id", "text"), length=5, percent=80)
        kept = named.join(found.where("kept").select("doc_id"), "doc_id", "left_semi")
    else:
        # A number tells the rows of an id apart; it is written, as every reading must find the same.
        named = durable(named.withColumn("__row", F.monotonically_increasing_id()))
        found = minhash.near_duplicates(named.select("__row", "text"), id_col="__row", length=5, percent=80)
        placed = named.select("doc_id", "__row").join(found.select("__row", "component_id"), "__row")
        first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
        kept = named.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi")
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words that stand earlier in the corpus. One that is
    nothing else stays as an empty text."""
    workers.release(spark)
    cleaned = repeats.remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    workers.release(spark)
    # The pieces are written, so that the encoders' tables can go before the search begins.
    pieces = durable(packing.cut(docs, TOKENIZER))
    workers.release(spark)
    return packing.pack(pieces)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: SQL cannot express the trained stages; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
