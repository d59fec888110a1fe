"""Corpus cleaning: five stages, each a table written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import bagminhash, bpe, decontam, gam, linedup, queries
from voxtide.llm.common import stored

#: Least quality of a document that stays.
KEEP = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; it learns from the labelled ones as query op8 does."""
    model = queries.quality_model(spark, docs, sf_dir)
    return gam.score(docs, model).where(F.col("score") >= KEEP).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave the texts; n_chars follows the text."""
    return linedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least key (id, then hash of the text).

    A document is an id with a text: texts under one id are classed each for itself, a null id is an id, rows that repeat both become one, the least.
    """
    keyed = docs.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    classes = bagminhash.near_classes(keyed.select("key", "text"), id_col="key")
    first = classes.where(F.col("key").eqNullSafe(F.col("class_id"))).select(F.col("key.doc_id").alias("first_id"), F.col("key.text_hash").alias("text_hash")).distinct()
    own = F.xxhash64("text")
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (own == F.col("text_hash")), "left_semi")
    return kept.groupBy("doc_id", own.alias("text_hash")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, and the digests of their tokens and of the text read back from them."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path(queries.VOCABULARY))
    return bpe.with_tokens(docs, vocab, public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("byte_bpe", tokenize)]

#: None: the quality model, signatures, BM25 retrieval and byte pairs are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
