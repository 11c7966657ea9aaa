"""The training-corpus pipeline: stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path as vocabulary

from assayer.llm import lempel_ziv, minmax_dedup, packing, secrets_crf, toxicity
from assayer.session import materialize

ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return minmax_dedup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of a smaller id has."""
    return lempel_ziv.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of every secret found."""
    return secrets_crf.redact(docs, secrets_crf.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, packing.ranks_path(vocabulary("byte_bpe_50k.json")))


STAGES = [("toxicity", without_toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("secret_scan", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
