"""Training-data pipeline over ``documents``: each stage's result is stored and read again by the next.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of
``documents``. The empty table, nulls, repeated rows and clashing names are handled by the operators, as
their docstrings say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqlens.llm import compression, kneser_ney, neardup, packing, secrets
from reqlens.llm.common import stored, table
from reqlens.llm.wordbpe import word_tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language allows."""
    return kneser_ney.keep_trustworthy(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the compression bands."""
    return compression.keep_quality(docs, compression.learned_bands(
        compression.measured(docs), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.mask(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("secret_scan", secret_scan), ("pack", pack)]

#: The stages train models, compress and encode texts, which SQL can't express; tests/llm holds them against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
