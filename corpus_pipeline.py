"""A training corpus from `documents`: language ID, exact and near deduplication, decontamination, sampled SentencePiece ids.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, exactdup, langid, neardup, spiece
from tessera.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no letter, no text, or a code far too long for any language learned) go."""
    return langid.identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest id stays."""
    return exactdup.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more (shingles of five words) the smallest id stays."""
    return neardup.distinct_documents(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a benchmark item's shingles go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations a document, decoded again to check them: doc_id, sample, ids, round_trip, log_prob, log_inclusion."""
    return spiece.segmentations(docs, k=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("sentencepiece", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
