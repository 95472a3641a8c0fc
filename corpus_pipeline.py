"""From raw documents to packed training sequences: five stages, each by one operator of ``wayloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import decontamination, language, near_duplicates, packing, quality
from wayloom.llm.common import scratch, table
from wayloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned from ``labels``, scores 0.7 or higher."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, with a calibrated probability of 0.5 or more."""
    return language.keep_identified(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at 0.8 or more on five-word shingles."""
    return near_duplicates.keep_first(docs, width=5, percent=80, bands=50, rows=6)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word passage of ``benchmark``."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), window=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained stages nor the packing; tests hold each stage, run as run() does, against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
