"""Corpus preparation from end to end: stages that each take all that the one before kept.

Language identification drops documents whose language cannot be told, line
deduplication cuts repeated lines (a document may become empty but stays), the
n-gram join keeps one document of each group of near copies, decontamination
drops documents that hold a benchmark item, and packing makes token sequences.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, line_dedup, ngram_join, packing, storage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return langid.keep_identified(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, similarity="4/5")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_join", near_copies),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]
#: Training and tokenizing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, storage.durable(stage(spark, docs, sf_dir), f"stage-{name}")
        storage.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
