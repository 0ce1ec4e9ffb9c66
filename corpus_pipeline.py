"""The corpus pipeline: quality, language, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes
each stage's result to the shared folder as Parquet and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headlight.llm import decontam, jaccard, langid, packing, quality
from headlight.llm.common import read, remainder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.3; learned from labelled rows of which the held-out fifth is no part."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    train = quality.features(docs).join(labels, "doc_id").where(remainder("doc_id", 5) != 0)
    return quality.accept(docs, quality.fit(train), 0.3)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language of score 0.5 or more: texts without a letter, and undecided ones, go."""
    return langid.accept(docs, langid.fit(docs.where(remainder("doc_id", 3) != 1)), 0.5)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.accept(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.accept(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_clean_of_benchmark),
    ("best-fit packing", pack_sequences),
]
#: Trained classifiers, components and packing are not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
