"""The training-data pipeline: each stage is one operator and works on all that the one before kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of the documents, less the rows
that the operator rejects; the last returns the places of the pieces in packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from copycensus import workspace
from copycensus.llm import exact_dedup, near_dedup, packing, quality, toxicity
from copycensus.llm.common import small_batches, table

#: Texts that share so much of their shingles are near copies. The limit of operator 5's query is its own.
NEAR_PERCENT = 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs, NEAR_PERCENT)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("toxicity", civil_documents),
    ("exact_dedup", distinct_documents),
    ("minhash_near_dedup", dissimilar_documents),
    ("best_fit_packing", packed_sequences),
]

# SQL can express neither the trained classifiers nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is stored and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = workspace.snapshot(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
