"""Documents in, packed training sequences out, in four stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritally.llm import packing, quality_classifier, quality_rules, simhash
from veritally.llm.common import stash, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    return quality_rules.filter_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on the labelled part of the whole corpus, finds good."""
    model = quality_classifier.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.filter_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", near_dedup), ("packing", packed)]
#: Fingerprints, a trained network and a tokenizer: SQL can't express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
