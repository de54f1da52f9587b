"""A corpus pipeline of five stages over `documents`: rules, classifier, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Written, documents, drop, materialize
from tessera.llm.near_dedup import keep_one
from tessera.llm.packing import packed_documents
from tessera.llm.quality_model import fitted, keep_good
from tessera.llm.quality_rules import passing
from tessera.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, scores 0.3 or more."""
    return keep_good(docs, fitted(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each near-duplicate group."""
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date."""
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again; a stage's table goes once the next one stands.

    Null and empty texts go in the first stage. Repeated rows are one document
    after the third. Other columns stay, whatever their names. An empty table
    gives no rows.
    """
    docs, before = documents(spark, sf_dir), Written()
    for _, stage in STAGES[:-1]:
        made = Written()
        docs = materialize(stage(spark, docs, sf_dir), made)
        drop(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
