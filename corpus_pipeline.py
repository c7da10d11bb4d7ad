"""A corpus pipeline of five stages over ``documents``.

Quality rules drop documents, of each group of near copies one stays, personal data is
masked, sources are mixed to their target weights, and what is left is packed into
windows. Every stage reads what the one before it has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import jaccard, mixing, packing, pii, quality
from graphloom.llm.common import table, written


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.kept_documents(docs)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of near copies."""
    return jaccard.first_of_each(docs)


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked."""
    return pii.masked_documents(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of windows."""
    return packing.piece_digests(packing.pack(docs))


STAGES = [
    ("quality", stage_quality),
    ("near_copies", stage_near_copies),
    ("personal_data", stage_personal_data),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: SQL can't express the random field, or packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
