"""The corpus operators as registered queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat, clusters, jaccard, langid, lexical, mixing, packing, pii, quality, repeats, topk, toxicity, warc
from graphloom.llm.common import shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels that are not held out, and scores every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out, and names the language of every one."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, a hash of the base spans, and all spans."""
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and one that says control strings, and reads them back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(given.unionByName(own)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into windows, as pieces with checksums."""
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a shingle Jaccard similarity of 0.8 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page into archives in the shared folder, and reads them back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors after three rounds, with exact distances."""
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return lexical.search(lexical.indexed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that start anywhere else too."""
    return repeats.digests(repeats.deduplicated(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc": op10_warc,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_lexical_search": op12_lexical_search,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL = {
    "op3_exact_top_k": topk.SQL,
    "op4_quality_rules": quality.SQL,
    "op6_chat_formatting": chat.SQL,
    "op7_mixing": mixing.SQL,
    "op9_jaccard_join": jaccard.SQL,
    "op10_warc": warc.SQL,
    "op11_centroid_clustering": clusters.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_substring_dedup": repeats.SQL,
}
