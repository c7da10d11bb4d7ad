"""Learned operators on the driver's tables: accuracy on rows that learning doesn't see, and texts of all kinds."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, queries, toxicity
from tests.llm.test_corpus_operators import EDGES, clashing, docs

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
#: Texts of all kinds: none, empty, tied, repeated, and very long ones.
TEXTS = [*EDGES, "the quick brown fox and the lazy dog " * 4000, "the quick brown fox and the lazy dog " * 4000, "12 34 !?", "you stupid moron " * 3000]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(spark, documents):
    found = queries.op2_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    n, right = found.select(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right >= 0.98 * n


def test_languages_of_all_kinds_of_texts(spark, documents):
    model = langid.fit(documents)
    rows = {r["doc_id"]: r for r in langid.identify(clashing(docs(spark, TEXTS)), model).collect()}
    assert sorted(rows) == list(range(len(TEXTS))) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert {k for k, r in rows.items() if r["lang_pred"] == "und"} == {k for k, t in enumerate(TEXTS) if not any(c.isalpha() for c in t or "")}
    assert rows[len(EDGES)]["lang_pred"] == "en" and rows[len(EDGES)]["score"] == rows[len(EDGES) + 1]["score"]
    assert langid.identify(docs(spark, []), model).collect() == []


def test_toxicity_of_all_kinds_of_texts(spark, documents):
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r for r in toxicity.score(clashing(docs(spark, TEXTS)), model).collect()}
    assert sorted(rows) == list(range(len(TEXTS))) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    for k, t in enumerate(TEXTS):
        assert rows[k]["score"] == rows[TEXTS.index(t)]["score"]
    assert rows[0]["score"] == rows[1]["score"]  # null and empty
    assert toxicity.score(docs(spark, []), model).collect() == []
