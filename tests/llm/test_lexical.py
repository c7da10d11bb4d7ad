"""Ranked search against brute force over all documents and terms."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import lexical
from tests.llm.test_corpus_operators import EDGES, clashing, docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, k=10):
    bags = [Counter(terms(t)) for t in texts]
    n = [sum(b.values()) for b in bags]
    docs_n, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in enumerate(bags):
            if n[d]:
                m = 10 + 90 * n[d] * docs_n // total
                s = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
                if s > 0:
                    scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def corpus(rng, n=150):
    topics = [[f"t{k}x{j}" for j in range(40)] for k in range(6)]
    texts = [" ".join(rng.choice([rng.choice(rng.choice(topics[k % 6 : k % 6 + 1])), f"All-{rng.randrange(30)}", "THE"]) for _ in range(rng.randrange(1, 90))) for k in range(n)]
    return texts + [texts[3]] * 25 + [texts[7].upper()]  # ties


@pytest.mark.parametrize("cluster, group, block, first", [(256, 1 << 20, 1 << 18, 2), (8, 400, 1 << 18, 1), (5, 900, 40, 3)])
def test_results_equal_brute_force(spark, cluster, group, block, first):
    rng = random.Random(cluster)
    texts = corpus(rng)
    items = [(n, rng.choice(texts)[: rng.randrange(5, 120)]) for n in range(12)] + [(90, "the"), (91, "nothing here"), (92, ""), (93, None), (94, texts[3])]
    index = lexical.indexed(docs(spark, texts), cluster, group)
    got = found(lexical.search(index, spark.createDataFrame(items, ITEMS), first=first, block_terms=block))
    assert got == brute(texts, items)
    if cluster < 256:
        assert index.clusters.count() > len(texts) // cluster
        assert max(len(r["ids"]) for r in index.clusters.select("ids").collect()) <= cluster


def test_index_holds_every_document_once(spark):
    texts = [*corpus(random.Random(2)), *EDGES]
    ids = sorted(i for r in lexical.indexed(docs(spark, texts), 16, 500).clusters.select("ids").collect() for i in r["ids"])
    assert ids == [k for k, t in enumerate(texts) if terms(t)]


def test_bisection_puts_alike_documents_together():
    """Documents of two vocabularies that come mixed end in halves of one each."""
    rng = np.random.default_rng(3)
    kind = rng.permutation(np.repeat([0, 1], 40))
    owner, term = np.repeat(np.arange(80), 12), np.concatenate([rng.integers(0, 50, 12) + 50 * k for k in kind])
    left, _, _ = lexical.bisected(owner, term, 80, 100, swaps=20)
    assert left.sum() == 40 and kind[left].mean() in (0, 1)


def test_bounds_leave_clusters_out(spark):
    """A query of one topic's rare terms scores few of the clusters, and finds what brute force finds."""
    rng = random.Random(8)
    texts = [" ".join(f"t{k % 8}x{rng.randrange(30)}" for _ in range(40)) for k in range(400)]
    index = lexical.indexed(docs(spark, texts), 16, 1 << 20)
    queries = lexical.Queries([np.unique(lexical.word_hashes(np.frombuffer(b"t3x1", np.uint8), np.array([0]), np.array([4])))])
    queries.weights[:] = [lexical.weight(df, index.n_docs) for df in lexical._frequencies(index, queries).tolist()]
    least = lexical._least(index, queries, 10, 2)
    reach = [queries.bounds(queries.places(np.frombuffer(r["terms"], np.uint64)), np.frombuffer(r["most"], "<i4").astype(np.int64))[0] >= least[0] for r in index.clusters.collect()]
    assert 0 < sum(reach) < len(reach) / 2
    assert found(lexical.search(index, spark.createDataFrame([(1, "t3x1")], ITEMS))) == brute(texts, [(1, "t3x1")])


def test_edges(spark):
    texts = [*EDGES, "long " * 60_000 + "end", "Ünïcode-Wort 漢字", "under_score 0 a1"]
    items = [(1, "A b END Ünïcode 漢字 score"), (1, "word"), (None, "a1 one"), (2, "!!!")]
    df = clashing(docs(spark, texts)).drop("leaf", "terms")
    asked = clashing(spark.createDataFrame([*items, items[0]], ITEMS))  # a repeated row is one query
    got = lexical.search(lexical.indexed(df), asked).collect()
    want = brute(texts, [(k, t) for k, (_, t) in enumerate(items)])
    names = [i for i, _ in items]
    assert sorted(map(repr, ((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got))) == sorted(repr((names[k], *rest)) for k, *rest in want)
    empty = lexical.indexed(docs(spark, []))
    assert lexical.search(empty, asked).collect() == []
    assert lexical.search(lexical.indexed(df), spark.createDataFrame([], ITEMS)).collect() == []
    nulls = docs(spark, ["a b", "a b"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(5)))
    nulls = nulls.unionByName(docs(spark, ["zz " + "y " * 40] * 3))
    assert [(r["rank"], r["doc_id"]) for r in lexical.search(lexical.indexed(nulls), spark.createDataFrame([(1, "b")], ITEMS)).orderBy("rank").collect()] == [(1, 5), (2, None)]
