"""Removal of repeated passages against brute force over all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import repeats
from tests.llm.test_corpus_operators import EDGES, clashing, docs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in enumerate(words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def found(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


def shared(rng, n=60, few=False):
    fresh = lambda k: [f"w{rng.randrange(12 if few else 10**6)}" for _ in range(k)]
    passages = [fresh(rng.randrange(3, 80)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [fresh(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), fresh(rng.randrange(0, 9))]
        texts.append(rng.choice([" ", "\n", " \t\x0b"]).join(sum(parts, [])))
    return texts + [texts[0], texts[0].upper(), " ".join(passages[0] * 3)]


@pytest.mark.parametrize("window, part_bytes, few", [(35, 8 << 20, False), (35, 600, False), (4, 300, True)])
def test_every_repeated_window_goes_and_nothing_else(spark, window, part_bytes, few):
    texts = shared(random.Random(window + part_bytes), few=few)
    out = found(repeats.deduplicated(docs(spark, texts), window, part_bytes))
    assert out == brute(texts, window)
    assert any(r[2] for r in out) and any(0 < r[2] < r[1] for r in out)


def test_spans_are_what_was_removed(spark):
    texts = shared(random.Random(3))
    for r in repeats.deduplicated(docs(spark, texts)).collect():
        w = WORD.findall(texts[r["doc_id"]])
        gone = {j for s in r["removed"] for j in range(s["first"], s["end"])}
        assert len(gone) == r["n_removed"] and " ".join(x for j, x in enumerate(w) if j not in gone) == r["kept"]


def test_estimates_beyond_the_truth_are_taken_back(spark, monkeypatch):
    """With a sketch of very few cells nearly all windows are estimated repeated; results stay exact."""
    monkeypatch.setattr(repeats, "SLICE", 4)
    texts = shared(random.Random(9))
    monkeypatch.setattr(repeats, "_cells", lambda h, row, bits: (repeats.mix(h, row + 1) >> np.uint64(59)).astype(np.int64))
    assert found(repeats.deduplicated(docs(spark, texts), 35, 600)) == brute(texts, 35)


def test_long_tied_repeated_and_empty_texts(spark):
    texts = [*EDGES, "word " * 30_000, "ü " * 40, " ".join(map(str, range(20_000)))]
    assert found(repeats.deduplicated(clashing(docs(spark, texts)), part_bytes=5000)) == brute(texts, 35)
    assert repeats.digests(repeats.deduplicated(docs(spark, []))).collect() == []
    null_ids = docs(spark, [" ".join(map(str, range(50)))] * 2).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert [(r["doc_id"], r["n_removed"], r["kept"]) for r in repeats.deduplicated(null_ids).collect()] == [(None, 50, "")] * 2


def test_numbers_survive_their_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << 27, n))
        assert (repeats.decoded(repeats.coded(x)) == x).all()
