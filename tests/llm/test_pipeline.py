"""The pipeline's stages against brute force, over the driver's smallest table."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import pii, quality
from tests.llm.test_corpus_operators import brute_components, brute_quality, brute_targets

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def brute_kept(text):
    n, chars, symbols, dup, repeat = brute_quality(text)
    lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
    stop = sum(w.lower() in quality.STOP_WORDS for w in WORD.findall(text or ""))
    value = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": lines, "n_stop_words": stop}
    within = all(
        (r.low is None or value[r.numerator] >= r.low * value[r.denominator]) and (r.high is None or value[r.numerator] <= r.high * value[r.denominator]) for r in quality.RULES
    )
    return n >= 50 and 100 * repeat <= 50 * n and within


def brute_copies(rows):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    out = Counter()
    for source, target in brute_targets(sizes).items():
        take, at = math.floor(target + 1e-9), 0
        for r in sorted((r for r in rows if r[3] == source), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:16], r[0])):
            n = size[r[0]]
            taken = sum(max(0, min(n, take - at - k * sizes[source])) for k in range(3))
            at += n
            if n:
                out[r[0]] = (2 * taken + n) // (2 * n)
    return +out


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows that each stage returns, each reading what the one before has written."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    out.append([tuple(r) for r in docs.select(*COLUMNS).collect()])
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([tuple(r) for r in docs.select(*(COLUMNS if name != "packing" else docs.columns)).collect()])
        if name != "packing":
            assert docs.columns == COLUMNS
    return out


def test_quality_stage(steps):
    assert sorted(steps[1]) == sorted(r for r in steps[0] if brute_kept(r[1])) and 0 < len(steps[1]) < len(steps[0])


def test_near_copies_stage(steps):
    rows = sorted(steps[1])
    groups = brute_components([r[1] for r in rows])
    assert sorted(steps[2]) == [r for k, r in enumerate(rows) if groups[k][1] == k]


def test_personal_data_stage(steps):
    before, field = {r[0]: r for r in steps[2]}, pii.trained()
    assert sorted(before) == sorted(r[0] for r in steps[3])
    for doc_id, text, *_, n_chars in steps[3]:
        old = before[doc_id][1]
        assert text == pii.masked(old, pii.base_spans(old) + pii.added_spans([old], field)[0]) and n_chars == len(text) and not pii.base_spans(text)


def test_mixing_stage(steps):
    assert Counter(r[0] for r in steps[4]) == brute_copies(steps[3])
    assert set(steps[4]) <= set(steps[3])


def test_packing_stage(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in steps[4]:
        want[r[0]] += len(codec.encode(r[1], add_special_tokens=False).ids) + 1
    got, sequences = Counter(), Counter()
    for doc_id, _, length, _, _, sequence_id, _ in steps[5]:
        got[doc_id] += length
        sequences[sequence_id] += length
    assert got == want and all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
    assert np.mean([n == 2048 for n in sequences.values()]) > 0.8


def test_run_gives_the_last_stage(spark, steps):
    assert Counter(r[0] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == Counter(r[0] for r in steps[5])


def test_near_copies_hold_no_cache_whose_shuffles_would_stay(spark, monkeypatch):
    from pyspark.sql import DataFrame
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from graphloom import scratch
    from graphloom.llm import jaccard

    def refused(self, *args):
        raise AssertionError("a cache keeps the shuffles that made it on disk")

    for kind in (DataFrame, Classic):
        monkeypatch.setattr(kind, "persist", refused)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "else")], "doc_id bigint, text string")
    there = set(scratch._made)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert not {p.rsplit("/", 1)[-1].split("-")[0] for p in set(scratch._made) - there} & {"texts", "candidates", "bounded"}
