"""Centroid clustering against whole-number brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import clusters

VECTORS = "vec_id bigint, embedding array<double>"


def brute(rows, k=16, rounds=3, dim=64):
    v = [(i, [math.floor(64 * Fraction(c)) for c in x]) for i, x in rows if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)[:k]
    c = [x for _, x in start]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), n) for n, y in enumerate(c))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in v]
        for n in range(len(c)):
            mine = [x for (_, x), o in zip(v, of, strict=True) if o == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [nearest(x) for _, x in v]
    most = (1 << 63) - 1
    inertia = [sum(d for d, n in last if n == m) for m in range(len(c))]
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, n, min(d, most), min(inertia[n], most), min(sum(inertia), most), name[n]) for (i, _), (d, n) in zip(v, last, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rounds_equal_whole_number_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_BYTES", 4096)
    rng = random.Random(5)
    centers = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(7)]
    rows = [(n, [c + rng.gauss(0, 0.4) for c in rng.choice(centers)]) for n in range(160)]
    rows += [(5, rows[5][1]), (500, rows[5][1]), (None, rows[6][1])]  # repeated rows, ties and a null id
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit("x") for c in ("ids", "kind", "vecs", "cluster", "distance")})
    assert found(clusters.cluster(df)) == brute(rows)


def test_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(n, [rng.choice([-1, 1]) * 10.0 ** rng.choice([0, 3, 9, 18, 300]) * rng.random() for _ in range(3)]) for n in range(40)]
    rows += [(n, [rng.uniform(-(2.0**40), 2.0**40) for _ in range(3)]) for n in range(40, 60)] + [(60, [1.7e308, -1.7e308, 0.0])]
    assert found(clusters.cluster(spark.createDataFrame(rows, VECTORS), k=5, dim=3)) == brute(rows, k=5, dim=3)


@pytest.mark.parametrize("most", [1 << 10, 1 << 28, 1 << 40])
def test_the_guard_keeps_distances_exact(most):
    rng = np.random.default_rng(7)
    x, c = rng.integers(-most, most, (50, 8)), rng.integers(-most, most, (6, 8)).tolist()
    want = [[sum((int(a) - b) ** 2 for a, b in zip(row, y, strict=True)) for y in c] for row in x.tolist()]
    assert [[int(d) for d in row] for row in clusters.distances(x, c).tolist()] == want


def test_rows_that_take_no_part_and_small_tables(spark):
    one = [0.5] * 64
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [*one[:63], None]), (5, [*one[:63], float("nan")]), (6, [*one[:63], float("inf")]), (7, one), (8, [*one[:63], -0.01])]
    assert found(clusters.cluster(spark.createDataFrame(rows, VECTORS))) == brute(rows)
    assert clusters.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert clusters.cluster(spark.createDataFrame(rows[:6], VECTORS)).collect() == []
    assert clusters.cluster(spark.createDataFrame([(None, one)], VECTORS)).collect() == []  # no first centroid
