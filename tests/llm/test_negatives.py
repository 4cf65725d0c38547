import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalgrid.llm import negatives as N


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.sampled_from([1, 200, 1 << 15, 1 << 24, 1 << 40]), st.integers(0, 1 << 30))
def test_scores_are_exact(dim, largest, seed):
    rng = random.Random(seed)
    a, b = ([[rng.randint(-largest, largest) for _ in range(dim)] for _ in range(n)] for n in (3, 4))
    got = N.exact_scores(np.array(a, dtype=np.float64), np.array(b, dtype=np.float64))
    assert got.tolist() == [[sum(x * y for x, y in zip(u, v)) for v in b] for u in a]


def test_long_vectors_and_primes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3000, 3000, (2, 5000)), rng.integers(-3000, 3000, (3, 5000))
    assert (N.exact_scores(a.astype(float), b.astype(float)) == a @ b.T).all()
    assert N.exact_scores(np.zeros((2, 0)), np.zeros((1, 0))).tolist() == [[0], [0]]
    for depth in (1, 64, 1024):
        primes = N.residue_primes(depth, 10 ** 15)
        assert math.prod(primes) > 2 * 10 ** 15 and depth * (max(primes) // 2) ** 2 < 1 << 24
        assert len(set(primes)) == len(primes) and all(all(p % q for q in range(2, math.isqrt(p) + 1)) for p in primes)
    with pytest.raises(ValueError):
        N.residue_primes(1 << 24, 10 ** 6)


def brute(rows, every, n_pos, n_neg):
    """From (id, label, whole-number vector)."""
    out = []
    for a, label, vec in rows:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(vec, v)), i, other) for i, other, v in rows if i != a and len(v) == len(vec)]
        same = sorted(x[:2] for x in scored if x[2] == label)[:n_pos]
        for p, positive in same:
            near = sorted((s, i) for s, i, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p)[:n_neg]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, every=5, n_pos=5, n_neg=3):
    table = spark.createDataFrame([(i, lab, v, "x", "y") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, score string, block string")
    found = N.hard_negatives(N.valid_rows(table, "vec_id", "embedding", "label"), F.col("id") % every == 0, n_pos, n_neg)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def floors(rows):
    return [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(N, "BLOCK", 37)  # many blocks, anchors in several, ties across them
    monkeypatch.setattr(N, "ANCHORS", 7)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, 0.25, 0.5, 1.0, 2.0]) for _ in range(4)]) for i in range(200)]
    rows += [(i, 1, [1.0, 0.5, 0.5, 2.0]) for i in range(200, 300)]  # a third of all rows hold one vector
    got = run(spark, rows)
    assert got == brute(floors(rows), 5, 5, 3) and len(got) > 300


def test_odd_rows(spark):
    good = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.6, 0.4]), (3, 2, [0.5, 0.1]), (5, 1, [1.0]), (7, 2, [0.9]), (10, 9, [1.0, 0.5]), (15, 1, [])]
    bad = [(20, None, [1.0, 0.5]), (25, 1, None), (30, 1, [1.0, None]), (35, 2, [float("nan"), 1.0]), (40, 2, [float("inf"), 1.0]), (None, 2, [0.7, 0.4])]
    again = [good[0], good[2], (3, 2, [0.6, 0.5])]  # repeated rows count once; of an id's several vectors the smallest
    assert run(spark, good + bad + again) == brute(floors(good), 5, 5, 3) != []
    assert run(spark, []) == [] and run(spark, bad) == []
