"""Hard negatives against all products."""

import random

import numpy as np
import pytest

from stainframe.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def slow(rows, every=100, k=5):
    fine = [(i, [min(max(int(np.floor(256 * c)), -2**63), 2**63 - 1) for c in v], y) for i, v, y in rows
            if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, q, y in fine:
        if a % every:
            continue
        s = sorted((-min(max(sum(p * c for p, c in zip(q, v)), -2**63), 2**63 - 1), i, z) for i, v, z in fine if i != a)
        for p, i, z in [t for t in s if t[2] == y][:k]:
            hard = [(n, j) for n, j, z2 in s if z2 != y and 80 * -p <= 100 * -n <= 100 * -p][:k]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(hard)]
    return sorted(out)


def vectors(n, seed, width=8):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + r.gauss(0, 0.3 if i % 3 else 1) for c in r.choice(middle)], r.randrange(4)) for i in range(n)]


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS c", "3 AS g", "4 AS cluster", "5 AS v")
    return sorted(tuple(r) for r in negatives.mine(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block": 60, "group": 10}, {"block": 300, "group": 2}])
def test_all_products(spark, options):
    rows = vectors(700, 1)
    rows += [(2000 + i, rows[11][1], i % 2) for i in range(80)]  # a crowd of equal vectors, ties by id
    rows += [(5000, None, 1), (5100, [], 1), (5200, [None] * 8, 1), (5300, [float("nan")] * 8, 1), (5400, [float("inf")] * 8, 1),
             (5500, [1.0] * 8, None), (None, rows[4][1], 1), (5600, [0.0] * 8, 2), (-100, [-x for x in rows[9][1]], 3), (5700, [1.0, 2.0], 0),
             (200, rows[5][1], 1), (333, rows[6][1], 2)]
    assert mined(spark, rows, every=20, **options) == slow(rows, 20)


def test_large_values(spark):
    rows = [(i, [(1 + i % 7) * 10.0 ** e, float(i), 1.0], i % 2) for i, e in enumerate([0, 3, 9, 9, 9, 9, 18, 300, 300, 9, 9, 8] * 3)]
    assert mined(spark, rows, every=3) == slow(rows, 3)


def test_few_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 0), (3, [2.0], 0), (4, [0.5], 0)]) == [(0, 1, 1, 2, 65536, 58880)]
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 0)]) == []
    assert mined(spark, [(0, [0.0], 1), (1, [3.0], 1), (2, [-1.0], 0)]) == [(0, 1, 1, 2, 0, 0)]


def test_walks_end_early():
    """A list is left as soon as its bound says so, and the bound holds for every member."""
    r = np.random.default_rng(5)
    whole = np.concatenate([r.integers(-20, 21, (3000, 16)) + 400 * np.eye(16, dtype=np.int64)[k] for k in range(4)])
    x, ids, labels = whole.astype(float), np.arange(len(whole)), np.arange(len(whole)) % 3
    members = x[5:400:40]
    centre = negatives.centres(members, 1)[0]
    shared = negatives.Shared(centre, members, ids, labels, whole, x, np.linalg.norm(x, axis=1))
    for q in members:
        scores = shared.whole @ q.astype(np.int64)
        assert (scores <= shared.bound * np.linalg.norm(q) * (1 + 1e-7) + 1e-6).all()
        seen = sum(rows.stop - rows.start for rows, _ in shared.walk(q, q.astype(np.int64), 0.8 * float(q @ q)))
        assert seen < len(x) / 2
