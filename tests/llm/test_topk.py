"""Exact top-k against all products."""

import random

import numpy as np
import pytest

from stainframe.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>"


def slow(rows, k=20, every=20):
    fine = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in fine if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(n, seed, width=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    return [(i, [c + r.gauss(0, 0.1 if i % 3 else 1) for c in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("block", [40, 4096])
def test_all_products(spark, monkeypatch, block):
    rows = vectors(400, 1)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a crowd of equal vectors, ties by id
    rows += [(2000, None), (2001, []), (2002, [None] * 6), (2020, [float("nan")] * 6), (2040, [float("inf")] * 6), (None, rows[3][1]), (2060, [0.0] * 6), (-20, [-1.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS q", "3 AS v", "4 AS score")
    got = [tuple(r) for r in topk.top_k(df, block=block, query_block=10).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == slow(rows)


def test_pages_and_pruning(monkeypatch):
    """Small pages make a deep tree; the search gives the same, and far clusters are not opened."""
    monkeypatch.setattr(topk, "PAGE", 8)
    r = np.random.default_rng(2)
    v = np.concatenate([r.integers(-3, 4, (300, 4)) + c for c in ([0, 0, 0, 90], [90, 0, 0, 0], [0, 90, 0, 0])]).astype(float)
    most = np.square(v).sum(1).max()
    x = np.c_[v, np.sqrt(most - np.square(v).sum(1))]
    ids = np.arange(len(v))
    tree = topk.build(x, v)
    for i in range(0, 900, 37):
        s = (v @ v[i]).astype(int)
        want = sorted(((-s[j], j) for j in ids if j != i))[:5]
        assert topk.search(tree, ids, np.append(v[i], 0.0), 5, i, float(np.sqrt(most))) == [(-a, b) for a, b in want]


def test_few_and_none(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0
    rows = [(0, [1.0]), (1, [2.0]), (20, [0.5]), (20, [0.25])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA)).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got)[:3] == [(0, 1, 1, 8192), (0, 2, 20, 2048), (0, 3, 20, 1024)]


def test_large_values(spark):
    """Finite components of any size: exact whole scores, and the ends of long beyond them."""
    r = random.Random(6)
    rows = [(i, [r.choice([-1, 1]) * 10.0 ** r.choice([0, 1, 9, 9, 9, 10, 18, 300]) * r.random(), r.gauss(0, 1), 10.0 ** (i % 12)]) for i in range(300)]
    long = lambda x: min(max(x, -2**63), 2**63 - 1)
    whole = {i: [long(int(np.floor(64 * c))) for c in v] for i, v in rows}
    want = []
    for q in range(0, 300, 20):
        best = sorted((-long(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for block in (50, 4096):
        got = [tuple(r) for r in topk.top_k(df, block=block, query_block=5).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got) == want
    few = topk.top_k(spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [-1e300, 0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(few)] == [(1, (64 * 10**9) ** 2 + 64 * 128 if (64 * 10**9) ** 2 + 64 * 128 < 2**63 else 2**63 - 1), (2, -2**63)]
