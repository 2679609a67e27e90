"""Whitening against plain arithmetic and numpy's own eigenvectors."""

import random

import numpy as np
import pytest

from stainframe.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS v", "2 AS n", "'x' AS component", "3 AS k", "4 AS s")


@pytest.mark.parametrize("kind", ["random", "repeated", "blocks", "rank", "diagonal"])
def test_components(kind):
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        a = r.standard_normal((n, n))
        c = {"random": a @ a.T, "diagonal": np.diag(np.arange(n) % 3.0), "rank": np.outer(a[0], a[0]),
             "repeated": (lambda q: q @ np.diag(np.repeat([5.0, 5.0 - 1e-9, 1.0], n)[:n]) @ q.T)(np.linalg.qr(a)[0]),
             "blocks": np.kron(np.eye(n), [[2.0, 1.0], [1.0, 2.0]])}[kind]
        c = (c + c.T) / 2
        most = min(16, len(c))
        values, z = whitening.principal(c, most)
        want = np.linalg.eigvalsh(c)[::-1][:most]
        scale = max(1e-300, np.abs(want).max())
        assert np.abs(values - want).max() <= 1e-13 * scale
        assert np.abs(z.T @ z - np.eye(most)).max() < 1e-10
        assert np.abs(c @ z - z * values).max() <= 1e-11 * scale


def slow(rows, width, most=16):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)))
            for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(x) for x in zip(*fit)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, total)] for x in fit])
    values, axes = np.linalg.eigh(y.T @ y / n)
    return kept, n, total, values[::-1][:most], axes[:, ::-1][:, :most], float(values.sum())


def test_plain_arithmetic(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1 + k % 5) for k in range(20)]) for i in range(500)]
    rows += [(900 + i, rows[3][1]) for i in range(300)] + [(3, rows[4][1]), (None, rows[5][1]), (None, [0.25] * 20)]
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [1.5] * 7), (2005, [])]
    got = whitening.whiten(table(spark, rows)).toPandas()
    kept, n, total, values, axes, trace = slow(rows, 20)
    assert len(got) == 16 * len(kept) and (got["n"] == n).all() and got["identity_error"].iloc[0] < 1e-9
    by = {}
    for i, g in got[got["vec_id"].notna()].groupby("vec_id"):
        by[int(i)] = g.sort_values("component")
    signs = None
    for i, x in kept:
        if i is None or i == 3:
            continue
        g = by[i]
        assert g["component"].tolist() == list(range(1, 17))
        assert (g["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, total))).all()
        want = np.array([(n * a - s) / n for a, s in zip(x, total)]) @ axes / np.sqrt(values)
        signs = np.sign(want * g["whitened"].to_numpy()) if signs is None else signs
        assert np.allclose(g["whitened"], want * signs, atol=1e-8)
        assert np.allclose(g["explained"], values / trace, rtol=1e-10)
    assert len(got[got["vec_id"].isna()]) == 32


def test_few_and_none(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"]) for r in sorted(one)] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] == 0 for r in one)
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(5)])).orderBy("vec_id", "component").collect()
    assert [abs(round(r["whitened"], 6)) for r in line if r["component"] == 1] == [1.414214, 0.707107, 0, 0.707107, 1.414214]
    assert all(r["whitened"] is None for r in line if r["component"] > 1) and abs(line[0]["explained"] - 1) < 1e-12


def test_large_values(spark):
    rows = [(i, [(-1) ** i * 10.0 ** e, float(i), 1.0]) for i, e in enumerate((9, 9, 18, 300, 0))]
    got = whitening.whiten(table(spark, rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 15 and all(r["deviation"] is None for r in got if r["vec_id"] in (2, 3)) and got[0]["identity_error"] < 1e-4
