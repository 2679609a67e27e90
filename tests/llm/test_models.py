"""Toxicity and quality: gradients by differences, windows, held-out accuracy, degenerate samples."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stainframe.llm import quality_classifier as quality
from stainframe.llm import toxicity
from stainframe.llm.common import held_out, labelled_sample
from tests.llm.helpers import SCHEMA, documents

DATA = "/root/testdata/sf0.1"


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        rows = toxicity.spread(np.arange(1, n + 1), 0)
        assert set(range(1, n + 1)) <= set(rows.ravel().tolist()) <= set(range(n + 1))
        starts = toxicity.windows(n)
        assert starts[0] == 0 and (np.diff(starts) == toxicity.STRIDE).all() and starts[-1] + toxicity.WINDOW >= n
        assert n <= toxicity.WINDOW or starts[-1] < n


def test_short_passages_are_whole_in_a_window():
    starts = toxicity.windows(500)
    assert all(((starts <= a) & (a + 17 <= starts + toxicity.WINDOW)).any() for a in range(500 - 17 + 1))


def test_runs_without_blanks_are_read_whole():
    run = "".join(random.Random(2).choice("aeioulmnrst_.") for _ in range(1000)) + "omega"
    parts = toxicity.tokens(f"one {run} two")
    assert parts[0] == "one" and parts[-1] == "two" and max(map(len, parts)) <= 64
    assert parts[1] + "".join(p[3:] for p in parts[2:-1]) == run
    assert toxicity.tokens("x" * 64) == ["x" * 64] and toxicity.tokens("x" * 65) == ["x" * 64, "x" * 4]
    ends = [set(toxicity.grams(toxicity.tokens(run[:-5] + end))[0].tolist()) for end in ("omega", "sigma")]
    assert ends[0] != ends[1]


def test_gradients():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) * 3 for k, v in toxicity.initial(6, 2).items()}
    flat, of = toxicity.grams(["ab", "cde", "f", "", "long-word"])
    known = np.array([1, 2, 0, 0, 4])
    index = r.integers(0, 6, (5, toxicity.WINDOW))
    index[0, 7:] = 5
    index[1] = 5
    target = np.array([0, 1, 1, 0, 1.0])

    def loss():
        _, z = toxicity.gradients(p, known, flat, of, index, 5, target)
        return np.mean(np.log1p(np.exp(-z)) + (1 - target) * z)

    g, z = toxicity.gradients(p, known, flat, of, index, 5, target)
    assert np.allclose(z, toxicity.logits(p, toxicity.project(p, known, flat, of), index, 5), atol=1e-4)
    for k in p:
        for at in ([(0,)] if k == "b" else [(1, 2), (2, 1), (int(flat[3]), 4)] if p[k].ndim == 2 else [(1,), (17,)]):
            at = tuple(min(i, n - 1) for i, n in zip(at, p[k].shape))
            old = p[k][at]
            p[k][at] = old + 1e-3
            up = loss()
            p[k][at] = old - 1e-3
            down = loss()
            p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=5e-4), (k, at)


def sample():
    r = random.Random(6)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    texts, y = [], []
    for i in range(500):
        own = [r.choice(words) for _ in range(r.randrange(20, 150))]
        if i % 4 == 0:
            for _ in range(2):
                own[r.randrange(len(own))] = r.choice(["vile", "zork"]) + r.choice(["", "s", "ly", "en"])
        texts.append(" ".join(own))
        y.append(int(i % 4 == 0))
    return texts, y


def test_toxicity_learns_and_scores_each_text_alone():
    texts, y = sample()
    model = toxicity.fit(texts[:350], y[:350])
    scores = list(toxicity.score(model, iter(texts[350:])))
    assert np.mean((np.array(scores) >= 0.7) == y[350:]) >= 0.9  # from 88 toxic texts
    assert np.allclose([next(toxicity.score(model, iter([t]))) for t in texts[350:370]], scores[:20], atol=1e-5)
    # One bad passage in a long text decides, wherever it stands; empty texts have a score too.
    calm = " ".join(texts[1].split() * 40)
    bad = next(t for t, k in zip(texts[350:], y[350:]) if k)
    low, high, empty, none = toxicity.score(model, iter([calm, f"{calm} {bad} {calm}", "", None]))
    assert low < 0.7 <= high and 0 <= empty < 0.7 and empty == none


def test_quality_learns():
    r = random.Random(8)
    good = [" ".join(r.choice(["leaf", "stone", "river", "cloud", "wind"]) + str(r.randrange(900)) for _ in range(80)) for _ in range(150)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:25]] + [t.replace(" ", " | ") for t in good[25:50]] + ["spam " * 80] * 25
    x, y = quality.table(good + bad), np.array([1] * len(good) + [0] * len(bad))
    model = quality.fit(x[::2], y[::2])
    assert ((quality.scores(model, x) >= 0.7) == y)[1::2].mean() >= 0.98
    s = quality.scores(model, quality.table(["", None, "a " * 200_000]))
    assert ((s >= 0) & (s <= 1)).all() and s[0] == s[1]


def test_one_class_or_none():
    assert list(toxicity.score(toxicity.fit([], []), iter(["a", None]))) == [0.0, 0.0]
    assert list(toxicity.score(toxicity.fit(["a"], [1]), iter(["a"]))) == [1.0]
    assert quality.scores(quality.fit(quality.table([]), np.zeros(0)), quality.table(["a"])).tolist() == [0.0]
    assert quality.scores(quality.fit(quality.table(["a"]), np.ones(1)), quality.table(["a"])).tolist() == [1.0]


def test_sample_leaves_the_held_out_alone(spark):
    docs = documents(spark, [f"text {i}" for i in range(400)], extra=True)
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS toxic", "1 AS text")
    labels = labels.union(labels).union(spark.sql("SELECT 5L, NULL, 1 UNION ALL SELECT NULL, 1, 1"))
    rows = labelled_sample(docs, labels, "toxic", 3, 1, 60).collect()
    assert len(rows) == 60 and sum(r["y"] for r in rows) == 30 and len({r["_id"] for r in rows}) == 60
    assert all(zlib.crc32(str(r["_id"]).encode()) % 3 != 1 and r["y"] == (r["_id"] % 4 == 0) for r in rows)
    marks = spark.sql("SELECT 7L AS doc_id UNION ALL SELECT NULL").select(held_out(F.col("doc_id"), 3, 1).alias("x")).collect()
    assert [r["x"] for r in marks] == [zlib.crc32(b"7") % 3 == 1, False]


def test_sample_has_one_text_for_an_id(spark):
    docs = documents(spark, [f"text {i}" for i in range(40)])
    docs = docs.union(spark.range(900).selectExpr("7L", "concat('again ', id)", "'en'", "'s'", "0"))
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    rows = labelled_sample(docs, labels, "toxic", 3, 1, 400).collect()
    assert zlib.crc32(b"7") % 3 != 1 and [r["_id"] for r in rows].count(7) == 1
    assert len(rows) == len({r["_id"] for r in rows}) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))
    assert rows and sorted(rows) == sorted(labelled_sample(docs.repartition(7), labels, "toxic", 3, 1, 400).collect())


def test_scores_in_spark(spark):
    docs = documents(spark, ["", None, "a b c", "a b c", "word " * 20_000], extra=True)
    texts, y = sample()
    model = toxicity.fit(texts[:40], y[:40], least_steps=5)
    out = toxicity.with_score(docs, model, name="tox").collect()
    assert len(out) == 5 and all(0 <= r["tox"] <= 1 for r in out) and out[2]["tox"] == pytest.approx(out[3]["tox"])
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.with_score(none, model).count() == 0
    model = toxicity.train(none, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r["score"] for r in toxicity.with_score(docs.drop("score"), model).collect()] == [0.0] * 5
    model = quality.train(none, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert [r["score"] for r in quality.with_score(docs.drop("score"), model).collect()] == [0.0] * 5


@pytest.mark.parametrize("module, target, modulus, remainder, least", [(toxicity, "toxic", 3, 1, 0.95), (quality, "quality", 4, 2, 0.98)])
def test_held_out_accuracy(spark, module, target, modulus, remainder, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels, modulus=modulus, remainder=remainder)
    unseen = docs.where(held_out(F.col("doc_id"), modulus, remainder)).join(labels, "doc_id")
    right = module.with_score(unseen, model).select(((F.col("score") >= 0.7).cast("int") == F.col(target)).cast("int").alias("x"))
    assert right.agg(F.avg("x")).first()[0] >= least


def test_quality_learns_from_every_label(spark):
    """Of 22,000 labelled texts each is in some pair and in the cut, and a table gives the model of its blocks."""
    docs = spark.range(22_000).selectExpr("id AS doc_id", "concat('word', id % 97, repeat(' many other words', CAST(id % 11 AS INT)), repeat('!', CAST(id % 5 AS INT))) AS text")
    labels = spark.range(22_000).selectExpr("id AS doc_id", "CAST(id % 5 < 3 OR id % 97 = 0 AS INT) AS quality")
    rows = quality.labelled(docs, labels, 4, 2, "doc_id", "text", "quality").select("_id", "y").collect()
    known = [i for i in range(22_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(int(r["_id"]) for r in rows) == known and all(r["y"] == (int(r["_id"]) % 5 < 3 or int(r["_id"]) % 97 == 0) for r in rows)
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x, y = quality.table([texts[i] for i in known]), np.array([i % 5 < 3 or i % 97 == 0 for i in known]).astype(int)
    s = np.sort(x @ model["w"] + model["shift"])
    bad = int((y == 0).sum())
    assert model["cut"] == pytest.approx((s[bad - 1] + s[bad]) / 2, abs=1e-9)
    order = np.random.default_rng(1).permutation(len(x))
    whole = quality.fit(x[order], y[order])
    assert np.abs(quality.scores(model, x) - quality.scores(whole, x)).max() < 0.05
    again = quality.train(docs.repartition(9), labels.repartition(3))
    assert np.allclose(model["w"], again["w"], atol=1e-6) and model["cut"] == pytest.approx(again["cut"], abs=1e-6)


def test_pair_sums_by_all_pairs():
    r = np.random.default_rng(2)
    z, y, w = r.normal(size=(40, len(quality.NAMES))), r.integers(0, 2, 40), r.normal(size=len(quality.NAMES)) / 9
    grad, curve, n = np.zeros(len(w)), np.zeros((len(w), len(w))), 0
    for g in z[y == 1]:
        for b in z[y == 0]:
            q = 1 / (1 + np.exp((g - b) @ w))
            grad, curve, n = grad + q * (g - b), curve + q * (1 - q) * np.outer(g - b, g - b), n + 1
    assert np.allclose(quality.pair_sums(z, y, w), np.concatenate([grad, curve.ravel(), [n]]))
