"""SimHash classes against fingerprints and links measured pair by pair."""

import random

import numpy as np
import pytest

from stainframe.llm import simhash
from stainframe.llm.common import components
from tests.llm.helpers import SCHEMA, classes, documents, jaccard, near_classes
from tests.llm.helpers import simhash as slow


def corpus():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgé") for _ in range(5)) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (300, 150, 60, 9, 3)]
    texts = ["", None, " \n", "One", "one", "a b c", "A b\tc", "a  b c\n", "x " * 40_000]
    for text in base:
        for _ in range(25):
            own = text.split(" ")
            own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own))
        texts += [text, text.upper() if text.isascii() else text]
    return texts


def test_fingerprint():
    for t in corpus():
        assert simhash.fingerprint(t) & (2**64 - 1) == slow(t)


@pytest.mark.parametrize("tile", [simhash.TILE, 3])
def test_classes(spark, tile, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(simhash.links, "__defaults__", (4, tile))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.classes(documents(spark, texts, extra=True)).collect()}
    prints = {i: slow(t) for i, t in enumerate(texts)}
    want = classes(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    stay = simhash.representatives(documents(spark, texts, extra=True))
    assert stay.columns == documents(spark, texts, extra=True).columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(want.values()))


def test_links_lose_nothing():
    """Random fingerprints around few centres: every pair within 4 bits shares a key and passes the chain there."""
    r = np.random.default_rng(5)
    centre = r.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([[c] + [c ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 3).astype(np.uint64)) for _ in range(120)] for c in centre]))
    rows, keys = simhash.chain_keys(fp)
    order = np.lexsort((rows, keys))
    found = simhash.bucket_links(keys[order], np.zeros(len(rows), np.int64), fp[rows[order]], 4)
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found.tolist():
        assert (a ^ b).bit_count() <= 4
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {int(x): find(int(x)) for x in fp} == classes({int(x): int(x) for x in fp})


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "same text here now", "en", "a", 1), (1, "same text here now", "en", "a", 1), (None, "same text here now", "en", "b", 1), (None, "alone in the world it is", "en", "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.classes(df).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert sorted(r["doc_id"] or 0 for r in simhash.representatives(df).collect()) == [0, 1]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.classes(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(80)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(70)] + [(5, 5), (7, 6)]
    r.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {row["node"]: row["root"] for row in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def edited(r, words, text):
    text = list(text)
    for _ in range(r.randrange(1, 1 + len(text) // 45)):
        k = r.randrange(len(text))
        text[k:k + r.randrange(2)] = [r.choice(words)] * r.randrange(1, 3)
    return text


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_near_copies(spark, tile):
    """Links as by all pairs; nine of ten planted copies of a five-word similarity of 0.8 or more go, others stay."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    texts, of = [], {}
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.randrange(60, 400))]
        first = len(texts)
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            of[len(texts)] = first
            texts.append(" ".join(edited(r, words, base)))
    texts += [texts[0]] * 3 + ["", None, "one", "one two three"]
    df = documents(spark, texts, extra=True)
    stay = {x["doc_id"] for x in simhash.near_representatives(df, tile=tile).collect()}
    root = near_classes({i: simhash.near_prints(t) for i, t in enumerate(texts)})
    assert stay == {i for i in root if root[i] == i}
    planted = [i for i, k in of.items() if jaccard(texts[i], texts[k]) >= 0.8]
    assert len(planted) > 50 and sum(i not in stay for i in planted) >= 0.9 * len(planted)
    assert all(k in stay for k in set(of.values()))
    assert simhash.near_representatives(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_near_links_are_made_once(spark, tile, monkeypatch):
    """A crowd meets under nearly 200 keys; each of its links comes out of one bucket only, and none is missing."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    base = [r.choice(words) for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(80):
        own = list(base)
        own[r.randrange(300)] = r.choice(words)
        texts.append(" ".join(own))
    seen = []
    monkeypatch.setattr(simhash, "components", lambda edges: seen.append(edges) or components(edges))
    stay = {x["doc_id"] for x in simhash.near_representatives(documents(spark, texts), tile=tile).collect()}
    prints = {i: simhash.near_prints(t) for i, t in enumerate(texts)}
    root = near_classes(prints)
    assert stay == {i for i in root if root[i] == i}
    assert seen[0].count() == seen[0].distinct().count() >= len(texts) - len(stay) - 1
    # Not because repeated links are dropped behind: the rows are those that the buckets give.
    assert seen[0]._jdf.queryExecution().optimizedPlan().nodeName() == "MapInPandas"


def test_meeting_keys():
    """The key that counts is one under which both stand, and every pair that links has one."""
    r = np.random.default_rng(7)
    p = r.integers(0, 2**63, (400, 13), dtype=np.uint64)
    q = p.copy()
    for k in range(5):
        q[:, k] ^= np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (400, 6)).astype(np.uint64), axis=1) * (r.random(400) < 0.8)
    q[:, 2] = p[:, 2] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (400, 4)).astype(np.uint64), axis=1)
    widths, found = simhash.near_widths(4), simhash.meeting_keys(p, q, 4)
    assert (found >= 0).all()
    for i, key in enumerate(found.tolist()):
        own = [set((simhash.chain_keys(x[i:i + 1, key >> 40], widths)[1] | (key >> 40 << 40)).tolist()) for x in (p, q)]
        assert key in own[0] & own[1]
