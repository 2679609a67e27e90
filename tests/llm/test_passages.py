"""Repeated passages against every string of every document."""

import hashlib
import random

import numpy as np
import pytest

from stainframe.llm import passages
from tests.llm.helpers import SCHEMA, documents


def slow(rows, length):
    """{row number: (n_bytes, n_removed, n_spans, kept)} of (id, text) rows."""
    first = {}
    bodies = [(float("inf") if k is None else k, (t or "").encode()) for k, t in rows]
    for k, b in bodies:
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            first[s] = min(first.get(s, float("inf")), k)
    out = []
    for k, b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < k:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, kept))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé中") for _ in range(r.randrange(1, 7)))
    line = lambda k: " ".join(word() for _ in range(k))
    common = [line(r.randrange(6, 40)) for _ in range(8)]
    texts = [" ".join(r.choice(common) if r.random() < 0.4 else line(r.randrange(1, 30)) for _ in range(r.randrange(0, 6))) for _ in range(n)]
    return texts + [texts[3], texts[3], None, "", "x" * 49, "x" * 50, "x" * 700, "xy" * 300, texts[5][:-1], common[0] * 3, texts[7] + "!" + texts[7]]


@pytest.mark.parametrize("seed, length, options", [
    (1, 50, {}), (2, 50, {"block": 700, "transform": 3000}), (3, 50, {"block": 2000, "crowd": 2}), (4, 16, {"block": 900, "crowd": 5}), (5, 77, {"block": 1})])
def test_every_string(spark, seed, length, options):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    ids[10], ids[20], ids[30] = None, ids[21], -5
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA).selectExpr("*", "'x' AS block", "1 AS p", "2 AS body", "3 AS ids")
    got = passages.without_repeats(df, length, with_text=True, **options).toPandas()
    want = sorted((-1 if k is None else k, *w) for (k, _), w in zip(rows, slow(rows, length)))
    have = sorted((-1 if k is None or k != k else int(k), a, b, c, bytes(d)) for k, a, b, c, d in zip(
        got["doc_id"].astype(object).where(got["doc_id"].notna(), None), got["n_bytes"], got["n_removed"], got["n_spans"], got["kept"]))
    assert have == want
    assert all(hashlib.sha256(k).hexdigest() == h for k, h in zip(got["kept"], got["kept_sha256"]))


def test_boundaries_by_increasing_prefix():
    """What backward extension leaves unparted is just what has the length in common."""
    r = np.random.default_rng(3)
    for n, letters in ((1, 2), (30, 1), (300, 2), (3000, 3), (4000, 200)):
        text = r.integers(0, letters, n).astype(np.uint8)
        text[n // 2:] = text[:n - n // 2]
        for length in (1, 5, 16, 50):
            order = passages.ordered(text, length)
            ring = np.concatenate([text] * (length // n + 2)).tobytes()
            own = [ring[i:i + length] for i in order.tolist()]
            assert own == sorted(own)
            assert passages.parted(text, order, length).tolist() == [a != b for a, b in zip(own, own[1:])]


def test_long_texts_and_none(spark):
    assert passages.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    blank, tail = " " * 1_000_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000))
    got = {r["doc_id"]: r for r in passages.without_repeats(documents(spark, [tail, blank, "q" + tail + blank, "r" + tail], extra=True)).collect()}
    assert [got[k]["n_removed"] for k in range(4)] == [0, 0, 1_300_000, 300_000] and got[2]["n_spans"] == 1
    assert got[3]["kept_sha256"] == hashlib.sha256(b"r").hexdigest()
