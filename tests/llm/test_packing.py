"""Packing: ids as the tokenizer gives them, every piece placed once, no sequence over its size."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stainframe.llm import packing
from tests.llm.helpers import SCHEMA, documents


def test_ids_are_the_tokenizers():
    r = random.Random(1)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|> x", "don't 123 é 中文 🦄​"] + ["".join(r.choice("ab c\n\té中🦄'1.<|>") for _ in range(60)) for _ in range(400)]
    own, theirs = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts:
        assert list(own(t)) == theirs.encode(t, add_special_tokens=False).ids, t


def test_cut():
    assert packing.cut(0, 4) == []
    assert packing.cut(3, 4) == [(0, 3)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece(seed):
    r = np.random.default_rng(seed)
    size = int(r.choice([8, 64, 1024]))
    lengths = np.concatenate([r.integers(1, size + 1, r.integers(0, 3000)), np.full(r.integers(0, 900), r.integers(1, size + 1))])
    counts = np.bincount(lengths, minlength=size + 1)
    used, n = np.zeros(size + 1, np.int64), 0
    for times, parts in packing.plan(counts, size):
        assert times > 0 and sum(parts) <= size
        n += times
        for p in parts:
            used[p] += times
    assert (used == counts).all()
    # First fit decreasing in plain Python is the measure: exact complements are no worse.
    bins = []
    for x in sorted(lengths.tolist(), reverse=True)[:1500]:
        k = min((i for i, g in enumerate(bins) if g >= x), key=lambda i: bins[i], default=None)
        if k is None:
            bins.append(size - x)
        else:
            bins[k] -= x
    if len(lengths) <= 1500:
        assert n <= len(bins) * 1.02 + 1


def test_exact_complements():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 6, 4, 5, 2]] = [2, 1, 1, 1, 2, 4]
    plan = packing.plan(counts, 10)  # 45 ids: five sequences at least
    assert sum(n for n, _ in plan) == 5 and {(7, 3), (6, 4), (5, 5)} <= {p for _, p in plan}


def test_every_exact_fill():
    """600 is closed only by 212 + 212, which none of the four longest lengths that fit leads to."""
    n, counts = 120, np.zeros(1025, np.int64)
    counts[[600, 212, 301, 302, 303, 304]] = [n, 2 * n, *[n // 4] * 4]
    assert sum(k for k, _ in packing.plan(counts, 1024)) == n + n // 3


@pytest.mark.parametrize("seed", range(6))
def test_no_exact_fill_is_left(seed):
    r = np.random.default_rng(seed)
    size = int(r.choice([30, 64, 100]))
    counts = np.where(r.random(size + 1) < 0.4, r.integers(0, 40, size + 1), 0)
    counts[0] = 0
    plan = packing.filled(counts, size, None)
    left = np.zeros(size + 1, np.int64)
    for times, parts in plan:
        if sum(parts) < size or len(parts) > 4:
            for p in parts:
                left[p] += times
    here = [x for x in range(1, size + 1) if left[x]]
    for k in range(1, 5):
        for parts in itertools.combinations_with_replacement(here, k):
            assert sum(parts) != size or any(left[p] < parts.count(p) for p in parts), parts


def test_packed(spark):
    r = random.Random(2)
    texts = [None, "", "word " * 3000] + [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(1, 400))) for _ in range(120)] + ["same"] * 40
    df = documents(spark, texts, extra=True).unionByName(documents(spark, texts[:3], extra=True))
    rows = packing.packed(df, size=128, with_ids=True).toPandas()
    encode = packing.encoder()
    for k, g in rows[rows["doc_id"] > 2].groupby("doc_id"):
        g = g.sort_values("piece")
        assert [x for ids in g["ids"] for x in ids] == [*encode(texts[k] or ""), 2]
        assert g["piece"].tolist() == list(range(len(g))) and g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
        assert (g["length"].iloc[1:] == 128).all()
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(rows["ids"], rows["ids_crc32"]))
    assert sorted(rows[rows["doc_id"] == 0]["length"]) == [1, 1]
    s = rows.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id")["length"].cumsum() - s["length"] == s["offset"]).all()
    full = rows.groupby("sequence_id")["length"].sum()
    assert full.max() <= 128 and len(full) <= 1.05 * rows["length"].sum() / 128 + 1


def test_no_documents(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n, run", [(1_000_000, " "), (5_000_000, " "), (1_500_000, "\n"), (1_200_000, " \t")])
def test_long_white_space(n, run):
    own, theirs = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a" + run * (n // len(run)) + "b c"
    assert own(text) == theirs.encode(text, add_special_tokens=False).ids
    assert own("a b") == theirs.encode("a b", add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    rows = packing.packed(documents(spark, [" " * 1_100_000, "x", "y " + "\n" * 1_100_000])).toPandas()
    encode = packing.encoder()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {0: len(encode(" " * 1_100_000)) + 1, 1: 2, 2: len(encode("y " + "\n" * 1_100_000)) + 1}
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024
