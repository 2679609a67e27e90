"""Small inputs and slow reference versions for the tests of this folder."""

import re

import numpy as np
import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=False):
    """Rows of `documents`; with `extra` also columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 0) for i, t in enumerate(texts)], SCHEMA)
    if extra:
        for name in ("score", "fp", "h", "w", "host", "kept", "tile", "key", "spans", "ids", "piece", "length", "start", "component_id", "y", "_id"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits=4):
    """{id: smallest id reachable} of {id: fingerprint} by measuring all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for i in ids:
        for k in np.flatnonzero(np.bitwise_count(values ^ np.uint64(prints[i])) <= bits):
            a, b = find(i), find(ids[k])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_classes(prints, bits=4, apart=86):
    """{id: smallest id reachable} of {id: five and eight fingerprints} by measuring all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    p = np.stack([prints[i] for i in ids])
    for k, i in enumerate(ids):
        d = np.bitwise_count(p ^ p[k])
        for j in np.flatnonzero((d[:, :5].min(axis=1) <= bits) & (d[:, 5:].sum(axis=1) <= apart)):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(a, b, size=5):
    own = [{tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in ((t or "").lower().split() for t in (a, b))]
    return len(own[0] & own[1]) / len(own[0] | own[1])
