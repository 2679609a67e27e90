"""Repeated passages: removes bytes that a document shares, over at least 50 bytes, with one of a smaller id.

Texts lie in blocks. Every string of the minimum length is filed under the smallest hash of its 16-byte grams, so equal
strings meet in one bucket; buckets that only one document fills are dropped before any text moves. The stretches
of a bucket form a Burrows-Wheeler transform, on which intervals grow by backward extension, level by level: where
neighbouring suffixes part at level l, their common prefix is l. At the minimum length it stops, and what has not
parted shares that much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.llm.common import written

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 4 << 20
#: Bytes of a gram that files a string, and positions handled at a time.
GRAM, STEP = 16, 1 << 15
#: Strings of one stretch at most; a longer run under one gram is several stretches.
RUN = 64
#: Bytes of text for each group of buckets, and bytes of stretches in one transform.
GROUP, TRANSFORM = 16 << 20, 1 << 17
#: Documents from which a bucket is dealt out anew, by whole strings.
CROWD = 20_000
#: Stands between stretches: no byte of UTF-8.
BETWEEN = 0xFF
#: A null id comes after all others.
LAST = np.iinfo(np.int64).max


def _packed(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _pressed(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(body)


def _released(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)


def _steps(values: np.ndarray) -> bytes:
    """Whole numbers as pressed differences, which are small where values repeat or rise."""
    return _pressed(_packed(np.diff(values, prepend=0), "<i8"))


def _summed(body: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_released(body), "<i8"))


def _joined(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def blocks(docs: DataFrame, doc_id: str, text: str, size: int = BLOCK) -> DataFrame:
    """(block, n_bytes, ids, missing, ends, body): rows of `docs` side by side, about `size` bytes of text a block."""
    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, missing, parts, held = [], [], [], 0

        def block():
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            return pd.DataFrame({"n_bytes": [held], "ids": [_packed(ids, "<i8")], "missing": [_packed(missing, "u1")],
                                 "ends": [_packed(ends, "<i8")], "body": [_pressed(b"".join(parts))]})

        for batch in batches:
            for k, gone, t in zip(batch["key"].tolist(), batch["gone"].tolist(), batch["text"]):
                own = (t or "").encode("utf-8", "surrogatepass")
                if parts and held + len(own) > size:
                    yield block()
                    ids, missing, parts, held = [], [], [], 0
                ids.append(k)
                missing.append(gone)
                parts.append(own)
                held += len(own)
        if parts:
            yield block()

    key = F.col(doc_id).cast("bigint")
    return (docs.select(F.coalesce(key, F.lit(int(LAST))).alias("key"), key.isNull().alias("gone"), F.col(text).alias("text"))
            .mapInPandas(filled, "n_bytes bigint, ids binary, missing binary, ends binary, body binary")
            .withColumn("block", F.monotonically_increasing_id()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def least_grams(data: np.ndarray, length: int) -> np.ndarray:
    """For each string of `length` bytes of `data`: the least hash of its grams."""
    x = data.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] | (x[s:] << np.uint64(8 * s))
    n = len(data) - GRAM + 1
    h = _mixed(_mixed(x[:n]) ^ x[GRAM - 8:GRAM - 8 + n])
    grams, span = length - GRAM + 1, 1
    while span * 2 <= grams:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:len(h) - (grams - span)], h[grams - span:]) if span < grams else h


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, count): runs of `count` strings that start side by side in one document and have the same key."""
    n = len(data)
    begins = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(begins, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    whole = np.cumsum(edge[:n]) == 0
    out = []
    for s in range(0, n - length + 1, STEP):
        part = data[s:s + STEP + length - 1]
        m, ok = least_grams(part, length), whole[s:s + min(STEP, len(part) - length + 1)]
        cut = np.concatenate([[True], (m[1:] != m[:-1]) | (ok[1:] != ok[:-1])])
        at = np.flatnonzero(cut)
        size = np.diff(np.concatenate([at, [len(m)]]))
        keep = ok[at]
        at, size = at[keep], size[keep]
        pieces = -(-size // RUN)
        if len(size) and pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, size = np.repeat(at, pieces) + nth * RUN, np.minimum(RUN, np.repeat(size, pieces) - nth * RUN)
        out.append((_mixed(m[at]), at + s, size))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _opened(row) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    body = _released(row["body"])
    return body, np.frombuffer(body, np.uint8), np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["ids"], "<i8")


def _split(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(own):
            yield int(group[own[0]]), own


def ordered(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of the rotations of `text` by their first `length` bytes or more, by doubling; ties stand in any order."""
    n = len(text)
    packed = np.zeros(n, np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    order, depth = np.argsort(packed), 8
    while True:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], packed[order[1:]] != packed[order[:-1]]]))
        if depth >= length or rank[order[-1]] == n - 1:
            return order
        packed = (rank << np.uint64(32)) | np.roll(rank, -depth)
        order, depth = np.argsort(packed), 2 * depth


def parted(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in `order` after the first: whether its rotation has less than `length` bytes in common with the one before.

    Starts from the interval of the empty string. An interval of the strings w is extended backward by every byte c
    of its transform; the last-to-first mapping takes it to the interval of cw. Where that ends, the common prefix with
    what follows is known for the first time at just this level or was at an earlier one; only in the first case
    is the interval kept for the next level, so every boundary is settled once.
    """
    n = len(text)
    kind = np.int32 if n < 1 << 22 else np.int64
    place = np.empty(n, kind)
    place[order] = np.arange(n, dtype=kind)
    last_to_first = place[order - 1]
    # Places count from 1, so that both neighbours of each exist; their first bytes part them as other intervals do.
    first = np.concatenate([[-1], text[order], [-1]]).astype(kind)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    owner, named = np.full(n + 2, -1, kind), 0
    low, high = np.array([0], kind), np.array([n], kind)
    for _ in range(length):
        size = high - low
        nth = np.repeat(np.arange(len(low), dtype=kind), size)
        shift = low - np.cumsum(size, dtype=kind) + size
        to = last_to_first[np.arange(len(nth), dtype=kind) + shift[nth]] + kind(1)
        # An interval and a first byte name the interval that they extend to.
        mark = ((nth + kind(named)) << kind(8)) | first[to]
        named += len(low)
        owner[to] = mark
        low, high = np.sort(to[owner[to - 1] != mark]) - 1, np.sort(to[owner[to + 1] != mark])
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        if not len(high):
            break
    return known[1:n]


def least_owner(parts: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of `length` bytes inside the stretches `parts`, in order: the least of `least` over stretches that hold it.

    Gives the values, stretch by stretch, and where those of each stretch begin.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(bytes([BETWEEN]).join(parts) + bytes([BETWEEN]), np.uint8)
    order = ordered(text, length)
    group = np.concatenate([[0], np.cumsum(parted(text, order, length))])
    starts = np.cumsum(sizes + 1) - sizes - 1
    strings = sizes - length + 1
    base = np.cumsum(strings) - strings
    at = np.repeat(starts - base, strings) + np.arange(strings.sum())
    value = np.full(len(text), LAST)
    value[at] = np.repeat(least, strings)
    smallest = np.minimum.reduceat(value[order], np.flatnonzero(np.diff(group, prepend=-1)))
    found = np.empty(len(text), np.int64)
    found[order] = smallest[group]
    return found[at], base


def _transforms(keys: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Stretches in lots of about `most` bytes, all of one key in the same lot."""
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(sizes[order] + 1)
    fresh = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0)
    fresh = np.append(fresh, len(order))
    k = 0
    while k < len(fresh) - 1:
        done = ends[fresh[k] - 1] if fresh[k] else 0
        j = max(k + 1, int(np.searchsorted(ends[fresh[k + 1:] - 1], done + most, "right")) + k)
        yield order[fresh[k]:fresh[j]]
        k = j


def _deduplicated(got: pd.DataFrame, length: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, rows of first and end byte) of what a group of buckets has removed."""
    number: dict[bytes, int] = {}
    named, keys = [], []
    for body, lengths, own in zip(got["body"], got["lengths"], got["keys"]):
        text, ends = _released(body), np.cumsum(_summed(lengths))
        begin, ids = 0, []
        for end in ends.tolist():
            ids.append(number.setdefault(text[begin:end], len(number)))
            begin = end
        ids = np.array(ids, np.int64)
        if len(number) > sum(map(len, keys)):
            fresh = np.unique(ids, return_index=True)
            new = fresh[0] >= sum(map(len, keys))
            keys.append(np.frombuffer(own, "<u4")[fresh[1][new]])
        named.append(ids)
    parts, keys = list(number), np.concatenate(keys)
    which = [ids[_summed(c)] for ids, c in zip(named, got["of"])]
    who = [_summed(w) for w in got["who"]]
    least = np.full(len(parts), LAST)
    np.minimum.at(least, np.concatenate(which), np.concatenate(who))
    sizes = np.array([len(p) for p in parts], np.int64)
    found: list[np.ndarray] = []  # (stretch, first string, strings, owner)
    for own in _transforms(keys, sizes, most):
        values, base = least_owner([parts[i] for i in own.tolist()], least[own], length)
        fresh = np.diff(values, prepend=values[0] ^ 1) != 0
        fresh[base] = True
        at = np.flatnonzero(fresh)
        stretch = np.searchsorted(base, at, "right") - 1
        found.append(np.stack([own[stretch], at - base[stretch], np.diff(np.append(at, len(values))), values[at]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    begin = np.searchsorted(runs[:, 0], np.arange(len(parts) + 1))
    for block, ids, w, starts in zip(got["block"].tolist(), which, who, got["starts"]):
        n = begin[ids + 1] - begin[ids]
        run = runs[np.repeat(begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        gone = run[:, 3] < np.repeat(w, n)
        first = (np.repeat(_summed(starts), n) + run[:, 1])[gone]
        if len(first):
            yield block, np.stack([first, first + run[gone, 2] + length - 1], axis=1)


def without_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", with_text: bool = False,
                    block: int = BLOCK, group: int = GROUP, transform: int = TRANSFORM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of `docs`.

    A byte goes if a string of `length` bytes (at least the 16 of a gram) that covers it also starts in a document with a
    smaller id, all judged on the whole input as UTF-8; `kept`, on request, holds the bytes left. Strings do not cross
    documents. Null and empty texts have no bytes; rows that repeat an id do not remove one another, and a null
    id is larger than all others; ids are whole numbers; an empty table gives no rows; other columns are not looked at.

    What moves: an 8-byte key for about every 18th byte (once for each block), then the stretches of those keys that
    two documents share, each distinct one once for each block, and the compressed blocks twice. A bucket that `crowd`
    documents fill is dealt out by whole strings. Groups of buckets are as many as the text has `group` bytes. A very long
    text is a block of its own, and its windows are made in slices.
    """
    if length < GRAM:
        raise ValueError(f"strings of {GRAM} bytes at least")
    kind = dict(docs.dtypes)[doc_id]
    stored = written(blocks(docs, doc_id, text, block), "blocks")
    # A few groups for each task, so that tasks are even, but no more than the text needs from some size on.
    few = min(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(few, -(-(stored.agg(F.sum("n_bytes")).first()[0] or 0) // group))

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                _, data, ends, _ = _opened(row)
                key, start, _ = stretches(data, ends, length)
                doc = np.searchsorted(ends, start, "right")
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[:len(key)]
                key, docs_ = np.unique(key[new], return_counts=True)
                out = [(p, _packed(key[own], "<u8"), _packed(docs_[own], "<u4")) for p, own in _split((key % np.uint64(groups)).astype(np.int64))]
                yield pd.DataFrame(out, columns=["p", "keys", "docs"]).assign(block=row["block"])

    def shared(got: pd.DataFrame) -> pd.DataFrame:
        key, n = _joined(got["keys"], "<u8"), _joined(got["docs"], "<u4")
        of = np.repeat(np.arange(len(got)), [len(k) // 8 for k in got["keys"]])
        _, same, inverse = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(inverse, n, len(same))[inverse]
        out = []
        for k, own in _split(of):
            many = own[total[own] > 1]
            if len(many):
                out.append((got["block"].iloc[k], _packed(key[many], "<u8"), _packed(total[many] > crowd, "u1")))
        return pd.DataFrame(out, columns=["block", "keys", "crowded"])

    def cut(held: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        names = ["p", "block", "keys", "lengths", "body", "of", "who", "starts"]
        if not len(held) or not len(lists):
            return pd.DataFrame([], columns=names)
        row = held.iloc[0]
        body, data, ends, ids = _opened(row)
        key, start, count = stretches(data, ends, length)
        wanted, crowded = _joined(lists["keys"], "<u8"), _joined(lists["crowded"], "u1")
        order = np.argsort(wanted)
        wanted, crowded = wanted[order], crowded[order]
        at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == key)
        key, start, count, many = key[hit], start[hit], count[hit], crowded[at[hit]] > 0
        if many.any():
            n = np.where(many, count, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key, many, start, count = np.repeat(key, n), np.repeat(many, n), np.repeat(start, n) + nth, np.repeat(np.where(many, 1, count), n)
            for i in np.flatnonzero(many).tolist():
                key[i] = xxhash.xxh64_intdigest(body[start[i]:start[i] + length])
        who = ids[np.searchsorted(ends, start, "right")]
        out = []
        for p, own in _split((key % np.uint64(groups)).astype(np.int64)):
            number: dict[bytes, int] = {}
            of = [number.setdefault(body[a:b], len(number)) for a, b in zip(start[own].tolist(), (start[own] + count[own] + length - 1).tolist())]
            of = np.array(of)
            first = own[np.unique(of, return_index=True)[1]]
            # Of a key four bytes are enough to bring its stretches together.
            out.append((p, row["block"], _packed(key[first] >> np.uint64(32), "<u4"), _steps([len(x) for x in number]), _pressed(b"".join(number)),
                        _steps(of), _steps(who[own]), _steps(start[own])))
        return pd.DataFrame(out, columns=names)

    def deduplicated(got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(b, _packed(s, "<i8")) for b, s in _deduplicated(got, length, transform)], columns=["block", "spans"])

    def told(held: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        if not len(held):
            return pd.DataFrame([], columns=names)
        row = held.iloc[0]
        body, data, ends, ids = _opened(row)
        begins = np.concatenate([[0], ends[:-1]])
        edge = np.zeros(len(data) + 1, np.int64)
        spans = _joined(found["spans"], "<i8").reshape(-1, 2)
        np.add.at(edge, spans[:, 0], 1)
        np.add.at(edge, spans[:, 1], -1)
        gone = np.cumsum(edge[:-1]) > 0
        opens = gone & ~np.concatenate([[False], gone[:-1]])[:len(gone)]
        opens[begins[begins < len(data)]] = gone[begins[begins < len(data)]]
        total, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
        removed, n_spans = total[ends] - total[begins], runs[ends] - runs[begins]
        kept = [body[a:b] if not r else data[a:b][~gone[a:b]].tobytes() for a, b, r in zip(begins.tolist(), ends.tolist(), removed.tolist())]
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_bytes": ends - begins, "n_removed": removed, "n_spans": n_spans,
                            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})
        out.loc[np.frombuffer(row["missing"], "u1") > 0, "doc_id"] = pd.NA
        return out.assign(kept=kept) if with_text else out

    bodies = stored.select("block", "ids", "missing", "ends", "body").groupBy("block")
    keys = (stored.select("block", "ends", "ids", "body").mapInPandas(filed, "p bigint, keys binary, docs binary, block bigint")
            .groupBy("p").applyInPandas(shared, "block bigint, keys binary, crowded binary"))
    parts = bodies.cogroup(keys.groupBy("block")).applyInPandas(
        cut, "p bigint, block bigint, keys binary, lengths binary, body binary, of binary, who binary, starts binary")
    spans = parts.groupBy("p").applyInPandas(deduplicated, "block bigint, spans binary")
    rows = bodies.cogroup(spans.groupBy("block")).applyInPandas(
        told, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))
