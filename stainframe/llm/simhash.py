"""Near duplicates by SimHash: fingerprints, links found by pigeonring filtering, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stainframe.llm.common import components, written

#: Segments of a fingerprint, from the highest bits: their widths in bits, 64 together.
WIDTHS = (13, 13, 13, 13, 12)
#: Most rows of one bucket that are compared in one piece; a larger bucket is cut into tiles.
TILE = 4096


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's shingles of `size` words, as a signed number; 0 without words.

    A-Z are lower-cased, words are runs without ASCII white space, repeats count, and a text of fewer words is one
    shingle. A bit is set if it is set in over half of the shingles' hashes. The shingles of a text are hashed in
    slices of 65,536, so a long text needs no more memory than that.
    """
    import xxhash

    # bytes.lower and bytes.split know ASCII only, which is what is asked for.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[size - 1:] if len(parts) >= size else ends[-1:]
    first = starts[: len(last)]
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(last), 65536):
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(first[k:k + 65536].tolist(), last[k:k + 65536].tolist())], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """`docs` with the signed fingerprint of each row's text; null is the empty text."""
    @F.pandas_udf("bigint")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.withColumn(name, fingerprints(F.col(text)))


def segments(fp: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """(n, number of segments) segment values of unsigned fingerprints."""
    out, shift = [], 64
    for w in widths:
        shift -= w
        out.append((fp >> np.uint64(shift)) & np.uint64((1 << w) - 1))
    return np.stack(out, axis=1)


def chain_keys(fp: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each start of the ring, the keys under which a fingerprint can meet one it links with.

    Of two linked fingerprints some chain starts with an equal segment whose follower differs in at most one bit
    (budgets 4/5 and 8/5 of a bit, and with b + 1 segments for b bits less than 1 and 2 as well). The key is the start, its segment and the follower; a row stands under its own
    key and under those where one set bit of the follower is cleared, so that two followers one bit apart meet at
    the one with fewer bits. That is 1 + half a follower's bits on average, 37 keys a fingerprint in all.
    """
    s, rows, keys, n = segments(fp, widths), [], [], np.arange(len(fp))
    for i in range(len(widths)):
        j = (i + 1) % len(widths)
        base = (np.uint64(i) << np.uint64(26)) | (s[:, i] << np.uint64(13)) | s[:, j]
        rows.append(n)
        keys.append(base)
        for b in range(widths[j]):
            bit = np.uint64(1 << b)
            has = np.flatnonzero(s[:, j] & bit)
            rows.append(has)
            keys.append(base[has] ^ bit)
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, bits: int, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """Whether pairs differ in at most `bits` bits; a pair whose chain from `start` leaves its budget is not measured further.

    After l of n segments of the chain at most l * bits / n bits may differ. Every linked pair passes from some start,
    and the last step, all segments, is the full check.
    """
    n = len(widths)
    alive = np.arange(len(a))
    gone = np.zeros(len(a), np.int64)
    x = segments(a ^ b, widths)
    start = np.broadcast_to(start, len(a))
    for l in range(1, n + 1):
        gone += np.bitwise_count(x[np.arange(len(x)), (start + l - 1) % n])
        ok = n * gone <= l * bits
        x, start, gone, alive = x[ok], start[ok], gone[ok], alive[ok]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def forest(fp: np.ndarray, start: int, bits: int) -> list[tuple[int, int]]:
    """Links that connect the rows of one bucket as far as its chain shows: at most one fewer than there are rows.

    Grows one tree at a time: a row is measured against the rows no tree has reached, so no pairs are listed."""
    left, out = np.arange(1, len(fp)), []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        u = queue.pop()
        near = linked(fp[left], np.broadcast_to(fp[u], len(left)), np.int64(start), bits)
        out += [(u, int(v)) for v in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return out


def bucket_links(key: np.ndarray, tile: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """(m, 2) linked fingerprints of rows sorted by key and tile."""
    cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    n = end - begin
    two = begin[n == 2]
    ok = linked(fp[two], fp[two + 1], key[two] >> 26, bits)
    found = [np.stack([fp[two[ok]], fp[two[ok] + 1]], axis=1)]
    for a, b in zip(begin[n > 2].tolist(), end[n > 2].tolist()):
        own = np.unique(fp[a:b])
        if links := forest(own, int(key[a] >> 26), bits):
            found.append(own[np.array(links)])
    return np.concatenate(found)


def links(nodes: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v) signed fingerprints of `nodes` (column `fp`, distinct) that connect all those `bits` or fewer apart.

    No link between components is lost, but inside one bucket only a spanning forest is given. A bucket of more than
    `tile` rows (a crowd of near copies) is cut into chunks by hash, and every two chunks meet in a tile of their own.
    """
    if not 0 <= bits < 5:
        raise ValueError("five segments hold for at most 4 differing bits")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, keys = chain_keys(batch["fp"].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"key": keys, "fp": batch["fp"].to_numpy()[rows]})

    rows = nodes.select("fp").mapInPandas(keyed, "key bigint, fp bigint")
    crowds = rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).alias("t"))
    # A row of chunk c stands in the t tiles (min(c, j), max(c, j)).
    tiled = rows.join(crowds, "key", "left").withColumn("c", F.pmod(F.xxhash64("fp"), F.coalesce("t", F.lit(1)))).select(
        "key", "fp", F.explode(F.when(F.col("t").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("t") - 1),
            lambda j: F.least("c", j) * F.col("t") + F.greatest("c", j)))).alias("tile"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame({"key": [], "tile": [], "fp": []}, dtype="int64")
        for batch in batches:
            now = pd.concat([rest, batch[["key", "tile", "fp"]]], ignore_index=True)
            same = (now["key"] == now["key"].iloc[-1]) & (now["tile"] == now["tile"].iloc[-1])
            whole = len(now) - int(same.sum())
            rest = now.iloc[whole:]
            if whole:
                yield out(now.iloc[:whole])
        if len(rest):
            yield out(rest)

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        found = bucket_links(rows["key"].to_numpy(), rows["tile"].to_numpy(), rows["fp"].to_numpy(np.int64).view(np.uint64), bits)
        found = np.unique(found.view(np.int64).reshape(-1, 2), axis=0)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return (tiled.repartition("key", "tile").sortWithinPartitions("key", "tile")
            .mapInPandas(compared, "u bigint, v bigint").distinct())


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of `docs`: the near-duplicate class of each document.

    Fingerprints link at `bits` or fewer differing bits; `component_id` is the smallest id reachable (null ids count
    only if there is no other). Equal texts share a fingerprint and are one node, however many they are. Null and
    empty texts have fingerprint zero, which links like any other; repeated rows stay; an empty table gives no rows;
    other columns are not looked at.
    """
    rows = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = components(links(nodes, bits))
    rooted = nodes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """The rows of `docs` that stay: of each class the document with the smallest id, with all its columns.

    Of several rows with that id one stays, the one whose text hashes lowest; a class of null ids keeps one row.
    """
    rows = written(with_fingerprint(docs, text, "_fp"), "simhash")
    nodes = written(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("least")), "nodes")
    stars = components(links(nodes, bits))
    rooted = nodes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min_by("fp", F.struct(F.col("least").isNull(), "least", "fp")).alias("_fp"), F.min("least").alias("_least"))
    chosen = rows.join(kept, (rows["_fp"] == kept["_fp"]) & rows[doc_id].eqNullSafe(kept["_least"]), "left_semi")
    return chosen.withColumn("_t", F.xxhash64(text)).groupBy("_fp").agg(F.min_by(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("_t")).alias("_row")).select("_row.*")


# ---- near copies at five words and a similarity of 0.8 ----------------------------------------------

#: Words of the shingles that candidates are searched by, and of those that decide; fingerprints of each.
FINDING, DECIDING = (2, 5), (5, 8)
#: Bits that fingerprints of candidates may differ in, and bits of the 512 deciding ones. At a five-word similarity of 0.8 about 78
#: of these differ, give or take 8; two words more often survive an edit than five, so candidates are nearer than that.
NEAR_BITS, APART = 4, 86


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def near_prints(text: str | None) -> np.ndarray:
    """The fingerprints of a text, unsigned: five of its two-word shingles, eight of its five-word ones; zeros without words.

    Words are hashed once; a shingle's hash is made of its words' and each fingerprint of the shingle's anew. Words,
    repeats and short texts are as in `fingerprint`; a long text is read in slices.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.zeros(FINDING[1] + DECIDING[1], np.uint64)
    if not parts:
        return out
    known: dict[bytes, int] = {}
    words = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w, 42)) for w in parts], np.uint64)
    at = 0
    for size, n in (FINDING, DECIDING):
        size, last, ones = min(size, len(words)), max(1, len(words) - size + 1), np.zeros((n, 64), np.int64)
        for k in range(0, last, 65536):
            m = min(65536, last - k)
            x = np.zeros(m, np.uint64)
            for j in range(size):
                x = _scrambled(x * np.uint64(3) + words[k + j:k + j + m])
            for j in range(n):
                x = _scrambled(x + np.uint64(0x9E3779B97F4A7C15))
                ones[j] += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[at:at + n] = np.packbits(2 * ones > last, axis=1).view(">u8")[:, 0]
        at += n
    return out


def near_widths(bits: int) -> tuple[int, ...]:
    """One segment more than `bits`, as even as can be."""
    n = bits + 1
    return tuple(64 // n + (i < 64 % n) for i in range(n))


def near(p: np.ndarray, q: np.ndarray, part: int, start: int, bits: int, apart: int) -> np.ndarray:
    """Whether rows of fingerprints `p` are near copies of `q`, as far as the chain from `start` of candidate fingerprint `part` shows."""
    out = linked(p[:, part], np.broadcast_to(q[part], len(p)), np.int64(start), bits, near_widths(bits))
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(p[at, FINDING[1]:] ^ q[FINDING[1]:]).sum(axis=1) <= apart
    return out


def meeting_keys(p: np.ndarray, q: np.ndarray, bits: int) -> np.ndarray:
    """Of all keys under which rows of fingerprints `p`, `q` meet and link, the one that counts; -1 where there is none.

    It is that of the first chain that holds: its start, its segment and the bits both followers have. In the order of
    chains, and of one chain from the key with most bits on, no key under which the two link stands before it.
    """
    widths = near_widths(bits)
    out = np.full(len(p), -1, np.int64)
    for part in range(FINDING[1]):
        s, t = (segments(x[:, part], widths).astype(np.int64) for x in (p, q))
        for start in range(len(widths)):
            after = (start + 1) % len(widths)
            rest = np.flatnonzero(out < 0)
            ok = rest[linked(p[rest, part], q[rest, part], np.int64(start), bits, widths)]
            out[ok] = part << 40 | start << 26 | s[ok, start] << 13 | s[ok, after] & t[ok, after]
    return out


def near_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = NEAR_BITS, apart: int = APART,
                         tile: int = TILE) -> DataFrame:
    """The rows of `docs` that stay, with all columns: one of each class of near copies, the one with the smallest id.

    Two texts link if one of five 64-bit fingerprints of their two-word shingles differs in at most `bits` bits, found by
    pigeonring as in `links`, and the 512 bits over their five-word shingles in at most `apart`, which estimates a five-word
    similarity of 0.8. Classes are what links connect. Equal texts are one node, however many they are.

    Null ids come after all others; of several rows with the smallest id the one whose text hashes lowest stays. Null
    and empty texts are one class; an empty table gives no rows. Keys that only one node has are dropped before fingerprints move.

    A bucket gives a spanning forest, but of its links only those whose `meeting_keys` it is: the ends of any other are
    joined by links of the bucket where that one counts, which comes earlier. So a link is made once, in however many buckets
    a crowd of near copies meets.
    """
    @F.pandas_udf("array<bigint>")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([near_prints(t).view(np.int64) for t in texts])

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body, key = F.col("doc").getField(text), F.col("doc").getField(doc_id)
    own = own.withColumns({"id": F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")), "hash": F.xxhash64(body)})
    rows = written(own.select("id", "hash", F.struct(key.isNull(), key, F.col("hash")).alias("order"), prints(body).alias("prints")), "prints")
    nodes = written(rows.groupBy("prints").agg(F.min(F.struct("order", "id", "hash")).alias("best")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.stack(batch["prints"].tolist()).view(np.uint64)
            for part in range(FINDING[1]):
                at, keys = chain_keys(p[:, part], near_widths(bits))
                yield pd.DataFrame({"key": keys | (part << 40), "node": batch["node"].to_numpy()[at]})

    keys = nodes.select("node", "prints").mapInPandas(keyed, "key bigint, node bigint")
    several = keys.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / tile).alias("t"))
    members = keys.join(several, "key").withColumn("c", F.pmod(F.xxhash64("node"), F.col("t")))
    # A row of chunk c stands in the t tiles (min(c, j), max(c, j)). Two rows of one chunk count in its own tile, where side is -1.
    members = members.select("key", "node", F.explode(F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("t") - 1), lambda j: F.struct(
            (F.least("c", j) * F.col("t") + F.greatest("c", j)).alias("tile"), F.when(j != F.col("c"), F.col("c")).otherwise(-1).alias("side")))).alias("at"))
    members = members.select("key", "node", "at.tile", "at.side")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            now = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            same = (now["key"] == now["key"].iloc[-1]) & (now["tile"] == now["tile"].iloc[-1])
            rest, whole = now[same.to_numpy()], now[~same.to_numpy()]
            if len(whole):
                yield met(whole)
        if rest is not None and len(rest):
            yield met(rest)

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        key, at, node, side = (rows[c].to_numpy() for c in ("key", "tile", "node", "side"))
        p = np.stack(rows["prints"].tolist()).view(np.uint64)
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(at) != 0)) + 1
        u, v = [], []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
            part, start = int(key[a]) >> 40, int(key[a]) >> 26 & 0x3FFF
            # One tree at a time: a row is measured against those that no tree has reached. Trees start from the least
            # node, so that the many buckets of a crowd give the same links.
            left, queue = np.arange(a + 1, b), [a]
            while len(left):
                if not queue:
                    queue, left = [int(left[0])], left[1:]
                    continue
                k = queue.pop()
                hit = near(p[left], p[k], part, start, bits, apart)
                u += [k] * int(hit.sum())
                v += left[hit].tolist()
                queue += left[hit].tolist()
                left = left[~hit]
        u, v = np.array(u, np.int64), np.array(v, np.int64)
        first = (meeting_keys(p[u], p[v], bits) == key[u]) & ((side[u] < 0) | (side[u] != side[v]))
        return pd.DataFrame({"u": node[u[first]], "v": node[v[first]]})

    edges = (members.join(nodes.select("node", "prints"), "node").repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
             .select("key", "tile", "node", "side", "prints").mapInPandas(compared, "u bigint, v bigint"))
    rooted = nodes.select("node", "best").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.hash")
    # Of rows alike in id and text one stays; the join has brought them together.
    same = Window.partitionBy("id", "hash").orderBy(F.xxhash64("doc"))
    return own.join(stay, ["id", "hash"]).withColumn("nth", F.row_number().over(same)).where("nth = 1").select("doc.*")
