"""Packing of token pieces into full sequences: exact complements by hashed length sums, then best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.llm.common import as_text, written

#: Slices of one length's pieces, so that a length that a third of the pieces have is not numbered in one task.
SLICES = 64
#: How many of the longest available lengths are tried as the largest part of a pair or triple: all, 4, 1 or 0 (single lengths only).
REACHES = (None, 4, 1, 0)


def encoder(name: str = "byte_bpe_50k"):
    """text -> ids as `tokenizers` gives them for `name`.json with add_special_tokens=False.

    The same vocabulary is read as ranks, which encodes four times as fast; a test holds the two against each other.
    That reader gives up on a run of white space of about a million characters, so such a text goes to `tokenizers` itself.
    The special token's string is one token, as the library has it by default.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        try:
            return coder.encode(text, allowed_special="all")
        except ValueError:
            if not slow:
                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sizes, after a first piece that takes the remainder."""
    first = n % size or min(n, size)
    return [(0, first), *((k, size) for k in range(first, n, size))] if n else []


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2,
           tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of `docs`: its ids, closed by `end`, in pieces of `size`.

    A null text is the empty text, one piece of the one id `end`.
    """
    kinds = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for k, text_ in zip(batch["doc_id"].tolist(), batch["text"]):
                ids = np.array([*encode(text_ or ""), end], "<u4")
                for i, (a, n) in enumerate(cut(len(ids), size)):
                    own = ids[a:a + n]
                    rows.append((k, i, a, n, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] * with_ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return (docs.select(as_text(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(encoded, kinds)
            .withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[doc_id])))


def plan(counts: np.ndarray, size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of sequences that use up `counts[l]` pieces of each length l in 0..size.

    Works on the counts alone, so its cost does not depend on the number of pieces. How freely pairs and triples
    should be spent depends on the lengths, so the counts are planned with each of `REACHES`; the fewest sequences win,
    and of equals the plan with all sums.
    """
    return min((filled(counts, size, reach) for reach in REACHES), key=lambda p: sum(n for n, _ in p))


def filled(counts: np.ndarray, size: int, reach: int | None) -> list[tuple[int, tuple[int, ...]]]:
    """One plan: exact complements first, then best fit.

    Full pieces stand alone. Then each length's gap is looked up in the hashed sums: by single lengths, after all of
    those by pairs, after these by triples (one length and the pair sums of what is left). The parts of a sum are no longer
    than the length whose gap it fills. With `reach` None every sum is tried and no exact fill of up to four pieces is left;
    else the largest part of a pair or triple is one of the `reach` longest available that fit. As many sequences
    as the counts allow are closed at once. What no sum closes is packed by best fit, longest first, bins of equal
    gaps together.
    """
    have = counts.astype(np.int64).copy()
    have[0] = 0
    out: list[tuple[int, tuple[int, ...]]] = []

    def enough(parts: tuple[int, ...]) -> bool:
        return all(have[p] >= parts.count(p) for p in set(parts))

    def longest(most: int, least: int) -> list[int]:
        x = np.arange(most, least - 1, -1)
        return x[have[x] > 0][:reach].tolist() if len(x) else []

    def closed(held: tuple[int, ...], gap: int, parts: int) -> tuple[int, ...] | None:
        """`held` with `parts` further lengths, none longer than the last held, that add up to `gap`."""
        if parts < 2:
            own = (*held, gap) if parts else held
            return own if gap == 0 or (parts and gap <= held[-1] and enough(own)) else None
        for x in longest(min(held[-1], gap - parts + 1), -(-gap // parts)):
            if enough((*held, x)) and (own := closed((*held, x), gap - x, parts - 1)):
                return own
        return None

    def pairs(most: int, total: int) -> list[tuple[int, int]]:
        """The entry of a sum in the index: its pairs of lengths still there, the larger no longer than `most`, largest first."""
        low, most = -(-total // 2), min(most, total - 1)
        if most < low:
            return []
        ok = (have[low:most + 1] > 0) & (have[total - most:total - low + 1] > 0)[::-1]
        return [(x, total - x) for x in (low + np.flatnonzero(ok)[::-1]).tolist()]

    def sums(length: int, parts: int) -> Iterator[tuple[int, ...]]:
        """Every fill of `length` by `parts` further ones. One passed over is not possible later either, for counts only fall."""
        gap = size - length
        if parts == 2:
            yield from pairs(length, gap)
            return
        for x in range(min(length, gap - 2), -(-gap // 3) - 1, -1):
            if have[x] and have[length]:
                yield from ((x, *two) for two in pairs(x, gap - x))

    def close(own: tuple[int, ...]) -> None:
        n = min(int(have[p]) // own.count(p) for p in set(own))
        out.append((n, own))
        for p in own:
            have[p] -= n

    for parts in range(4):
        for length in np.flatnonzero(have).tolist():
            if reach is None and parts >= 2:
                for rest in sums(length, parts):
                    if enough((length, *rest)):
                        close((length, *rest))
                continue
            while have[length] and (own := closed((length,), size - length, parts)):
                close(own)

    # Best fit of the rest: open[gap] lists (times, parts) of bins with that gap.
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(n: int, parts: tuple[int, ...]) -> None:
        if n:
            open_.setdefault(size - sum(parts), []).append((n, parts))

    for length in range(size, 0, -1):
        left = int(have[length])
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                n, parts, gap = left, (), size
            else:
                n, parts = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            # The fullest bin takes pieces until no further one fits, so they go in groups of `fit`.
            fit = gap // length
            whole = min(n, left // fit)
            put(whole, parts + (length,) * fit)
            left -= whole * fit
            if whole < n and left:
                put(1, parts + (length,) * min(fit, left))
                left -= min(fit, left)
                whole += 1
            if parts:
                put(n - whole, parts)
    return out + [x for group in open_.values() for x in group]


def places(plan_: list[tuple[int, tuple[int, ...]]], size: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, sequence of that rank, offset), ordered by rank; the next ranks take the next sequences."""
    used, base = np.zeros(size + 1, np.int64), 0
    out: dict[int, list[tuple[int, int, int]]] = {}
    for times, parts in plan_:
        at = 0
        for p in parts:
            out.setdefault(p, []).append((int(used[p]), base, at))
            used[p] += times
            at += p
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(parts: DataFrame, size: int = 1024) -> DataFrame:
    """`parts` (a stored table of pieces with `doc_id`, `piece`, `start`, `length`, `ids_crc32`) with `sequence_id` and `offset`.

    Only the number of pieces of each length (at most `size` rows) reaches the driver, which plans on it. Pieces are
    numbered within their length and slice (by hash) in order of their columns, the slices one after another by
    their counts (`size` * 64 rows at most, the bound of what is broadcast); a piece's number and length say
    where the plan puts it. Pieces alike in all columns are interchangeable.
    """
    by = ["doc_id", "piece", "start", "ids_crc32"]
    sliced = parts.withColumn("slice", F.pmod(F.xxhash64(*by), SLICES).cast("int"))
    sizes = sliced.groupBy("length", "slice").count().toPandas().sort_values(["length", "slice"])
    counts = np.zeros(size + 1, np.int64)
    np.add.at(counts, sizes["length"].to_numpy(), sizes["count"].to_numpy())
    first = {(a, b): int(n) for a, b, n in zip(sizes["length"], sizes["slice"], sizes.groupby("length")["count"].cumsum() - sizes["count"])}
    where = parts.sparkSession.sparkContext.broadcast((first, places(plan(counts, size), size)))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, slice_: pd.Series, number: pd.Series) -> pd.DataFrame:
        first, spots = where.value
        rank = number.to_numpy() - 1 + np.fromiter((first[k] for k in zip(length, slice_)), np.int64, len(length))
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            rows, spot = np.flatnonzero(length == n), spots[int(n)]
            k = np.searchsorted(spot[:, 0], rank[rows], "right") - 1
            seq[rows] = spot[k, 1] + rank[rows] - spot[k, 0]
            off[rows] = spot[k, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    from pyspark.sql import Window

    numbered = sliced.withColumn("number", F.row_number().over(Window.partitionBy("length", "slice").orderBy(*by)))
    return (numbered.withColumn("_at", place("length", "slice", "number"))
            .withColumns({"sequence_id": F.col("_at.sequence_id"), "offset": F.col("_at.offset")}).drop("slice", "number", "_at"))


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2,
           tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """Every row of `docs` as pieces placed in sequences of at most `size` ids; see `pieces` and `pack`.

    Repeated rows are packed each; an empty table gives no rows; other columns are not looked at; a very long text
    is pieces like any other. Pieces are written once, since the plan needs their counts before they can be placed.
    """
    return pack(written(pieces(docs, doc_id, text, size, end, tokenizer, with_ids), "pieces"), size)
