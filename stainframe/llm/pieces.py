"""Unigram encoding over a double-array trie of pieces: Viterbi with byte fallback, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.llm.common import as_text

MARK = "▁"
#: Log scores are whole millionths, so that sums are exact; an unknown character costs this much more than the worst piece.
UNIT, PENALTY = 1_000_000, 10_000_000
#: A segment: blanks and what follows them up to the next blank, or a line end, which no piece holds.
SEGMENT = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Most distinct segments whose ids a task keeps, and bytes of new ones encoded at once (a longer segment stands alone).
CACHE, SLICE = 200_000, 1 << 17


@dataclass
class Model:
    pieces: list[str]
    score: np.ndarray  # millionths
    byte: np.ndarray  # id of each byte's piece
    base: np.ndarray  # double array: a child of state s by byte c is base[s] + c, if check there is s
    check: np.ndarray
    value: np.ndarray  # id of the piece that ends in a state, or -1


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of a trie over byte strings. States with most children are placed first, each at the first
    base where all its children's cells are free."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, v in zip(keys, values):
        s = 0
        for c in key:
            t = children[s].get(c)
            if t is None:
                t = children[s][c] = len(children)
                children.append({})
                ends.append(-1)
            s = t
        ends[s] = v
    room = len(children) * 2 + 1024
    free = np.ones(room, bool)
    free[0] = False
    where = np.zeros(len(children), np.int64)  # each state's cell
    bases = np.zeros(len(children), np.int64)
    # A search for a number of children goes on where the last one for that number ended.
    resume: dict[int, int] = {}
    for node in sorted((i for i, x in enumerate(children) if x), key=lambda i: (-len(children[i]), i)):
        k = np.array(sorted(children[node]))
        start = resume.get(len(k), 1)
        while True:
            if start + 1024 >= len(free):
                free = np.append(free, np.ones(len(free), bool))
            fits = free[np.arange(start, start + 256)[:, None] + k].all(axis=1)
            if fits.any():
                break
            start += 256
        b = start + int(np.argmax(fits))
        resume[len(k)] = b
        bases[node] = b
        free[b + k] = False
        for c in k.tolist():
            where[children[node][c]] = b + c
    base, check, value = np.zeros(len(free), np.int32), np.full(len(free), -1, np.int32), np.full(len(free), -1, np.int32)
    base[where], value[where] = bases, ends
    for node, x in enumerate(children):
        for child in x.values():
            check[where[child]] = where[node]
    top = int(np.flatnonzero(~free)[-1]) + 257
    return base[:top], check[:top], value[:top]


def build(pieces: list[str], ranks: list[int | None]) -> Model:
    """The model of pieces in id order. `ranks` orders those that may be used, from 0; None is never matched (control and
    byte pieces). The log score of rank r is -log(r + 2): Zipf's law for a list ordered by use."""
    score = np.array([0 if r is None else round(-np.log(r + 2) * UNIT) for r in ranks], np.int64)
    used = [i for i, r in enumerate(ranks) if r is not None]
    byte = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int64)
    return Model(pieces, score, byte, *double_array([pieces[i].encode() for i in used], used))


def load(path: str) -> Model:
    """The pieces of a public model file; nothing in it is trained anew. Its pieces stand in order of use, which gives the ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    rank = {i: r for r, i in enumerate(plain)}
    pieces = [sp.id_to_piece(i) for i in range(n)]
    if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("segments are right only if no piece holds a line end or a blank behind other characters")
    return build(pieces, [rank.get(i) for i in range(n)])


def viterbi(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and their number for each segment (bytes, not empty), all segments at a time.

    The trie is walked from every byte at once, one byte deeper each step, which gives every piece that matches.
    Then ends are met from left to right, all segments' ends at the same distance together: the best score of an end is
    the best over pieces that end there of the score at the piece's start plus its own; of equals the longest piece.
    A character that is no piece by itself may stand as its bytes, at the penalty.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - (np.arange(len(raw)) - first)  # bytes to the segment's end
    lead = (raw & 0xC0) != 0x80
    width = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
    start, state, depth = np.flatnonzero(lead), np.zeros(int(lead.sum()), np.int64), 0
    edges, whole = [], np.zeros(len(raw), bool)
    while len(start):
        to = model.base[state] + raw[start + depth]
        ok = (model.check[to] == state) & (model.base[state] > 0)
        start, state = start[ok], to[ok]
        depth += 1
        hit = model.value[state] >= 0
        s, v = start[hit], model.value[state[hit]].astype(np.int64)
        edges.append((s, np.full(len(s), depth), v, model.score[v]))
        whole[s[width[s] == depth]] = True
        more = left[start] > depth
        start, state = start[more], state[more]
    lost = np.flatnonzero(lead & ~whole)
    edges.append((lost, width[lost], np.full(len(lost), -1), np.full(len(lost), int(model.score.min()) - PENALTY)))
    s, n, v, w = (np.concatenate(x) for x in zip(*edges))
    # Positions before and behind bytes: segment k has its own sizes[k] + 1 of them.
    shift = np.repeat(np.arange(len(texts)), sizes)
    source, end = s + shift[s], s + n + shift[s]
    within = s + n - first[s]
    order = np.lexsort((s, end, within))
    s, n, v, w, source, end, within = (x[order] for x in (s, n, v, w, source, end, within))
    best = np.full(len(raw) + len(texts), np.iinfo(np.int64).min // 2)
    heads = np.cumsum(sizes + 1) - sizes - 1
    best[heads] = 0
    by = np.full(len(best), -1, np.int64)
    cuts = np.append(np.flatnonzero(np.diff(within, prepend=-1)), len(within))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        total = best[source[a:b]] + w[a:b]
        group = np.flatnonzero(np.diff(end[a:b], prepend=-1))
        top = np.maximum.reduceat(total, group)
        winner = total == np.repeat(top, np.diff(np.append(group, b - a)))
        at = np.flatnonzero(winner)[::-1]  # the first winner of an end is written last
        best[end[a + group]] = top
        by[end[a + at]] = a + at
    # Back from all ends at once.
    chosen, owner = [], []
    here, who = heads + sizes, np.arange(len(texts))
    while len(here):
        e = by[here]
        chosen.append(e)
        owner.append(who)
        here = source[e]
        go = here != heads[who]
        here, who = here[go], who[go]
    e, o = (np.concatenate(chosen), np.concatenate(owner)) if chosen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((s[e], o))
    e, o = e[order], o[order]
    count = np.where(v[e] < 0, n[e], 1)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rows = np.repeat(e, count)
    ids = np.where(v[rows] >= 0, v[rows], model.byte[raw[np.minimum(s[rows] + step, len(raw) - 1)]] if len(raw) else 0)
    return ids, np.bincount(o, weights=count, minlength=len(texts)).astype(np.int64)


def segments(text: str) -> list[str]:
    """Parts of a blank and the text, with blanks as markers, that no piece crosses. A line end is a segment of its own."""
    return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


class Encoder:
    """Encodes texts one after another and keeps the ids of segments it has met, CACHE of them at most."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.flat, self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Encodes new segments, SLICE bytes of them at a time: a byte has a handful of matching pieces, each some numbers."""
        cuts = np.flatnonzero(np.diff(np.cumsum([len(x) for x in new]) // SLICE, prepend=0))
        flat, many = zip(*(viterbi(self.model, new[a:b]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(new)]) if a < b))
        count = np.concatenate(many)
        self.first = np.append(self.first, len(self.flat) + np.cumsum(count) - count)
        self.many, self.flat = np.append(self.many, count), np.append(self.flat, np.concatenate(flat))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE:
            self.clear()
        known, coded = self.number, []
        for t in texts:
            coded.append(np.array([known.setdefault(x, len(known)) for x in segments(t)], np.int64))
        if len(known) > len(self.first):
            self.learn([x.encode("utf-8", "surrogatepass") for x in islice(known, len(self.first), None)])
        out = []
        for k in coded:
            n = self.many[k]
            out.append(self.flat[np.arange(n.sum()) + np.repeat(self.first[k] - np.cumsum(n) + n, n)].astype(np.int32))
        return out


class Decoder:
    """ids -> text: piece bytes one after another, blank markers as blanks, without the blank put before the text."""

    def __init__(self, model: Model):
        self.bytes = [p.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte):
            self.bytes[i] = bytes([b])

    def __call__(self, ids) -> str:
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", bytes_at_once: int = 4 << 20) -> DataFrame:
    """(doc_id, ids, n_ids, n_bytes, restored), one row for each row of `docs`.

    `n_bytes` counts ids of the byte fallback, `restored` tells whether decoding the ids gives the text again; that
    fails only where a text holds the marker character itself, which decodes to a blank. Null and empty texts have
    no ids; repeated rows stay; an empty table gives no rows; other columns are not looked at. Texts are encoded whole,
    about `bytes_at_once` of them together; the model (bounded by its piece list) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        is_byte = np.zeros(len(shared.value.pieces), bool)
        is_byte[shared.value.byte] = True

        def rows(keys, texts):
            ids = encoder(texts)
            return pd.DataFrame({"doc_id": keys, "ids": ids, "n_bytes": [int(is_byte[i].sum()) for i in ids],
                                 "restored": [decoder(i.tolist()) == t for i, t in zip(ids, texts)]})

        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch["doc_id"].tolist(), batch["text"]):
                keys.append(k)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= bytes_at_once:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield rows(keys, texts)

    kind = dict(docs.dtypes)[doc_id]
    return (docs.select(as_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
            .mapInPandas(encoded, "doc_id string, ids array<int>, n_bytes bigint, restored boolean")
            .select(F.col("doc_id").cast(kind).alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_ids"), "n_bytes", "restored"))


def decode(rows: DataFrame, model: Model, ids: str = "ids", name: str = "text") -> DataFrame:
    """`rows` with the text of their ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for batch in batches:
            yield pd.Series([None if x is None else decoder(x) for x in batch], dtype=object)

    return rows.withColumn(name, decoded(F.col(ids)))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
