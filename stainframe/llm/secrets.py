"""Secret scans: fixed patterns, and strings in sensitive contexts that a primed compressor cannot shorten."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.llm.common import as_text

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns' fixed values.
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Words that make a context sensitive, wherever they stand in an identifier.
CONTEXT = (b"auth", b"bearer", b"cookie", b"credential", b"key", b"login", b"passphrase", b"passwd", b"password", b"private",
           b"pwd", b"secret", b"session", b"signature", b"token")
#: The candidate itself, and what may stand between the lines of one wrapped value.
VALUE = re.compile(rb"[A-Za-z0-9+/_.=~-]{16,}")
WRAP = re.compile(rb"""[\s\\"',]*""")
#: Bytes of text on either side that are a candidate's context and prime the compressors.
AROUND = 512
#: Longest context of the character model, and the share of a random string's bits that a novel string has under it at
#: least: a random one has more, since the model expects words.
ORDER, WORDY = 3, 1.1
#: Identifiers common in code and configuration, the rest of the dictionary: fixed values.
IDENTIFIERS = (
    "access account address application argument array attribute author authorization await base64 body boolean buffer build cache "
    "callback certificate class client command config connection console const container content context cookie count create "
    "credential current database debug default delete description development directory document domain double element email "
    "encoding endpoint environment error event example exception export extends false field file filter final float format "
    "function global group handler hash header height host html http https identifier implements import include index input "
    "insert instance integer interface internal iterator json keyword label language length license library list local location "
    "login manager master message method model module null number object operation option order output package page parameter "
    "parent password path pattern placeholder plugin point port position prefix private process production project property "
    "protected protocol provider public query queue random readme record reference region register release remote request "
    "require resource response result return route schema script search secret select self sequence server service session "
    "setting signature size source standard state static status stream string struct style system table target template test "
    "text thread time timeout title token true type undefined union unique update upload user username utils valid value variable "
    "vector version view void warning width window worker write www xml your_api_key_here changeme example.com localhost "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx 1234567890abcdef"
).encode()


def hex_runs(b: np.ndarray) -> np.ndarray:
    """(n, 2) starts and ends of the runs of [0-9a-f] of 16 bytes or more."""
    is_hex = np.zeros(len(b) + 2, np.int8)
    is_hex[1:-1] = ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 102))
    turn = np.flatnonzero(np.diff(is_hex)).reshape(-1, 2)
    return turn[turn[:, 1] - turn[:, 0] >= 16]


def positions(low: bytes, words: tuple[bytes, ...]) -> list[int]:
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            out.append(at)
            at = low.find(w, at + 1)
    return sorted(out)


def base_spans(raw: bytes, low: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in bytes. A match that is too short still ends where it ends."""
    out, free = [], 0
    for at in positions(low, WORDS):
        if at >= free and (m := ASSIGN.match(raw, at)):
            free = m.end()
            if len(m[2]) >= 12:
                out.append((m.start(), m.end(), "assign"))
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if len(m[0]) >= 18]
    return out + [(int(a), int(e), "hex") for a, e in hex_runs(np.frombuffer(raw, np.uint8))]


def marginal(value: bytes, around: bytes) -> int:
    """Bytes that `value` adds to a compressor that has seen the identifiers and the text around it.

    The raw dictionary is the identifier list, then the surroundings, nearest last. What an empty input costs in
    the same frame is taken off.
    """
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(coder.compress(value)) - len(coder.compress(b""))


Counts = tuple[dict[bytes, int], dict[bytes, int], dict[bytes, int]]


def counted(text: bytes) -> Counts:
    """How often each run of up to ORDER + 1 bytes stands in `text`, how often each context is followed, and by how many different bytes."""
    runs: dict[bytes, int] = {}
    for k in range(1, ORDER + 2):
        for i in range(len(text) - k + 1):
            run = text[i:i + k]
            runs[run] = runs.get(run, 0) + 1
    followed: dict[bytes, int] = {}
    kinds: dict[bytes, int] = {}
    for run, n in runs.items():
        followed[run[:-1]] = followed.get(run[:-1], 0) + n
        kinds[run[:-1]] = kinds.get(run[:-1], 0) + 1
    return runs, followed, kinds


@lru_cache(maxsize=1)
def known() -> Counts:
    return counted(b" " + IDENTIFIERS.lower() + b" ")


def alphabet(value: bytes) -> int:
    """Size of the alphabet that `value` shows: its digits, letters of either case (six if none is beyond f) and signs."""
    size = 10 * bool(re.search(rb"[0-9]", value)) + len(set(re.findall(rb"[^A-Za-z0-9]", value)))
    for case, wide in ((rb"[a-z]", rb"[g-z]"), (rb"[A-Z]", rb"[G-Z]")):
        size += (26 if re.search(wide, value) else 6) * bool(re.search(case, value))
    return size


def modelled(value: bytes, around: bytes) -> float:
    """Bits of `value` by a character model that has seen the identifiers and the text around it.

    Contexts of 0 to 3 bytes are blended by Witten and Bell's rule, without case; where the letters stand is paid for
    apart. What zstandard cannot see in so short a string, that a word is made of usual syllables, this does.
    """
    low = value.lower()
    sets = (known(), counted(b" " + around.lower() + b" "))
    floor, text, bits = 1 / max(2, alphabet(low)), b" " + low, 0.0
    for i in range(1, len(text)):
        p = floor
        for k in range(min(ORDER, i) + 1):
            context, run = text[i - k:i], text[i - k:i + 1]
            n = t = c = 0
            for runs, followed, kinds in sets:
                if context in followed:
                    n, t, c = n + followed[context], t + kinds[context], c + runs.get(run, 0)
            if not n:
                break
            p = (c + t * p) / (n + t)
        bits -= np.log2(p)
    letters, upper = len(re.findall(rb"[A-Za-z]", value)), len(re.findall(rb"[A-Z]", value))
    if 0 < upper < letters:
        q = upper / letters
        bits += np.log2(letters + 1) - upper * np.log2(q) - (letters - upper) * np.log2(1 - q)
    return bits


def is_novel(value: bytes, before: bytes, after: bytes, novelty: float) -> bool:
    """Whether neither compressor shortens `value` against the bits that a random string of its length and alphabet has.

    For zstandard the limit is `novelty` of these bits, for the character model WORDY. No code saves t bits on more than
    one in 2^t random strings, so these are seldom missed at any length or alphabet. Copies of the value in the text
    around do not make it known, unless they stand side by side on a line.
    """
    if not re.search(re.escape(value) + rb"[\x20\t]+" + re.escape(value), before + value + after):
        before, after = before.replace(value, b" "), after.replace(value, b" ")
    around, full = after + b"\n" + before, len(value) * np.log2(max(2, alphabet(value)))
    return 8 * marginal(value, around) >= novelty * full and modelled(value, around) >= WORDY * full


def novel_spans(raw: bytes, low: bytes, taken: list[tuple[int, int, str]], novelty: float) -> list[tuple[int, int, str]]:
    """Candidates near a sensitive word that are novel, and every other place of the same string.

    Base spans must leave 16 bytes of one: an upper-case hex key may hold a run of digits that is a hex span itself.
    A candidate is a run of 16 or more characters of keys with a sensitive word in the 512 bytes before or behind it, on
    whatever line. Runs with only line ends, quotes, commas or backslashes between them are one wrapped value and share
    their context, so that a key block is sensitive throughout.
    """
    at = positions(low, CONTEXT)
    if not at:
        return []
    groups: list[list[re.Match]] = []
    for m in VALUE.finditer(raw):
        if groups and WRAP.fullmatch(raw, groups[-1][-1].end(), m.start()):
            groups[-1].append(m)
        else:
            groups.append([m])
    base: list[list[int]] = []  # the base spans, those that overlap as one
    for a, e, _ in sorted(taken):
        if base and a <= base[-1][1]:
            base[-1][1] = max(base[-1][1], e)
        else:
            base.append([a, e])
    ends = [e for _, e in base]

    def clear(a: int, e: int) -> bool:
        k, left = bisect_left(ends, a), e - a
        while k < len(base) and base[k][0] < e:
            left -= max(0, min(e, base[k][1]) - max(a, base[k][0]))
            k += 1
        return left >= 16

    out, found = set(), set()
    for group in groups:
        k = bisect_left(at, group[0].start() - AROUND)
        if k == len(at) or at[k] >= group[-1].end() + AROUND:
            continue
        for m in group:
            a, e = m.span()
            value = m[0]
            # `key=value` is one run: the value begins behind the last sign that a name precedes.
            if (cut := re.match(rb"[A-Za-z_.-]{2,32}=(?=[^=])", value)) is not None:
                a, value = a + cut.end(), value[cut.end():]
            if len(value) < 16 or value in found or not clear(a, e):
                continue
            if is_novel(value, raw[max(0, a - AROUND):a], raw[e:e + AROUND], novelty):
                found.add(value)
                out.add((a, e, "novel"))
    # Places of the found strings, inside longer runs too, in one pass: by their first 16 bytes.
    heads: dict[bytes, list[bytes]] = {}
    for value in found:
        heads.setdefault(value[:16], []).append(value)
    for m in VALUE.finditer(raw) if heads else ():
        for a in range(m.start(), m.end() - 15):
            for value in heads.get(raw[a:a + 16], ()):
                if raw.startswith(value, a) and clear(a, a + len(value)):
                    out.add((a, a + len(value), "novel"))
    return sorted(out)


def spans(text: str | None, novelty: float = 0.9) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed in `KINDS`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = base_spans(raw, low)
    found += novel_spans(raw, low, found, novelty)
    if len(raw) != len(text or ""):
        # Code points before a byte: the bytes that do not continue one.
        first = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        found = [(int(first[a]), int(first[e]), k) for a, e, k in found]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{e}" for a, e, k in found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", novelty: float = 0.9) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>), one row for each row of `docs`.

    A row needs nothing but itself. Null text is empty and has no spans; repeated rows stay; an empty table gives no
    rows; other columns are not looked at; a very long text is scanned whole.
    """
    kind = dict(docs.dtypes)[doc_id]

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": pd.Series([
                [{"start": a, "end": e, "kind": k} for a, e, k in spans(t, novelty)] for t in batch["text"]], dtype=object)})

    return docs.select(as_text(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        scanned, "doc_id string, spans array<struct<start:bigint,end:bigint,kind:string>>").withColumn("doc_id", F.col("doc_id").cast(kind))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as text, from `scan`'s rows."""
    def text(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    counts = [F.size(F.filter(F.col("spans.kind"), lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda s: s.kind != "novel")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[secret]", novelty: float = 0.9) -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping ones by one) and `n_chars` counted anew where that changes a text."""
    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        def hide(t):
            out, at = [], 0
            for a, e, _ in spans(t, novelty):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, e)
            return t if not out else "".join(out) + t[at:]

        return pd.Series([hide(t) for t in texts], dtype=object)

    if n_chars is None or n_chars not in docs.columns:
        return docs.withColumn(text, hidden(F.col(text)))
    # One struct holds the new text, so that no working column can meet one of the table's.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = own.withColumn("new", hidden(F.col("doc").getField(text)))
    same = F.col("new").eqNullSafe(F.col("doc").getField(text))
    count = F.when(same, F.col("doc").getField(n_chars)).otherwise(F.length("new")).cast(dict(docs.dtypes)[n_chars])
    fresh = {text: F.col("new"), n_chars: count}
    return rows.select(*[fresh.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
