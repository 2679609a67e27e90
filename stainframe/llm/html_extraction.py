"""Main text of web pages: lines that pages next to each other by URL share go, and markup decides about those left."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.functions.ordering import rank_within
from stainframe.llm.common import as_text, written
from stainframe.llm.url_filter import canonical

#: Markup: comments, declarations, tags with quoted attributes, tags whose quotes do not close, a tag cut off at the end.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][\w:-]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose content is not text, or whose text is not the page's.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video head title select textarea".split())
#: Of these the content is taken as it stands, up to the end tag.
RAW = frozenset("script style noscript iframe textarea title template".split())
#: Elements around the text: menus, headers, footers, sidebars, forms.
OUTER = frozenset("nav header footer aside form button menu dialog fieldset label input".split())
#: Words of class, id or role that mark the same.
MARKS = frozenset(("ad adbox ads adsense adslot advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment "
                   "commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header "
                   "login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall poll popup promo promoted "
                   "promotion recommended related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored "
                   "subscribe subscription survey teaser toolbar topbar topnav widget").split())
#: Those that an article element may have when it is a reader's comment or a pointer to another page.
MINOR = frozenset("ad ads advert comment promo promoted recommended related reply sponsored teaser widget".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph or list item.
ENDS_P = BLOCKS - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption", "legend", "dt", "dd", "li"} | {"li", "dt", "dd", "table"}
#: Where a line stands: inside an element whose words mark it (a layout may still hold the article), around the text, in the
#: page outside of an article, in its main part, in an article.
MARKED, AROUND, PLAIN, MAIN, ARTICLE = -1, 0, 1, 2, 3
#: Bits of the columns that a differencing holds at one time, and pages of a group.
TABLE, RUN = 1 << 27, 256


def marked(attributes: str, words: frozenset[str] = MARKS) -> bool:
    if "=" not in attributes:
        return False
    return any(w in words for _, v in ATTRIBUTE.findall(attributes) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))


def place_of(name: str, attributes: str, now: int) -> int:
    """Where the text of an element stands, inside one that stands at `now`.

    An article or main element counts inside a marked layout too, but not if it is marked as a comment or the like itself,
    and not inside an article. Inside an article a header is a part of it.
    """
    if name in ("article", "main"):
        if marked(attributes, MINOR):
            return AROUND
        own = ARTICLE if name == "article" else MAIN
        return now if now == AROUND else max(now, own)
    if now in (MARKED, AROUND):
        return AROUND if name in SILENT or name in OUTER else now
    if name in SILENT or (name in OUTER and not (name == "header" and now >= MAIN)):
        return AROUND
    if name not in ("html", "body") and marked(attributes, MARKS if now == PLAIN else MARKS - {"header"}):
        return MARKED if now == PLAIN else AROUND
    return now


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of the blocks of a page with text, in order.

    Character references are decoded, white space inside a block is one space, a block ends where a block element
    begins or ends. End tags close what is open above them, and missing ones are made up for; the text of
    a page that breaks off is what came before.
    """
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, int]] = []  # element and the place of its text
    held: Counter[str] = Counter()  # how many of each element are open
    text: list[str] = []
    place, at, page = PLAIN, 0, page or ""

    def block():
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                out.append((words, max(place, AROUND)))

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or (m[5] and not m[0].endswith(">")):
            continue
        if m[1] or m[4]:
            if held[name]:
                if name in BLOCKS:
                    block()
                while (last := open_.pop()[0]) != name:
                    held[last] -= 1
                held[name] -= 1
                if name in BLOCKS or name in SILENT:
                    place = open_[-1][1] if open_ else PLAIN
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in ("br", "td", "th"):
            text.append(" ")
        if name in BLOCKS:
            block()
        # A paragraph or item left open ends here, with what is open inside it.
        if name in ENDS_P:
            for own in ("p", name) if name in ("li", "dt", "dd") else ("p",):
                for k in range(len(open_) - 1, -1, -1) if held[own] else ():
                    if open_[k][0] == own:
                        held.subtract(n for n, _ in open_[k:])
                        del open_[k:]
                        break
                    if open_[k][0] in BLOCKS:
                        break
            place = open_[-1][1] if open_ else PLAIN
        if name in VOID:
            continue
        now = open_[-1][1] if open_ else PLAIN
        now = place_of(name, m[3] or m[6] or "", now)
        if now != place:
            block()
        open_.append((name, now))
        held[name] += 1
        place = now
    block()
    return out


def _columns(a: list[str], where: dict[str, int], width: int) -> Iterator[int]:
    """After each line of `a`: a number whose bit j is zero where the common subsequence grows with line j of the other page."""
    all_, v = (1 << width) - 1, (1 << width) - 1
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & all_
        yield v


def _where(b: list[str]) -> dict[str, int]:
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    out = {}
    for line, at in places.items():
        bits = np.zeros(at[-1] // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, np.array(at) // 8, np.left_shift(1, np.array(at) % 8).astype(np.uint8))
        out[line] = int.from_bytes(bits.tobytes(), "little")
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of `a` and the first j lines of `b`, for each j."""
    v = (1 << len(b)) - 1
    for v in _columns(a, _where(b), len(b)):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of `a` on a longest common subsequence with `b`.

    Equal ends are taken at once. Between them one column of the table is one number and a line of `a` takes a few operations
    on it, 64 lines of `b` to a machine word; pages whose columns would take over `TABLE` bits are halved first, at the place
    where the lengths of both halves add up to the most, so memory stays bounded.
    """
    n, low = min(len(a), len(b)), 0
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    common = {*a[low:len(a) - high]} & {*b[low:len(b) - high]}
    left = [i for i in range(low, len(a) - high) if a[i] in common]
    own, other = [a[i] for i in left], [x for x in b[low:len(b) - high] if x in common]
    todo = [(0, len(own), 0, len(other))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        if (k - i) * (m - j) > TABLE and k - i > 1:
            half = (i + k) // 2
            total = _lengths(own[i:half], other[j:m]) + _lengths(own[half:k][::-1], other[j:m][::-1])[::-1]
            at = j + int(np.argmax(total))
            todo += [(i, half, j, at), (half, k, at, m)]
            continue
        table = list(_columns(own[i:k], _where(other[j:m]), m - j))
        row, column = k - i, m - j
        while row and column:
            if table[row - 1] >> (column - 1) & 1:
                column -= 1
                continue
            row -= 1
            if not row or table[row - 1] >> (column - 1) & 1:
                out.add(left[i + row])
                column -= 1
    return out


def deleted(own: list, neighbours: list[list], least: int | None = None) -> set[int]:
    """Positions of `own` on a longest common subsequence with a neighbour, or with two where there are three or more: one may be a copy."""
    hits = Counter(i for other in neighbours for i in shared(own, other))
    return {i for i, n in hits.items() if n >= (least or (1 if len(neighbours) < 3 else 2))}


def left_over(own: list[tuple[str, int]], gone: set[int]) -> list[str]:
    """The lines that stay of a page of which differencing deletes `gone`.

    A deleted line stays if it stands in an article or main part, whose text two URLs may both carry whole. Of what is left, markup
    decides: with an article (or else a main part) its lines stay; without one, the plain lines. If neighbours share
    all of those (a copy of the page), they all stay.
    """
    top = max(max((p for _, p in own), default=AROUND), PLAIN)
    kept = [t for i, (t, p) in enumerate(own) if p == top and (p >= MAIN or i not in gone)]
    return kept or [t for t, p in own if p == top]


def main_lines(own: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> list[str]:
    """The lines that stay of a page beside its neighbours: differencing first, then markup."""
    return left_over(own, deleted([t for t, _ in own], [[t for t, _ in other] for other in neighbours]))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", near: int = 2) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of `pages`.

    Pages are ranked by host, path, url, id and html over the whole table, and each is set against the `near` pages before and after
    it that are of its host. Ranks are dealt in runs of `RUN` to groups that also hold the pages bordering on them, so a host with a
    third of all pages is many groups, and the text of a page does not depend on how the table is partitioned.

    Only hashes of lines (64 bits each, taken as the lines) travel to the groups; what differencing deletes comes back as
    positions to the lines of the page, which is read a second time for that. Null html is empty and has no text; a null
    URL has an empty host; repeated rows stay; an empty table gives no rows; other columns are not looked at. A very long page is its lines
    like any other.
    """
    kinds = dict(pages.dtypes)
    key = F.xxhash64("page_id", "url", F.length("html"), F.col("html"))
    rows = pages.select(as_text(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).withColumn("key", key)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in lines(h)], "<u8").tobytes() for h in batch["html"]]
            yield batch.drop(columns="html").assign(hashes=own)

    held = written(rows.select("page_id", "url", "key", "html").mapInPandas(hashed, "page_id string, url string, key bigint, hashes binary")
                   .withColumn("row", F.monotonically_increasing_id()), "lines")
    # Rows alike in all that is ordered by are alike in their lines, so either may come first.
    order = [F.col(c) for c in ("host", "path", "url", "page_id", "key", "row")]
    places = rank_within(canonical(held.select("url", "page_id", "key", "row"), "url"), [], order, rank="place", size="total").select("row", "place", "host")
    run = F.floor(F.col("place") / RUN)
    spread = held.select("row", "key", "hashes").join(places, "row").withColumn("run", F.explode(F.array_distinct(F.array(
        run, F.floor((F.col("place") - near) / RUN), F.floor((F.col("place") + near) / RUN)))))

    def differenced(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        inside, hosts, done = (group["place"] // RUN == group["run"]).tolist(), group["host"].tolist(), []
        own = [np.frombuffer(h, "<u8").tolist() for h in group["hashes"]]
        for i, (mine, k) in enumerate(zip(inside, group["key"].tolist())):
            if mine:
                beside = [own[j] for j in range(max(0, i - near), min(len(group), i + near + 1)) if j != i and hosts[j] == hosts[i]]
                if gone := deleted(own[i], beside):
                    done.append((k, sorted(gone)))
        return pd.DataFrame(done, columns=["key", "gone"])

    found = spread.select("run", "place", "key", "host", "hashes").groupBy("run").applyInPandas(differenced, "key bigint, gone array<int>")
    # Equal rows may have unequal neighbours; what any of them loses all lose, so that they stay equal.
    found = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = ["\n".join(f"{max(p, AROUND)}{t}" for t, p in lines(h)).encode("utf-8", "surrogatepass") for h in batch["html"]]
            yield batch.drop(columns="html").assign(body=[press.compress(b) for b in body])

    @F.pandas_udf("string")
    def kept(bodies: pd.Series, gone: pd.Series) -> pd.Series:
        release, out = zstandard.ZstdDecompressor(), []
        for body, g in zip(bodies, gone):
            text = release.decompress(body).decode("utf-8", "surrogatepass")
            own = [(t[1:], int(t[0])) for t in text.split("\n")] if text else []
            out.append("\n".join(left_over(own, set() if g is None else set(g))))
        return pd.Series(out, dtype=object)

    bodies = rows.select("page_id", "url", "key", "html").mapInPandas(parsed, "page_id string, url string, key bigint, body binary")
    return (bodies.join(found, "key", "left").select(F.col("page_id").cast(kinds[page_id]), "url", kept("body", "gone").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


#: DuckDB twin over `pages`, for the markup that the given tables have: an article of headings and paragraphs.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(
  x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
