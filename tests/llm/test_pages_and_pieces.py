"""Page text on small pages, and piece encoding against a plain Viterbi."""

import random

import public_tokenizers
import pytest

from stainframe.llm import html_extraction as pages
from stainframe.llm import pieces
from tests.llm.helpers import SCHEMA, documents

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1>
<p><b>One  two<br>three <p>Four&nbsp;five &copy <!-- no --><script>x</script>six</p><aside>side</aside><ul><li>i<li>j</ul>
<div class="comments"><p>Nice!</p></div><form><input value="q"><p>f</p></form></article><footer>foot</footer></body></html>"""


def text(page, *others):
    return pages.main_lines(pages.lines(page), [pages.lines(o) for o in others])


def test_article():
    want = ["Head & more", "One two three", "Four five © six", "i", "j"]
    assert text(PAGE) == want
    assert text(PAGE, PAGE) == want  # a copy at the next URL does not empty it
    assert text(PAGE[:PAGE.index("<ul><li>i")] + "<p>cut &am") == want[:3] + ["cut &am"]


def test_difference_without_article():
    frame = "<body><div class='top'><p>Site name</p></div><div><p>{}</p><p>{}</p></div><p>All rights</p></body>"
    assert text(frame.format("a", "b"), frame.format("c", "d")) == ["a", "b"]
    assert text(frame.format("a", "b"), frame.format("a", "d")) == ["b"]
    assert text(frame.format("a", "b")) == ["Site name", "a", "b", "All rights"]
    assert text(frame.format("a", "b"), frame.format("a", "b")) == ["Site name", "a", "b", "All rights"]


def test_places():
    assert text("<div class='layout with-sidebar'><article><header><h1>T</h1></header><p>a</p></article><div class=sideNav>n</div></div>") == ["T", "a"]
    assert text("<main><div class=breadcrumbs>x</div><p>lead</p><article><div class='article-header'><h2>T</h2></div><p>a</p></article></main>") == ["T", "a"]
    assert text("<article><p>a</p></article><section class=comments><article class='comment odd'><p>c</p></article></section>") == ["a"]
    assert text("<article><p>a</p><section id='userComments'><article><p>c</p></article></section><footer>f</footer></article>") == ["a"]
    assert text("<aside><article><p>a</p></article></aside><main><p>b</p><div class='ad box'>x</div></main>") == ["b"]
    assert text("<p>a</p><div class=shadow>b</div><div class='cookie-notice'>c</div>") == ["a", "b"]


def test_odd_markup():
    assert text(None) == text("") == text("<p>") == text("<nav>x</nav>") == []
    assert text("plain < text & more") == ["plain < text & more"]
    assert text("a<p class=x>b</div>c</p><a href='>'>d</a>") == ["a", "bc", "d"]
    assert text("<table><tr><td>1</td><td>2</td></tr></table>x<hr>y<p") == ["1 2", "x", "y"]
    assert text("<p>x</p>" * 30_000 + "<p>y</p>")[-1] == "y"


def test_longest_common_subsequence():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        own = sorted(pages.shared(a, b))
        assert len(own) == length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in own)


def test_extract(spark):
    frame = "<p>Shop</p><p>{}</p><p>Imprint</p>"
    rows = [(i, f"http://h{i % 2}/a/{i:03}", frame.format(f"text {i}")) for i in range(40)] + [(50, None, None), (51, "", ""), (52, "http://x/", PAGE), (52, "http://x/", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS host", "1 AS text", "2 AS path")
    got = {}
    for r in pages.extract(df.coalesce(1)).collect():
        got.setdefault(r["page_id"], []).append((r["url"], r["text"], r["n_chars"]))
    assert sum(map(len, got.values())) == len(rows)
    assert got[50] == [(None, "", 0)] and got[51] == [("", "", 0)] and got[52][0] == got[52][1] and got[52][0][1].startswith("Head & more\nOne two three\nFour")
    # A page with a neighbour of its host in the same task loses the frame.
    assert sum(got[i][0][1] == f"text {i}" for i in range(40)) >= 30
    assert pages.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_text_does_not_depend_on_partitions(spark):
    frame = "<div><p>Shop</p><p>Menu</p></div><p>{}</p><p>{}</p><p>Imprint</p>"
    rows = [(i, f"http://h/a/{i:03}", frame.format(f"text {i}", f"more {i % 7}")) for i in range(600)]
    rows += [(700 + i, "http://h/a/300x", frame.format("text 300", "more 6")) for i in range(2)]  # copies at the next URL
    seen = []
    for n in (2, 12, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(n)
        seen.append(sorted(tuple(r) for r in pages.extract(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] == seen[2]
    by = {r[0]: r[2] for r in seen[0]}
    assert all(by[i] == f"text {i}\nmore {i % 7}" for i in range(600) if abs(i - 300) > 3)


def test_long_pages():
    same = [f"line {i % 3}" for i in range(4000)]
    assert len(pages.shared(same, same[1:] + ["x"])) == 3999
    r = random.Random(3)
    a, b = ([str(r.randrange(50)) for _ in range(n)] for n in (900, 700))
    whole = pages.shared(a, b)
    table, pages.TABLE = pages.TABLE, 2000
    try:
        halved = pages.shared(a, b)
    finally:
        pages.TABLE = table
    it = iter(b)
    assert len(whole) == len(halved) and all(a[i] in it for i in sorted(halved))
    deep = "<b>" * 20_000 + "x" + "</i>" * 20_000 + "<p>y" + "</b>" * 20_000 + "<p>z"
    assert text(deep) == ["x", "y", "z"]
    assert len(text("".join(f"<p>line {i % 5}</p>" for i in range(60_000)), "".join(f"<p>line {i % 4}</p>" for i in range(60_000)))) > 0


@pytest.fixture(scope="module")
def model():
    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def slow(model, text):
    """Plain Viterbi over the whole text, character by character."""
    if not text:
        return []
    usable = {model.pieces[i]: i for i in model.value[model.value >= 0].tolist()}
    x = (" " + text).replace(" ", pieces.MARK)
    best, by = [0], [None]
    for end in range(1, len(x) + 1):
        options = []
        for start in range(max(0, end - 16), end):
            if (i := usable.get(x[start:end])) is not None:
                options.append((-(best[start] + int(model.score[i])), start, [i]))
            elif end - start == 1:
                options.append((-(best[start] + int(model.score.min()) - pieces.PENALTY), start, [int(model.byte[b]) for b in x[start].encode()]))
        cost, start, ids = min(options)
        best.append(-cost)
        by.append((start, ids))
    out, end = [], len(x)
    while end:
        end, ids = by[end]
        out = ids + out
    return out


def texts():
    r = random.Random(1)
    some = ["", " ", "  ", "\n", " \n a", "▁x", "a  b   c", "the international house\n\nof wind", "中文 😀🦄 é", "x" * 3000]
    return some + ["".join(r.choice("abcdefgh  \n\tétheü中😀▁.,01 in on") for _ in range(r.randrange(40))) for _ in range(400)]


def test_viterbi(model):
    encode, decode = pieces.Encoder(model), pieces.Decoder(model)
    for t, ids in zip(texts(), encode(texts())):
        assert ids.tolist() == slow(model, t), t
        assert decode(ids.tolist()) == t.replace(pieces.MARK, " ")
    assert [encode([t])[0].tolist() for t in texts()[:50]] == [i.tolist() for i in encode(texts()[:50])]


def test_double_array():
    r = random.Random(3)
    keys = sorted({bytes(r.choice(b"abc\xff\x00") for _ in range(r.randrange(1, 6))) for _ in range(400)})
    base, check, value = pieces.double_array(keys, list(range(len(keys))))

    def find(key):
        s = 0
        for c in key:
            t = base[s] + c
            if base[s] <= 0 or check[t] != s:
                return -1
            s = t
        return value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + bytes([b])) == (keys.index(k + bytes([b])) if k + bytes([b]) in keys else -1) for k in keys for b in (0, 97, 120, 255))


def test_encode_and_decode_in_spark(spark, model):
    own = [*texts()[:60], None, "word " * 30_000]
    df = documents(spark, own, extra=True)
    rows = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df, model, bytes_at_once=1000), model).collect()}
    for i, t in enumerate(own):
        assert rows[i]["n_ids"] == len(rows[i]["ids"]) and rows[i]["restored"] == (pieces.MARK not in (t or "")) and rows[i]["text"] == (t or "").replace(pieces.MARK, " ")
    assert pieces.encode(spark.createDataFrame([], SCHEMA), model).count() == 0
