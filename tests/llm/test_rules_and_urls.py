"""Host rules and URL rules against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stainframe.llm import quality_rules, url_filter
from tests.llm.helpers import SCHEMA, documents

LINE = "one two three four five six seven eight nine ten eleven"
TEXTS = ["", None, "  \t\n ", "a b c", LINE, f"{LINE}\n{LINE}\n\n\n{LINE}", "x " * 300, "# | <b> é 中文 🦄 &amp; " * 3 + LINE, LINE.replace(" ", "\x0b"),
         " ".join(str(i) for i in range(3000)), " ".join(str(i % 1400) for i in range(3000)), LINE + " " + LINE[:23], LINE, LINE]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if where[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_counts_and_hosts(spark):
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(spark, TEXTS, extra=True).drop("host")).collect()}
    assert len(got) == len(TEXTS)
    hosts = {}
    for i, t in enumerate(TEXTS):
        n = counts(t)
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n, t
        assert got[i]["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        hosts.setdefault(got[i]["host"], []).append(got[i]["base_failed"])
    # Moments of the beta prior, by host.
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    p, k = f / n, len(hosts)
    spread = (sum(len(h) * (sum(h) / len(h) - p) ** 2 for h in hosts.values()) - (k - 1) * p * (1 - p)) / (n - sum(len(h) ** 2 for h in hosts.values()) / n)
    strength = min(1e6, max(1, p * (1 - p) / spread - 1)) if spread > 0 else 1e6
    for r in got.values():
        h = hosts[r["host"]]
        rate = (sum(h) + p * strength) / (len(h) + strength)
        assert r["host_rate"] == pytest.approx(rate)
        assert r["kept"] == (not r["base_failed"] and rate <= 0.5)


def test_bad_host_takes_its_good_documents_along(spark):
    rows = [(i, "short" if i < 90 else LINE, "en", "bad" if i < 100 else "good", 0) for i in range(100)]
    rows += [(100 + i, LINE, "en", "good" if i < 100 else None, 0) for i in range(200)]
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA))
    kept = {r["host"]: (r["n"], r["kept"]) for r in got.groupBy("host").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert kept == {"bad": (100, 0), "good": (100, 100), None: (100, 100)}


def test_no_rows(spark):
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


URLS = ["http://example.org/es/1", "http://A.EXAMPLE.ORG/es/", "https://example.org/en/12?x", "http://notexample.org/es/2", "http://x.com/fr/a", "x.com/de/", None, "",
        "://", "http://com/de/q#f", "http://com", "http://org", "http://org/", "http://u@com:80/de/", "ftp://x.com/de/b", "http://.com/de/", "http://x.com/de/b"] * 2


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in url_filter.RULES:
        h, q = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + q):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("blocks", [1, 1 << 17])
def test_urls(spark, blocks):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string").withColumn("host", F.lit("x")).withColumn("key", F.lit(1))
    rules = spark.createDataFrame([*url_filter.RULES, (None, "block"), ("y/", None)], "rule string, verdict string")
    got = url_filter.judge(pages, rules, keep=("page_id",), max_blocks=blocks).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == sorted(
        [(i, *expected(u)) for i, u in enumerate(URLS)])


def test_batches_without_a_hit(spark):
    pages = spark.createDataFrame([(i, f"http://nowhere.net/{i}") for i in range(50)], "page_id int, url string")
    rules = spark.createDataFrame(list(url_filter.RULES), "rule string, verdict string")
    got = url_filter.judge(pages, rules, keep=("page_id",)).collect()
    assert len(got) == 50 and all(r["rule"] is None and r["verdict"] == "allow" for r in got)


def test_urls_of_empty_tables(spark):
    none, rules = spark.createDataFrame([], "page_id int, url string"), spark.createDataFrame([], "rule string, verdict string")
    assert url_filter.judge(none, rules, keep=("page_id",)).count() == 0
    some = spark.createDataFrame([(1, "http://a/b")], "page_id int, url string")
    assert [r["verdict"] for r in url_filter.judge(some, rules, keep=("page_id",)).collect()] == ["allow"]
