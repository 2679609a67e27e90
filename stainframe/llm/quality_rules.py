"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainframe.llm.common import BLANK, words, written

#: Words in a window; a window found again in the same text is a repeat.
WINDOW = 5


def text_counts(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row for each row of `docs`.

    All in array functions of the row itself, without a shuffle. Windows are compared by the 64-bit hash of their
    words. Only texts that hold a window twice sort theirs; equal neighbours in that order mark positions, and
    the gaps between marked positions, at most a window each, add up to the words covered.
    """
    at = F.col
    start = docs.select(at(doc_id).alias("doc_id"), at(host).cast("string").alias("host"),
                        F.coalesce(at(text), F.lit("")).alias("t"))
    split = start.withColumn("w", words(at("t")))
    lines = F.filter(F.split(at("t"), "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    hashed = split.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("w") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("w") - WINDOW),
            lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("h"))
    ordered = hashed.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn(
        "s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(
            F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("lines", "h")
    marked = ordered.withColumn("p", F.array_sort(F.transform(
        F.filter("s", lambda x, i: (x.h == F.get("s", i - 1).h) | (x.h == F.get("s", i + 1).h)), lambda x: x.p))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))),
                          F.lit(0), lambda a, x: a + x)
    return marked.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The document's own rules: fewer than 10 words, or over 20 % of them in repeated windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failures, host_rate) from rows with `host` and `base_failed`; a null host is a host too.

    The rate of a host is (failures + a) / (n + a + b). The prior's mean a / (a + b) is the overall rate and its
    strength a + b comes from the spread of the hosts' rates beyond what chance gives (moments), within
    1 and 1,000,000; hosts that differ by chance alone, or a single host, take the strongest.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failures"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("k"),
                      F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
                      F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("n")).alias("f2"))
    mean, chance = F.expr("f / n"), F.expr("f / n * (1 - f / n)")
    # Between-host variance: the weighted squares about the mean, less what binomial draws give.
    spread = (F.col("f2") - F.col("n") * mean * mean - (F.col("k") - 1) * chance) / (F.col("n") - F.col("n2") / F.col("n"))
    strength = F.when((F.col("k") > 1) & (spread > 0), F.least(F.lit(1e6), F.greatest(F.lit(1.0), chance / spread - 1))).otherwise(1e6)
    prior = total.where("n > 0").select(F.struct(mean.alias("mean"), strength.alias("strength")).alias("prior"))
    return (hosts.withColumn("prior", prior.scalar())
            .select("host", "n", "failures", ((F.col("failures") + F.expr("prior.mean * prior.strength")) / (F.col("n") + F.col("prior.strength"))).alias("host_rate")))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """One row for each row of `docs`: its counts, `base_failed`, the shrunk `host_rate` and `kept`.

    A document is kept if it passes its own rules and its host's shrunk failure rate is at most `max_host_rate`.
    Null text has no words and fails; null hosts form one host; repeated rows stay; an empty table gives no rows;
    other columns of `docs` are not looked at. Counts are written once, as verdicts need them twice. A host with
    most rows is summed in parts, and in the join back only its one verdict is copied.
    """
    rows = text_counts(docs, doc_id, text, host).withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = written(rows, "rules")
    rates = host_rates(rows).select(F.col("host").alias("_host"), "host_rate")
    return (rows.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
            .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)))


#: DuckDB twin of `judge` over `documents`, with host_rate to six digits.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(5) AS o(k) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT r, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(ln.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN ln USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY host),
m AS (SELECT sum(n)::DOUBLE AS n, sum(f)::DOUBLE / sum(n) AS p, count(*) AS k, sum(n::DOUBLE * n) AS n2, sum(f::DOUBLE * f / n) AS f2 FROM h),
v AS (SELECT p, k, p * (1 - p) AS q, (f2 - n * p * p - (k - 1) * p * (1 - p)) / nullif(n - n2 / n, 0) AS s FROM m),
pr AS (SELECT p, CASE WHEN k > 1 AND s > 0 THEN least(1e6, greatest(1.0, q / s - 1)) ELSE 1e6 END AS z FROM v),
hr AS (SELECT host, (f + p * z) / (n + z) AS rate FROM h, pr)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept, b.host, round(rate, 6) AS host_rate
FROM b JOIN hr ON b.host IS NOT DISTINCT FROM hr.host
"""
