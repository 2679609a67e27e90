"""URL rules behind a blocked Bloom filter: possible hits go on to an exact hash join, which decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a block: eight 64-bit words, one cache line; a key sets one bit in each word.
WORDS = 8
#: Odd multipliers below 2**31, one for each word of a block; a product with 32 bits stays within a signed long.
SALT = np.array([(2 * k + 1) * 0x9E3779B1 % 2**31 | 1 for k in range(WORDS)], np.uint64)


def canonical(urls: DataFrame, url: str) -> DataFrame:
    """`urls` with `host` (A-Z lower-cased) and `path`; both are empty for a null or one without `://`."""
    return (urls.withColumn("_rest", F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(""))
            .withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def rule_table(rules: DataFrame) -> DataFrame:
    """(key, verdict) of rules (rule, verdict) like `org/`: host, then a path from its first slash on. A rule listed
    twice blocks if one of its rows does; nulls are no rules."""
    return (rules.select(F.col("rule").alias("key"), "verdict").where("key is not null and verdict is not null")
            .groupBy("key").agg(F.max("verdict").alias("verdict")))


def filter_bits(table: DataFrame, max_blocks: int) -> np.ndarray:
    """The filter as (blocks, 8) words, about 16 bits a key but at most `max_blocks` blocks of 64 bytes.

    Spark sets the bits, grouped by block and word, so what reaches the driver is the filter and not the list. At
    the limit the filter fills up and passes more keys, which the join then removes: results stay the same.
    """
    n = table.count()
    blocks = 1 << int(min(max_blocks, max(1, n * 16 // 512))).bit_length() - 1
    hashed = table.select(F.xxhash64("key").alias("h"))
    words = hashed.select(F.shiftrightunsigned("h", 32).alias("hi"), F.col("h").bitwiseAND(0xFFFFFFFF).alias("lo")).select(
        (F.col("hi") % blocks).alias("block"), F.posexplode(F.array(*[
            F.shiftrightunsigned((F.col("lo") * int(s)).bitwiseAND(0xFFFFFFFF), 26) for s in SALT]))).select(
        "block", F.col("pos").alias("word"), F.expr("shiftleft(1L, int(col))").alias("bit"))
    out = np.zeros((blocks, WORDS), np.uint64)
    for row in words.groupBy("block", "word").agg(F.bit_or("bit").alias("bits")).toArrow().to_pylist():
        out[row["block"], row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def maybe_listed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit key hashes may be in the filter; never wrong about those that are."""
    h = hashes.view(np.uint64)
    low = h & np.uint64(0xFFFFFFFF)
    bit = ((low[:, None] * SALT) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    block = bits[((h >> np.uint64(32)) % np.uint64(len(bits))).astype(np.int64)]
    return ((block >> bit) & np.uint64(1)).all(axis=1)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), max_blocks: int = 1 << 17, default: str = "allow") -> DataFrame:
    """(`keep` columns, host, path, rule, verdict), one row for each row of `urls`.

    `rules` has (rule, verdict), like `org/` with `allow`. A rule fits its host and all subdomains of it, if the
    path starts with the rule's path; of several the longest wins, and `default` holds where none fits. The keys
    looked up for a URL are its host's suffixes at dots with its path's prefixes, of only those lengths that listed paths
    have (one number for each distinct length). The filter is at most `max_blocks` * 64 bytes (8 MiB). Null or
    malformed URLs have an empty host and fit no rule; repeated rows stay; empty tables give no rows or the default;
    other columns of `urls` are not looked at.
    """
    spark = urls.sparkSession
    table = rule_table(rules)
    bits = spark.sparkContext.broadcast(filter_bits(table, max_blocks))
    paths = table.select(F.length(F.regexp_extract("key", r"^[^/]*(.*)$", 1)).alias("n")).distinct().agg(F.sort_array(F.collect_set("n"))).first()[0]

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            sizes = batch["keys"].map(len).to_numpy()
            flat = [k for keys in batch["keys"] for k in keys]
            hit = np.flatnonzero(maybe_listed(bits.value, np.array([xxhash.xxh64_intdigest(k.encode(), 42) for k in flat], np.uint64)))
            of = np.repeat(np.arange(len(batch)), sizes)[hit]
            # Typed as objects, since a batch without a hit would otherwise be a column of numbers.
            yield batch[["host", "path"]].iloc[of].assign(key=np.array([flat[i] for i in hit], object))

    rows = canonical(urls.select(*dict.fromkeys((*keep, url))), url)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.lit(paths).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    hits = (rows.where("host != ''").select("host", "path").distinct()
            .select("host", "path", keys.alias("keys")).mapInPandas(possible, "host string, path string, key string")
            .join(table, "key").groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
            .agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), F.struct(F.length("key"), "key")).alias("hit")))
    return (rows.join(hits, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
            .select(*keep, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))


#: The list of the registered query: fixed values.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: DuckDB twin over `pages`.
SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l(rule, verdict) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + r"""),
s AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS q FROM l),
m AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN s
      ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (r)
"""
