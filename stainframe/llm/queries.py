"""The registered queries of this folder, on the whole given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stainframe.llm import (html_extraction, negatives, packing, passages, pieces, quality_classifier, quality_rules, secrets, simhash, topk, toxicity,
                            url_filter, whitening)
from stainframe.llm.common import held_out

#: The score from which a document counts as label 1.
CUT = 0.7


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _scored(rows: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                       (F.col("score") >= CUT).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"), modulus=3, remainder=1)
    return _scored(toxicity.with_score(docs.select("doc_id", "text"), model), 3, 1)


def op2_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host",
        F.round("host_rate", 6).alias("host_rate"))


def op3_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(_table(spark, folder, "pages"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality_classifier.train(docs, _table(spark, folder, "labels"), modulus=4, remainder=2)
    return _scored(quality_classifier.with_score(docs.select("doc_id", "text"), model), 4, 2)


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(_table(spark, folder, "documents"), model)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(_table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_filter.RULES), "rule string, verdict string")
    return url_filter.judge(_table(spark, folder, "pages"), rules, keep=("page_id",))


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, folder, "documents")))


def op11_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.without_repeats(_table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, folder, "embeddings").withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_host_rules, op3_page_text, op4_quality, op5_pieces, op6_simhash, op7_packing,
                            op8_url_filter, op9_top_k, op10_secrets, op11_repeated_passages,
                            op12_whitening, op13_hard_negatives)}

ORACLE: dict[str, str] = {"op2_host_rules": quality_rules.SQL, "op3_page_text": html_extraction.SQL, "op8_url_filter": url_filter.SQL, "op9_top_k": topk.SQL,
                          "op13_hard_negatives": negatives.SQL}
