"""The corpus pipeline: five operators one after another over `documents`, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stainframe.llm import packing, quality_classifier, secrets, simhash, toxicity
from stainframe.llm.common import written

#: Documents at this toxicity or more go; so do those under this quality.
CUT = 0.7


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _kept(docs: DataFrame, scored: Callable[[DataFrame, str], DataFrame], keep: Callable[[Column], Column]) -> DataFrame:
    """The rows of `docs` whose score is to keep, as they are; the score's column takes a name that none of theirs has."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return scored(docs, name).where(keep(F.col(name))).drop(name)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.7 or more go."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return _kept(docs, lambda df, name: toxicity.with_score(df, model, name=name), lambda score: score < CUT)


def poor_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is under 0.7 go."""
    model = quality_classifier.train(docs, _labels(spark, sf_dir))
    return _kept(docs, lambda df, name: quality_classifier.with_score(df, model, name=name), lambda score: score >= CUT)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8) stays: the one with the smallest id."""
    return simhash.near_representatives(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret found in a text gives way to a mark."""
    return secrets.masked(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces placed in sequences of 1024 ids."""
    return packing.packed(docs)


STAGES = [("toxicity", toxic_documents), ("quality classifier", poor_documents), ("simhash near-dedup", near_copies),
          ("secret scans", masked_secrets), ("best-fit packing", packed_documents)]

#: Trained scores, SimHash links and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
