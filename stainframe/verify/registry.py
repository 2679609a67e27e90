"""Pairs each query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stainframe.verify.views import NUDGE, Tables, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers `fn(tables) -> DataFrame` under `key`, with its SQL twin if there is one."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLE[key] = duck_sql(sql)
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the two engines' last bits do not matter."""
    return df.select(*[
        F.round(F.col(f.name) + NUDGE, digits).alias(f.name) if f.dataType.typeName() == "double"
        else F.col(f.name) for f in df.schema.fields])
