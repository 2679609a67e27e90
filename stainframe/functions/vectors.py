"""Arithmetic on embedding arrays, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, e: a + e)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l2_normalise(v: Column, floor: float = 1e-8) -> Column:
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / length)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, evaluated once per row however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(sims: Sequence[Column], temperature: float = 1.0) -> Column:
    """The softmax of several similarities, as an array in their order."""
    def shares(parts: Column) -> Column:
        return _let(total(parts), lambda whole: F.transform(parts, lambda p: p / whole))

    def parts(s: Column) -> Column:
        return _let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp((x - top) / F.lit(temperature))))

    return _let(F.array(*sims), lambda s: _let(parts(s), shares))
