"""Grades and scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stainframe.constants import (
    CIRCUMFERENTIAL, COMPOSITE_CUTS, ELIGIBLE_PCT, GRADE_CUTS, POSITIVE_GRADE, THICK_PX,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities read as missing."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def grade_dab(c: str | Column, cuts: Sequence[float | Column] = GRADE_CUTS) -> Column:
    """0..3 by intensity; a missing value is graded 0."""
    c = _col(c)
    low, mid, high = cuts
    return (F.when(c.isNull() | (c < low), 0).when(c < mid, 1).when(c < high, 2).otherwise(3))


def grade_label(grade: str | Column) -> Column:
    g = _col(grade)
    return F.when(g == 0, "Negative").when(g == 1, "1+").when(g == 2, "2+").otherwise("3+")


def grade_composite(thickness: str | Column, completeness: str | Column, dab: str | Column) -> Column:
    """Grade from membrane thickness, completeness and intensity together."""
    t, c, d = _col(thickness), _col(completeness), _col(dab)
    negative, weak, strong = COMPOSITE_CUTS
    around, intense = c >= CIRCUMFERENTIAL, d >= strong
    return (F.when(t.isNull() | c.isNull() | d.isNull() | (d < negative), 0)
            .when(d < weak, 1)
            .when((t >= THICK_PX) | (around & intense), 3)
            .when(around | intense, 2)
            .otherwise(1))


def grade_bar_completeness(bar_mean: str | Column, completeness: str | Column) -> Column:
    return grade_dab(_col(bar_mean) * _col(completeness))


def h_score(grade: str | Column) -> Column:
    """Aggregate: 0..300, zero for no cells."""
    return F.coalesce(F.lit(100.0) * F.avg(_col(grade)), F.lit(0.0))


def pct_at_least(grade: str | Column, least: int = POSITIVE_GRADE) -> Column:
    """Aggregate: percent of cells graded `least` or more, zero for no cells."""
    return F.coalesce(F.lit(100.0) * F.avg((_col(grade) >= least).cast("int")), F.lit(0.0))


def eligible(pct_positive: str | Column) -> Column:
    return _col(pct_positive) >= ELIGIBLE_PCT


def grade_counts(grade: str | Column) -> list[Column]:
    """Aggregates: cells per grade, zero-filled."""
    g = _col(grade)
    names = ("negative", "weak_1plus", "moderate_2plus", "strong_3plus")
    return [F.count_if(g == i).alias(n) for i, n in enumerate(names)]


def share(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """part / whole, `otherwise` where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(otherwise))
