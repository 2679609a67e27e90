"""Beer-Lambert stain separation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainframe.constants import CALIBRATED, VECTOR_SETS

Vectors = Sequence[Sequence[float]]
CALIBRATED_ROWS: Vectors = tuple(CALIBRATED.values())


def inverse(vectors: Vectors = CALIBRATED_ROWS) -> np.ndarray:
    """Inverse of the row-normalised 3 x 3 stain matrix; a zero row stays as it is."""
    rows = np.asarray(vectors, dtype=float)
    length = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.linalg.inv(rows / np.where(length == 0, 1.0, length))


def density(channel: str, log10: bool = False) -> Column:
    """Optical density of one 8-bit channel, zero read as one."""
    share = F.greatest(F.lit(1), F.least(F.lit(255), F.col(channel))) / F.lit(255.0)
    return -F.log10(share) if log10 else -F.log(share)


def stains(vectors: Vectors = CALIBRATED_ROWS) -> list[Column]:
    """Hematoxylin, DAB and residual amounts of the `r`, `g`, `b` columns, floored at zero."""
    inv = inverse(vectors)
    od = [density(c) for c in "rgb"]
    return [
        F.greatest(F.lit(0.0), sum((od[i] * float(inv[i, k]) for i in range(1, 3)), od[0] * float(inv[0, k])))
        for k in range(3)
    ]


def stains_log10(vectors: Vectors = CALIBRATED_ROWS) -> list[Column]:
    """The base-10 form with the matrix on the other side; for comparison only, it loses brown."""
    inv = inverse(vectors)
    od = [-F.log10(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col(c) / F.lit(255.0)))) for c in "rgb"]
    return [
        sum((od[i] * float(inv[k, i]) for i in range(1, 3)), od[0] * float(inv[k, 0])) for k in range(3)
    ]


def deconvolve(pixels: DataFrame, vectors: Vectors = CALIBRATED_ROWS) -> DataFrame:
    h, d, r = stains(vectors)
    return pixels.withColumns({"hematoxylin": h, "dab": d, "residual": r})


def with_dab(pixels: DataFrame, vectors: Vectors = CALIBRATED_ROWS) -> DataFrame:
    return pixels.withColumn("dab", stains(vectors)[1])


def deconvolve_log10(pixels: DataFrame, vectors: Vectors = CALIBRATED_ROWS) -> DataFrame:
    h, d, r = stains_log10(vectors)
    return pixels.withColumns({"hematoxylin": h, "dab": d, "residual": r})


def deconvolve_multi(pixels: DataFrame, sets: dict[str, Vectors] = VECTOR_SETS) -> DataFrame:
    """One row per pixel and vector set, without a join: the sets are an array of expressions."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), stains(v)[1].alias("dab")) for n, v in sets.items()])
    return (pixels.withColumn("_s", F.explode(each))
            .withColumns({"vector_set": F.col("_s.name"), "dab": F.col("_s.dab")}).drop("_s"))


def dab_votes(pixels: DataFrame, limit: float, sets: dict[str, Vectors] = VECTOR_SETS) -> DataFrame:
    """`votes` = share of the vector sets whose DAB is above `limit`, as one expression of the pixel's own row."""
    each = [(stains(v)[1] > limit).cast("int") for v in sets.values()]
    return pixels.withColumn("votes", sum(each[1:], each[0]) / float(len(each)))


def stain_matrix(vectors: DataFrame) -> DataFrame:
    """Inverse matrices of a table of vectors `h1..h3, d1..d3, r1..r3`, as columns `i11..i33`."""
    cols: dict[str, Column] = {}
    for s in "hdr":
        norm = F.sqrt(sum((F.col(f"{s}{i}") ** 2 for i in (2, 3)), F.col(f"{s}1") ** 2))
        norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
        for i in (1, 2, 3):
            cols[f"n_{s}{i}"] = F.col(f"{s}{i}") / norm
    unit = vectors.withColumns(cols)
    m = [[F.col(f"n_{s}{i}") for i in (1, 2, 3)] for s in "hdr"]

    def cofactor(i: int, j: int) -> Column:
        a, b = (i + 1) % 3, (i + 2) % 3
        c, d = (j + 1) % 3, (j + 2) % 3
        return m[a][c] * m[b][d] - m[a][d] * m[b][c]

    unit = unit.withColumn("_det", m[0][0] * cofactor(0, 0) + m[0][1] * cofactor(0, 1) + m[0][2] * cofactor(0, 2))
    return unit.withColumns({
        f"i{i + 1}{j + 1}": F.try_divide(cofactor(j, i), F.col("_det")) for i in range(3) for j in range(3)
    }).drop("_det", *cols)
