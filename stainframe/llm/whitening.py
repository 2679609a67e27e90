"""Whitening of embeddings: centred covariance over distinct vectors, leading components, projection of every row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.llm.common import as_text, quantized, written

#: Eigenvalues nearer than this, relative to the norm, are a cluster; their vectors are made orthogonal to one another.
CLUSTER = 1e-3
#: Rows of a batch that are matrices at one time.
SLICE = 2048


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of the symmetric matrix `a`: each reflector clears a column below its neighbour."""
    a, n, reflectors = np.array(a, float), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        v = np.zeros_like(x)
        if np.linalg.norm(x[1:]) > 0:
            v = x / size
            v[0] += np.copysign(1.0, x[0])
            v /= np.linalg.norm(v)
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
            p = a[k + 1:, k + 1:] @ v
            w = 2 * (p - (v @ p) * v)
            a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of `x`: the signs of a Sturm sequence."""
    tiny = np.finfo(float).tiny ** 0.5
    count, pivot = np.zeros(len(x), np.int64), np.ones(len(x))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - x - (off[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The `most` largest eigenvalues, falling, by bisection on the counts, all at once."""
    n = len(diagonal)
    around = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    pad = 1e-15 * max(abs(low), abs(high)) + np.finfo(float).tiny
    wanted = np.arange(n - 1, n - 1 - most, -1)  # as many lie below
    low, high = np.full(most, low - pad), np.full(most, high + pad)
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        under = below(diagonal, off, middle) > wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """b -> (T - shift)^-1 b by elimination with row exchange; a pivot under `least` counts as `least`."""
    n = len(diagonal)
    steps, row = [], [diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0]
    for k in range(n - 1):
        below_ = [off[k], diagonal[k + 1] - shift, off[k + 1] if k + 2 < n else 0.0]
        swap = abs(below_[0]) > abs(row[0])
        if swap:
            row, below_ = below_, row
        if abs(row[0]) < least:
            row[0] = least
        m = below_[0] / row[0]
        steps.append((swap, m, *row))
        row = [below_[1] - m * row[1], below_[2] - m * row[2], 0.0]
    if abs(row[0]) < least:
        row[0] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for k, (swap, m, *_) in enumerate(steps):
            if swap:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= m * x[k]
        x[n - 1] /= row[0]
        for k in range(n - 2, -1, -1):
            _, _, a, b_, c = steps[k]
            x[k] = (x[k] - b_ * x[k + 1] - (c * x[k + 2] if k + 2 < n else 0.0)) / a
        return np.array(x)

    return solve


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of the tridiagonal matrix for its falling eigenvalues `values`, by inverse iteration."""
    n = len(diagonal)
    norm = float((np.abs(diagonal) + np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))).max()) or 1.0
    eps, draws = np.finfo(float).eps, np.random.default_rng(7)
    out, first, shift = np.zeros((n, len(values))), 0, np.inf
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # Equal values get shifts that differ, so that their iterations start apart.
        shift = min(value, shift - 2 * eps * norm) if j > first else value
        solve = _solver(diagonal, off, shift, eps * norm)
        z = draws.standard_normal(n)
        for _ in range(6):
            z = solve(z / np.linalg.norm(z))
            for _ in range(2):
                z = z - out[:, first:j] @ (out[:, first:j].T @ (z / np.linalg.norm(z))) * np.linalg.norm(z)
        out[:, j] = z / np.linalg.norm(z)
    return out


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of the `most` leading eigenvalues, falling."""
    scale = float(np.abs(covariance).max())
    if scale == 0:
        return np.zeros(most), np.eye(len(covariance))[:, :most]
    diagonal, off, reflectors = tridiagonal(covariance / scale)
    values = leading(diagonal, off, most)
    z = vectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        z[k + 1:] -= 2 * np.outer(reflectors[k], reflectors[k] @ z[k + 1:])
    return values * scale, z


def _summed(rows: DataFrame, sums, size: int) -> np.ndarray:
    """Entrywise sums over all of `rows` of the vectors that `sums` makes of each slice of whole-number vectors; `size` numbers come to the driver."""
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                total += sums(np.stack(batch["v"].iloc[k:k + SLICE].tolist()))
        yield pd.DataFrame({"k": np.arange(size), "s": total})

    got = rows.select("v").mapInPandas(parts, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(size)
    out[got["k"].to_numpy()] = got["s"].to_numpy()
    return out


def whiten(rows: DataFrame, components: int = 16, factor: int = 64, offset: int = 1_000_000, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Components are those of the distinct vectors x = floor(factor * c) + offset; `whitened` is x less the mean, projected
    on the component and divided by the root of its eigenvalue. Rows with a null vector or a null or non-finite entry go;
    null ids and repeated rows stay. Vectors of other lengths meet as if the shorter ended in entries of zero. There are as many
    components as the vectors have entries, `components` at most; an empty table gives no rows. Of a component without variance
    (an eigenvalue that rounding alone could make) `whitened` is null, and it does not enter `identity_error`; without any
    variance `explained` is null too. An x beyond the range of long is the nearest long, and a `deviation` beyond it is null.
    Other columns are not looked at.

    The distinct vectors are found by a shuffle of the vectors and stored; three sums over them (mean, covariance, covariance of
    the whitened) are made in tasks and come to the driver as that many numbers, at most the square of the vector's length.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[vec_id]
    shape = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    room = 2**63 - 1 - offset
    own = quantized(rows, [F.col(vec_id).alias("vec_id")], embedding, factor).withColumn(
        "v", F.transform("v", lambda x: F.least(x, F.lit(room)) + offset))
    own = written(own, "whole")
    width = own.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return spark.createDataFrame([], shape)
    padded = F.concat("v", F.array_repeat(F.lit(offset).cast("bigint"), F.lit(width) - F.size("v")))
    own = own.withColumn("v", padded)
    fit = written(own.select("v").distinct(), "fit")
    # Whole sums, one for each entry of the vectors.
    sums = fit.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(
        F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    n, total = int(sums[0]["n"]), [0] * width
    for r in sums:
        total[r["k"]] = int(r["s"])
    base = np.array([s // n for s in total], np.int64)
    over = [s % n for s in total]
    rest = np.array([r / n for r in over])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base).astype(float) - rest

    covariance = _summed(fit, lambda x: (lambda y: y.T @ y)(centred(x)).ravel(), width * width).reshape(width, width) / n
    most = min(components, width)
    values, axes = principal((covariance + covariance.T) / 2, most)
    trace = float(np.trace(covariance))
    real = values > width * np.finfo(float).eps * max(trace, 0.0)
    weights = axes / np.sqrt(np.where(real, values, 1.0))

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ weights
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = _summed(fit, moments, most + most * most) / n
    white = got[most:].reshape(most, most) - np.outer(got[:most], got[:most])
    error = float(np.abs(white - np.eye(most))[np.ix_(real, real)].max()) if real.any() else 0.0
    explained = values / trace if trace > 0 else np.full(most, np.nan)

    def deviations(x: np.ndarray) -> list[int | None]:
        d = x - base
        if (float(np.abs(d.astype(float)).max()) + 1) * n < (2**62 / width) ** 0.5:
            return np.square(n * d - np.array(over, np.int64)).sum(axis=1).tolist()
        exact = (sum((n * (int(a) - int(b)) - o) ** 2 for a, b, o in zip(row, base, over)) for row in x)
        return [e if e < 2**63 else None for e in exact]

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                part = batch.iloc[k:k + SLICE]
                x = np.stack(part["v"].tolist())
                z = centred(x) @ weights
                z[:, ~real] = np.nan
                away = pd.array([pd.NA if e is None else e for e in deviations(x)], "Int64")
                m = len(part)
                yield pd.DataFrame({"vec_id": np.repeat(part["vec_id"].to_numpy(), most), "component": np.tile(np.arange(1, most + 1), m), "n": n,
                                    "deviation": away.repeat(most), "whitened": z.ravel(), "explained": np.tile(explained, m), "identity_error": error})

    out = own.select(as_text("vec_id").alias("vec_id"), "v").mapInPandas(projected, shape.replace(f"vec_id {kind}", "vec_id string", 1))
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(F.col("vec_id").cast(kind), "component", "n", "deviation", null("whitened"), null("explained"), "identity_error")
