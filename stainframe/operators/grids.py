"""Cells spread on a coarse grid per slide: the numbers behind a heatmap.

A grid is sparse: only touched squares have a row, a missing square reads zero. Cells that share a
grid square are summed before they are spread, so a crowded spot costs one row, not its cells.

Scale, width and height are numbers, or names of columns where slides differ: columns of the cells, joined from the
slides, which the grid then carries along.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainframe.functions.ordering import exact_percentiles, join_on
from stainframe.operators.rasters import gaussian_weights

GRID = ("slide_id", "gx", "gy")


def _disc(r: int) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r]))


def _size(value: float | str) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _keys(*sizes: float | str) -> list[str]:
    """The grid's keys with the columns that give a slide's size."""
    return [*GRID, *dict.fromkeys(s for s in sizes if isinstance(s, str))]


def _placed(cells: DataFrame, scale: float | str) -> DataFrame:
    return cells.withColumns({"gx": F.floor(F.col("centroid_x") * _size(scale)), "gy": F.floor(F.col("centroid_y") * _size(scale))})


def _inside(width: int | str, height: int | str, margin: int = 0) -> Column:
    fits = lambda axis, size: F.col(axis).between(F.lit(margin), _size(size) - margin - 1)
    return fits("gx", width) & fits("gy", height)


def scatter_to_grid(
    cells: DataFrame, value: str, scale: float | str, width: int | str, height: int | str, radius: int = 4
) -> DataFrame:
    """Mean (`v`) and count (`n`) of non-null values of the cells whose disc covers each grid square."""
    keys = _keys(width, height)
    sums = _placed(cells, scale).filter(_inside(width, height, radius)).groupBy(*keys).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"))
    spread = sums.select("*", _disc(radius).alias("o")).select(
        "slide_id", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"), *keys[3:], "_s", "_n")
    out = spread.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("n"))
    return out.select(*keys, F.when(F.col("n") > 0, F.col("_s") / F.col("n")).otherwise(F.lit(0.0)).alias("v"), "n")


def _stretch(df: DataFrame, value: str, low: Column, high: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (high - low))))


def grid_normalise(grid: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """`v` stretched between its percentiles over the slide's counted squares, clipped to 0..1."""
    q = exact_percentiles(grid.filter(F.col("n") > 0), ["slide_id"], "v", {"_lo": low, "_hi": high})
    df = grid.join(q, "slide_id")
    span = F.when(F.col("_hi") - F.col("_lo") < 1e-8, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    return _stretch(df, "v", F.col("_lo"), F.col("_lo") + span, "v").drop("_lo", "_hi")


def cell_value_normalise(cells: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Each measured cell's value between its slide's percentiles; a flat slide gets a span of 0.01."""
    q = exact_percentiles(cells, ["slide_id"], value, {"_lo": low, "_hi": high})
    df = cells.filter(F.col(value).isNotNull()).join(q, "slide_id")
    top = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 0.01).otherwise(F.col("_hi"))
    return _stretch(df, value, F.col("_lo"), top, "normalised").drop("_lo", "_hi")


# ---- filters on blocks of the grid ------------------------------------------------------------------

#: Squares of a block's side.
BLOCK = 128


def running_max(a: np.ndarray, back: int, front: int) -> np.ndarray:
    """Along the first axis, the greatest of each entry, the `back` before and the `front` after it; three comparisons an entry.

    Entries are cut into runs as long as the window: a window is the end of one run and the start of the next, whose
    maxima are running ones.
    """
    n, size = len(a), back + front + 1
    more = -(n + back + front) % size
    pad = lambda k: np.full((k, *a.shape[1:]), -np.inf)
    runs = np.concatenate([pad(back), a, pad(front + more)]).reshape(-1, size, *a.shape[1:])
    rising = np.maximum.accumulate(runs, axis=1).reshape(-1, *a.shape[1:])
    falling = np.maximum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].reshape(-1, *a.shape[1:])
    return np.maximum(falling[:n], rising[size - 1:size - 1 + n])


def _both(step: Callable[[np.ndarray], np.ndarray], a: np.ndarray) -> np.ndarray:
    return step(step(a).T).T


def _filled(size: int) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    """Local maximum over `size` squares each way, one further back than forward if size is even; (step, reach)."""
    back, front = size // 2, size - size // 2 - 1

    def step(a: np.ndarray) -> np.ndarray:
        got = _both(lambda x: running_max(x, back, front), np.where(np.isnan(a), -np.inf, a))
        return np.where(np.isinf(got), np.nan, got)

    return step, back


def _smoothed(sigma: float) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    """Gaussian blur by axis, the edge mirrored with its square repeated; (step, reach). Squares out of reach stay missing."""
    w = gaussian_weights(sigma)
    r = len(w) // 2

    def along(a: np.ndarray) -> np.ndarray:
        padded = np.pad(a, ((r, r), (0, 0)), mode="symmetric")
        return sum(w[i] * padded[i:i + len(a)] for i in range(len(w)))

    def step(a: np.ndarray) -> np.ndarray:
        here = _both(lambda x: running_max(x, r, r), np.where(np.isnan(a), 0.0, 1.0)) > 0
        return np.where(here, _both(along, np.nan_to_num(a)), np.nan)

    return step, r


def _on_blocks(
    grid: DataFrame, width: int | str, height: int | str, inputs: Sequence[str],
    outputs: Mapping[str, Callable[[dict[str, np.ndarray]], np.ndarray]], reach: int,
) -> DataFrame:
    """`outputs` of dense arrays of `inputs`, block by block, as squares again: one shuffle, whatever is done in a block.

    A square goes to its own block and to those within `reach` of it; missing squares are NaN, in and out. What the
    cut edges of a block distort lies within `reach` of them and is not given out; at the edges of the grid nothing is cut.
    """
    keys = _keys(width, height)
    head = {f.name: f.dataType.simpleString() for f in grid.select(*keys).schema.fields}
    near = lambda axis, size: F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col(axis) - reach) / BLOCK)).cast("int"),
        F.least(F.floor((_size(size) - 1) / BLOCK), F.floor((F.col(axis) + reach) / BLOCK)).cast("int")))
    spread = grid.select(*keys, *[F.col(v).cast("double").alias(v) for v in inputs], near("gx", width).alias("_bx")).withColumn("_by", near("gy", height))
    schema = ", ".join([*[f"{k} {t}" for k, t in head.items()], *[f"{v} double" for v in outputs]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        spans = []
        for b, size in ((first["_bx"], width), (first["_by"], height)):
            end = int(first[size] if isinstance(size, str) else size)
            spans.append((max(0, b * BLOCK - reach), min(end, (b + 1) * BLOCK + reach), b * BLOCK, min(end, (b + 1) * BLOCK)))
        (x0, x1, xa, xb), (y0, y1, ya, yb) = spans
        x, y, arrays = group["gx"].to_numpy() - x0, group["gy"].to_numpy() - y0, {}
        for v in inputs:
            arrays[v] = np.full((x1 - x0, y1 - y0), np.nan)
            arrays[v][x, y] = group[v].to_numpy()
        got = {v: f(arrays)[xa - x0:xb - x0, ya - y0:yb - y0] for v, f in outputs.items()}
        at = np.nonzero(~np.isnan(next(iter(got.values()))))
        out = {k: first[k] for k in keys if k not in ("gx", "gy")} | {"gx": at[0] + xa, "gy": at[1] + ya} | {v: a[at] for v, a in got.items()}
        return pd.DataFrame(out, index=range(len(at[0])))[[*keys, *outputs]]

    return spread.groupBy(*[k for k in keys if k not in ("gx", "gy")], "_bx", "_by").applyInPandas(run, schema)


def fill_gaps(grid: DataFrame, width: int | str, height: int | str, size: int = 12, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Local maximum over `size` squares each way, one further back than forward if size is even."""
    fill, reach = _filled(size)
    return _on_blocks(grid, width, height, values, {v: lambda a, v=v: fill(a[v]) for v in values}, reach)


def smooth(grid: DataFrame, width: int | str, height: int | str, sigma: float = 3.0) -> DataFrame:
    """Gaussian blur of `v`, by axis; what falls past an edge is mirrored back, edge square repeated."""
    blur, reach = _smoothed(sigma)
    return _on_blocks(grid, width, height, ["v"], {"v": lambda a: blur(a["v"])}, reach)


def grid_gap_fill_smooth(
    grid: DataFrame, tissue: DataFrame, width: int | str, height: int | str, size: int = 12, sigma: float = 3.0
) -> DataFrame:
    """Gaps filled, then smoothed, then cut to tissue squares (`tissue`: slide and grid square)."""
    (fill, far), (blur, wide) = _filled(size), _smoothed(sigma)
    out = _on_blocks(grid, width, height, ["v"], {"v": lambda a: blur(fill(a["v"]))}, far + wide)
    return out.join(tissue.select(*GRID), list(GRID), "left_semi")


def grid_grade(
    cells: DataFrame, tissue: DataFrame, scale: float | str, width: int | str, height: int | str, radius: int = 4, size: int = 12,
    sigma: float = 3.0,
) -> DataFrame:
    """Mean grade per square, filled and smoothed, rounded half to even and kept in 0..3."""
    (fill, far), (blur, wide) = _filled(size), _smoothed(sigma)
    raw = scatter_to_grid(cells, "grade", scale, width, height, radius).withColumn("s", (F.col("n") > 0).cast("int"))
    done = _on_blocks(raw, width, height, ["v", "s"], {"v": lambda a: blur(fill(a["v"])), "s": lambda a: fill(a["s"])}, far + wide)
    grade = F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.rint(F.round("v", 6)))).cast("int")
    return done.filter(F.col("s") > 0).join(tissue.select(*GRID), list(GRID), "left_semi").select(*GRID, grade.alias("grade"))


def density_map(
    cells: DataFrame, tissue: DataFrame, scale: float | str, width: int | str, height: int | str, radius: int = 4, size: int = 12,
    sigma: float = 3.0, low: float = 0.02, high: float = 0.98, limit: float = 0.005,
) -> DataFrame:
    """Where cells are, as `v` from 0 to 1, and whether a square is `shown`; cut to tissue squares.

    Discs around cells are one, however many overlap. They are smoothed, gaps take the local maximum, and half the
    width smooths that again, all in one pass over blocks. A slide's values over `limit` are stretched between two of their
    percentiles; a slide without such values, or with equal ones (to 1e-9), keeps its own. Shown is what then reaches `limit`.
    """
    keys = _keys(width, height)
    at = lambda axis: F.expr(f"bigint({axis} * {scale if isinstance(scale, str) else f'{float(scale)!r}D'})")
    spots = cells.withColumns({"gx": at("centroid_x"), "gy": at("centroid_y")}).filter(_inside(width, height)).select(*keys).distinct()
    discs = spots.select("*", _disc(radius).alias("o")).select(
        "slide_id", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"), *keys[3:])
    ones = discs.filter(_inside(width, height)).distinct().withColumn("v", F.lit(1.0))
    (blur, wide), (fill, far), (again, less) = _smoothed(sigma), _filled(size), _smoothed(sigma / 2)
    dense = _on_blocks(ones, width, height, ["v"], {"v": lambda a: again(fill(blur(a["v"])))}, wide + far + less)
    dense = dense.join(tissue.select(*GRID), list(GRID), "left_semi")
    q = exact_percentiles(dense.filter(F.col("v") > limit), ["slide_id"], "v", {"_lo": low, "_hi": high})
    spread = join_on(dense, q, ["slide_id"], "left")
    stretched = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    value = F.when(F.col("_hi") - F.col("_lo") > 1e-9, stretched).otherwise(F.col("v"))
    return spread.withColumn("v", value).withColumn("shown", F.round("v", 9) >= limit).drop("_lo", "_hi")


def grid_last_writer(
    cells: DataFrame, value: str, order: str, scale: float | str, width: int | str, height: int | str, radius: int = 3
) -> DataFrame:
    """Value of the last cell, in `order`, whose disc covers the square."""
    keys = _keys(width, height)
    last = _placed(cells, scale).filter(_inside(width, height)).groupBy(*keys).agg(
        F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_w"))
    spread = last.select("*", _disc(radius).alias("o")).select(
        "slide_id", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"), *keys[3:], "_w")
    return spread.filter(_inside(width, height)).groupBy(*keys).agg(F.max("_w")["v"].alias("v"))
