"""Spatial lookups as equi-joins on grid cells: Spark plans no range join of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float,
    inclusive: bool = True, flag: str = "near",
) -> DataFrame:
    """`left` with `flag`: some row of `right` of the same keys lies within `radius`.

    Both sides have `x` and `y`. Grid squares have a diagonal of `radius`, which makes three tests of
    rising cost, each exact:
      1. any right point in a point's own square is in reach: an equi-join on occupied squares, one
         row per square however many points it holds, settles crowded places without a pair;
      2. squares wholly out of reach are never probed;
      3. distinct points still open are measured against distinct points of the 24 squares around.
    """
    keys = list(keys)
    # A hair short of radius / sqrt(2), so that rounding cannot put two points of a square out of reach.
    step = radius / 2**0.5 * (1 - 1e-9)
    own = {"_gx": F.floor(F.col("x") / step), "_gy": F.floor(F.col("y") / step)}
    square = [*keys, "_gx", "_gy"]
    others = right.select(*keys, "x", "y").distinct().withColumns(own)
    occupied = others.select(*square).distinct().withColumn("_own", F.lit(True))
    marked = left.withColumns(own).join(occupied, square, "left")

    gaps = range(-2, 3)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in gaps for b in gaps if (a, b) != (0, 0)])
    still_open = marked.filter(F.col("_own").isNull()).select(*square, "x", "y").distinct()
    probe = still_open.select("*", F.explode(around).alias("_o")).select(
        *keys, "x", "y", (F.col("_gx") + F.col("_o.a")).alias("_gx"), (F.col("_gy") + F.col("_o.b")).alias("_gy")).alias("p")
    target = others.withColumnsRenamed({"x": "_ox", "y": "_oy"}).alias("o")
    gap = (F.col("x") - F.col("_ox")) ** 2 + (F.col("y") - F.col("_oy")) ** 2
    limit = F.lit(float(radius) ** 2)
    condition = gap <= limit if inclusive else gap < limit
    for k in square:
        condition = condition & (F.col(f"p.{k}") == F.col(f"o.{k}"))
    measured = probe.join(target, condition, "left_semi").select(*keys, "x", "y").distinct().withColumn("_rim", F.lit(True))
    return marked.join(measured, [*keys, "x", "y"], "left").withColumn(
        flag, F.col("_own").isNotNull() | F.col("_rim").isNotNull()).drop("_gx", "_gy", "_own", "_rim")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Point in polygon by counting the edges a ray to the right crosses; ring need not be closed."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))

    def crosses(e: Column) -> Column:
        spans = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
        return F.when(spans, x < at).otherwise(F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}


#: A cell of a ring's own grid: `above`, whether the edges right of it cross a ray at its foot an odd number of times;
#: `turns`, heights at which that changes; `edges`, four numbers for each edge that passes through its columns.
RING_CELL = "_row bigint, _col bigint, above boolean, turns array<double>, edges array<double>"
RING_GRID = {k: "double" for k in ("_x0", "_x1", "_y0", "_y1", "_h", "_w")}
#: Edges a cell holds on an evenly drawn ring.
EDGES_PER_CELL = 8


def ring_edges(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """(ax, ay, bx, by) for each edge of a closed ring, level ones left out."""
    e = np.column_stack([xs, ys, np.roll(xs, -1), np.roll(ys, -1)]).astype(float)
    return e[e[:, 1] != e[:, 3]]


def ring_grid(xs: np.ndarray, ys: np.ndarray) -> tuple[float, ...]:
    """Box of a ring, and height and width of the cells of its grid.

    As fine as lets a ring of n points have at most some 8 n cells and 4 n copies of edges, whatever its shape: long
    edges make coarse cells.
    """
    e, n = ring_edges(xs, ys), len(xs)
    wide, high, parts = float(np.ptp(xs)), float(np.ptp(ys)), -(-n // EDGES_PER_CELL)
    h = max(high / parts, np.abs(e[:, 1] - e[:, 3]).sum() / n) or 1.0
    w = max(wide / parts, np.abs(e[:, 0] - e[:, 2]).sum() / n, wide * np.ceil(high / h) / (8 * n)) or 1.0
    return float(xs.min()), float(xs.max()), float(ys.min()), float(ys.max()), float(h), float(w)


def cells_of_ring(xs: np.ndarray, ys: np.ndarray) -> list[tuple]:
    """Every cell of the ring's grid that is not wholly outside it, as RING_CELL.

    An inner vertex of a chain of edges right of a cell counts twice and so not at all; what is left of a chain are
    the heights where it starts or ends.
    """
    e = ring_edges(xs, ys)
    x0, _, y0, _, h, w = ring_grid(xs, ys)
    place = lambda v, start, step: np.floor((v - start) / step).astype("int64")
    ya, yb = place(e[:, 1], y0, h), place(e[:, 3], y0, h)
    xa, xb = place(e[:, 0], x0, w), place(e[:, 2], x0, w)
    low, n_rows = np.minimum(ya, yb), np.abs(ya - yb) + 1
    edge = np.repeat(np.arange(len(e)), n_rows)
    row = low[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n_rows) - n_rows, n_rows)
    order = np.argsort(row, kind="stable")
    found = []
    for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(e) else ():
        r = int(row[part[0]])
        through: dict[int, list[int]] = {}
        begins: dict[int, list[int]] = {}
        for k in edge[part].tolist():
            first, last = sorted((int(xa[k]), int(xb[k])))
            begins.setdefault(first, []).append(k)
            for c in range(first, last + 1):
                through.setdefault(c, []).append(k)
        above, turns = False, set()
        for c in range(max(through), -1, -1):
            own = through.get(c, [])
            if own or above or turns:
                found.append((r, c, above, np.array(sorted(turns), dtype=float), e[own].ravel()))
            for k in begins.get(c, []):
                for y, at in ((e[k, 1], ya[k]), (e[k, 3], yb[k])):
                    if at > r:
                        above = not above
                    elif at == r:
                        turns ^= {float(y)}
    return found


def _of_rings(polygons: DataFrame, keys: Sequence[str], ring: str, fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """`keys` of each polygon with the rows `fn(xs, ys)` makes of its ring; rings without a point give none."""
    keys = list(keys)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in polygons.select(*keys).schema.fields)
    names = [c.split()[0] for c in schema.split(", ")]
    axis = lambda c: F.transform(ring, lambda p: p[c].cast("double")).alias(f"_{c}s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                got = pd.DataFrame(fn(pdf["_xs"].iloc[i], pdf["_ys"].iloc[i]), columns=names)
                for at, k in enumerate(keys):
                    got.insert(at, k, pdf[k].iloc[i])
                yield got

    return polygons.filter(F.size(ring) > 0).select(*keys, axis("x"), axis("y")).mapInPandas(run, f"{head}, {schema}")


def ring_grids(polygons: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """`keys`, box (`_x0 _x1 _y0 _y1`) and cell size (`_h _w`) of each ring; coordinates are finite."""
    return _of_rings(polygons, keys, ring, lambda xs, ys: [ring_grid(xs, ys)], ", ".join(f"{k} {t}" for k, t in RING_GRID.items()))


def ring_cells(polygons: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """`keys` and RING_CELL: the cells of each ring. A ring is a row of the table and is cut by itself."""
    return _of_rings(polygons, keys, ring, cells_of_ring, RING_CELL)


def in_ring_cell(x: Column, y: Column) -> Column:
    """`in_ring` from the cell of `ring_cells` the point lies in, with the same arithmetic; no cell is outside."""
    def crosses(i: Column) -> Column:
        ax, ay, bx, by = (F.get("edges", i + k) for k in range(4))
        return F.when((ay > y) != (by > y), x < ax + (y - ay) * (bx - ax) / (by - ay)).otherwise(F.lit(False))

    starts = F.filter(F.transform("edges", lambda e, i: i), lambda i: i % 4 == 0)
    n = F.size(F.filter(starts, crosses)) + F.size(F.filter("turns", lambda t: t > y)) + F.col("above").cast("int")
    return F.coalesce(n % 2 == 1, F.lit(False))


def halo_blocks(
    pixels: DataFrame, keys: Sequence[str], block: int, halo: int,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Every pixel once per block that needs it: its own, and those whose halo it lies in.

    A block holds at most (block + 2*halo)^2 pixels, so neighbourhood work per block is bounded even
    when a raster is a whole slide. `extent` = (width, height) skips blocks past the raster's edge.
    """
    def span(axis: str, size: int | None) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / block)).cast("int")
        last = F.floor((F.col(axis) + halo) / block).cast("int")
        if size is not None:
            last = F.least(last, F.lit((size - 1) // block))
        return F.explode(F.sequence(first, last))

    w, h = extent or (None, None)
    return pixels.withColumn("_bx", span("x", w)).withColumn("_by", span("y", h))
