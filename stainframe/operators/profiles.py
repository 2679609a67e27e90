"""Stain profiles across the membrane: along rays, and by distance to the cell boundary."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from stainframe.constants import DAB_POSITIVE
from stainframe.functions.envelope import nearest_along_rows
from stainframe.functions.lineage import by_merge
from stainframe.functions.rays import Band, clipped, ranked
from stainframe.operators.instances import CELL
from stainframe.operators.pixels import TILE

RADIUS, BINS = 15, 20
#: Side of the blocks that rays are walked on, pixels of a strip that goes to Python as one row, and the coordinate of pixels
#: that have none, which is far from all rasters.
BLOCK, STRIP, NOWHERE = 512, 1024, -(1 << 29)


def thickness_radial_fwhm(pixels: DataFrame, min_px: int = 20, min_peak: float = DAB_POSITIVE) -> DataFrame:
    """Width at half height of the mean DAB by signed distance to the cell boundary, in its box.

    Pixels of each cell's bounding box carry the distance to the nearest pixel of the other side:
    vertical gaps by windows along columns, then a lower envelope along each row of the box. Missing pixels
    of the box are on neither side and in no bin.
    """
    cells = pixels.filter(F.col("cell_id") > 0).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1")).filter(F.col("_n") >= min_px)
    rows = cells.withColumn("x", F.explode(F.sequence("_x0", "_x1"))).withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    px = rows.select(*TILE, "cell_id", "x", "y").withColumnRenamed("cell_id", "_cell").join(
        by_merge(pixels.select(*TILE, "x", "y", "cell_id", "dab")), [*TILE, "x", "y"], "left")
    px = px.withColumn("_in", F.col("cell_id") == F.col("_cell"))
    key = [*TILE, "_cell"]
    up = Window.partitionBy(*key, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*key, "x").orderBy("y").rowsBetween(0, Window.unboundedFollowing)

    def gap(test: Column) -> Column:
        at = F.when(test, F.col("y"))
        return F.least(F.col("y") - F.last(at, True).over(up), F.first(at, True).over(down) - F.col("y"))

    px = px.select(*key, "x", "y", "dab", "_in", gap(~F.col("_in")).alias("_g_out"), gap(F.col("_in")).alias("_g_in"))
    px = nearest_along_rows(px, TILE, ["_cell"], {"_to_out": "_g_out", "_to_in": "_g_in"}, cap=RADIUS + 1).filter(F.col("_in").isNotNull())
    signed = F.when(F.col("_in"), F.col("_to_out")).otherwise(-F.col("_to_in"))
    width = 2.0 * RADIUS / BINS
    bins = px.select(*key, "dab", F.floor((signed + RADIUS) / width).cast("int").alias("_b")).filter(
        F.col("_b").between(0, BINS - 1))
    means = bins.groupBy(*key, "_b").agg(F.avg("dab").alias("_v"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    # At most 20 bins per cell.
    known = means.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_b", "_v"))).alias("_k"))
    known = known.filter(F.size("_k") >= 3)

    def filled(b: Column) -> Column:
        """The bin's mean, or the straight line between its known neighbours; flat past the ends."""
        low = F.array_max(F.filter("_k", lambda e: e["_b"] <= b))
        high = F.array_min(F.filter("_k", lambda e: e["_b"] >= b))
        slope = (high["_v"] - low["_v"]) * (b - low["_b"]) / (high["_b"] - low["_b"])
        return (F.when(low.isNull(), high["_v"]).when(high.isNull() | (low["_b"] == high["_b"]), low["_v"])
                .otherwise(low["_v"] + slope))

    known = known.withColumn("_p", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), filled))
    known = known.withColumn("_peak", F.array_max("_p"))
    known = known.withColumn("_above", F.transform("_p", lambda v: v >= F.col("_peak") / 2))
    steps = F.sequence(F.lit(0), F.lit(BINS - 2))
    above = lambda i: F.get("_above", i)
    rise = F.array_min(F.filter(steps, lambda i: ~above(i) & above(i + 1)))
    fall = F.array_max(F.filter(steps, lambda i: above(i) & ~above(i + 1)))
    centre = lambda i: F.lit(-RADIUS + width / 2) + i * width
    left = F.coalesce(centre(rise + 1), centre(F.lit(0)))
    right = F.coalesce(centre(fall), centre(F.lit(BINS - 1)))
    fwhm = F.abs(right - left)
    width_px = F.when((F.col("_peak") >= min_peak) & (fwhm > 0), fwhm)
    return cells.select(*CELL).join(
        by_merge(known.select(*TILE, F.col("_cell").alias("cell_id"), width_px.alias("thickness_px"))), list(CELL), "left")


def _along(ring: Column, total: Column, cumulative: Column, share: Column) -> Column:
    """Point at a share of the ring's length."""
    at = share * total
    n = F.size(ring)
    i = F.least(F.size(F.filter(cumulative, lambda c: c <= at)), n) - 1
    a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
    length = F.get(cumulative, i + 1) - F.get(cumulative, i)
    t = F.coalesce(F.try_divide(at - F.get(cumulative, i), length), F.lit(0.0))
    return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))


def thickness_ray_fwhm(
    polygons: DataFrame, pixels: DataFrame, rays: int = 16, reach: int = 20, min_peak: float = 0.05, min_rays: int = 3
) -> DataFrame:
    """Median over rays across the boundary of the longest run at half height or more.

    `polygons`: tile, `cell_id`, `ring`. Each ray asks for 2*reach+1 pixels by an equi-join; a ray off
    the raster reads 0.
    """
    n = F.size("ring")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sqrt(
        F.pow(F.get("ring", (i + 1) % n)["x"] - F.get("ring", i)["x"], F.lit(2.0))
        + F.pow(F.get("ring", (i + 1) % n)["y"] - F.get("ring", i)["y"], F.lit(2.0))))
    ends = F.transform(F.sequence(F.lit(0), n), lambda i: F.aggregate(
        F.slice(sides, F.lit(1), i), F.lit(0.0), lambda s, v: s + v))
    df = polygons.withColumn("_cum", ends).withColumn("_total", F.element_at("_cum", -1))
    df = df.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))))
    share = F.col("ray") / F.lit(float(rays))
    point = lambda s: _along(F.col("ring"), F.col("_total"), F.col("_cum"), s)
    df = df.withColumns({"_p": point(share), "_a": point(F.greatest(F.lit(0.0), share - 0.01)),
                         "_b": point(F.least(F.lit(1.0), share + 0.01))})
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    length = F.sqrt(dx * dx + dy * dy) + 1e-8
    df = df.select(*CELL, "ray", "_p", (-dy / length).alias("_nx"), (dx / length).alias("_ny"),
                   F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d"))
    df = df.select(*CELL, "ray", "d", F.rint(F.col("_p.x") + F.col("d") * F.col("_nx")).cast("int").alias("x"),
                   F.rint(F.col("_p.y") + F.col("d") * F.col("_ny")).cast("int").alias("y"))
    seen = df.join(by_merge(pixels.select(*TILE, "x", "y", "dab")), [*TILE, "x", "y"], "left").withColumn(
        "dab", F.coalesce(F.col("dab"), F.lit(0.0)))
    # 41 samples per ray.
    ray = seen.groupBy(*CELL, "ray").agg(
        F.sort_array(F.collect_list(F.struct("d", "dab"))).alias("_v"), F.max("dab").alias("_peak"))
    run = F.aggregate(
        "_v", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, e: F.struct(
            F.when(e["dab"] >= F.col("_peak") / 2, acc["now"] + 1).otherwise(F.lit(0)).alias("now"),
            F.when(e["dab"] >= F.col("_peak") / 2, F.greatest(acc["best"], acc["now"] + 1)).otherwise(acc["best"]).alias("best")),
        lambda acc: acc["best"])
    runs = ray.filter(F.col("_peak") >= min_peak).select(*CELL, run.alias("_w"))
    widths = runs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_rays"), F.median("_w").alias("_m"))
    return polygons.select(*CELL).join(by_merge(widths), list(CELL), "left").select(
        *CELL, F.coalesce("n_rays", F.lit(0)).alias("n_rays"),
        F.when(F.col("n_rays") >= min_rays, F.col("_m")).alias("thickness_px"))


def _seen_by_blocks(px: DataFrame, extent: tuple[int, int], block: int, reach: int) -> DataFrame:
    """`px` once per block that it is at most `reach` from, its own first of all, with the centre `_cx`, `_cy` of its cell's nucleus.

    Cells without a nucleus become background, which is split by block so that it is no group of its own.
    """
    nucleus = (F.col("cell_id") > 0) & (F.col("_nuc") == 1)
    cell = Window.partitionBy(*CELL, *[F.when(F.col("cell_id") == 0, F.floor(F.col(c) / block)) for c in "xy"])
    centre = {f"_c{c}": F.avg(F.when(nucleus & (F.col(c) != NOWHERE), F.col(c))).over(cell) for c in "xy"}
    px = px.withColumns({**centre, "_has": F.max(nucleus).over(cell)})
    px = px.withColumn("cell_id", F.when(F.col("_has"), F.col("cell_id")).otherwise(F.lit(0))).drop("_has")
    for c, size in zip("xy", extent):
        at = lambda d, c=c: F.floor((F.col(c) + d) / block)
        # Past the raster's edges there are only the blocks of pixels that lie there.
        first, last = F.greatest(at(-reach), F.least(at(0), F.lit(0))), F.least(at(reach), F.greatest(at(0), F.lit((size - 1) // block)))
        px = px.withColumn(f"_b{c}", F.explode(F.sequence(first, last)))
    return px


def ring_adaptive(
    pixels: DataFrame, extent: tuple[int, int], rays: int = 16, outer: tuple[int, int] = (1, 2), band: int = 3,
    min_reach: int = 5, min_area: int = 20, max_dist: int = 60, min_rays: int = 0,
) -> DataFrame:
    """Membrane band around each ray's DAB peak in the outer part of the cell, and the means it gives.

    Rays start at the nucleus centroid; `outer` = (1, 2) searches from half the cell's reach on, (2, 3)
    from two thirds. The band and its neighbours inside the cell form the ring. Rays near the raster's
    edge stay on the edge pixel.

    A raster that fits in a block is walked where its tile lies, so placed pixels are not shuffled. A larger one is cut
    into blocks with a halo of what a ring reaches: the block of a nucleus's centre walks its rays and counts the pixels
    of the cell that it sees, and the others are counted by the blocks they lie in.
    """
    whole, block, reach = max(extent) <= BLOCK, BLOCK, max_dist + 1
    walk, kind = Band(extent, rays, outer, band, min_reach, max_dist), pixels.schema["cell_id"].dataType
    counts = ["n_px", "n_ring", "n_nucleus", "_n_cyto", "_k_ring", "_k_nucleus", "_k_cyto", "n_rays"]
    sums = ["_s_ring", "_s_nucleus", "_s_cyto"]
    px = pixels.filter(F.col("slide_id").isNotNull() & F.col("tile_id").isNotNull()).select(
        *TILE, *[F.when(F.col(c).between(NOWHERE, -NOWHERE - 1), F.col(c)).otherwise(F.lit(NOWHERE)).cast("bigint").alias(c) for c in "xy"],
        F.when(F.col("cell_id") > 0, F.col("cell_id")).otherwise(F.lit(0)).cast(kind).alias("cell_id"),
        F.coalesce((F.col("nuc_id") == F.col("cell_id")).cast("int"), F.lit(2)).alias("_nuc"), F.col("dab").cast("double").alias("dab"))
    keys = list(TILE)
    if not whole:
        px, keys = _seen_by_blocks(px, extent, block, reach), [*TILE, "_bx", "_by"]
    # Strips of some thousand pixels go to Python as lists, in half of the time that rows take; lists of one aggregate
    # keep the same order. Place, nucleus and a missing DAB are one number.
    code = F.col("y") * (1 << 33) + (F.col("x") - NOWHERE) * 8 + F.col("_nuc") + F.when(F.col("dab").isNull(), 4).otherwise(0)
    lists = {"_code": code, "cell_id": F.col("cell_id"), "dab": F.coalesce("dab", F.lit(0.0)),
             **({} if whole else {c: F.coalesce(c, F.lit(float("nan"))) for c in ("_cx", "_cy")})}
    strip = F.floor(F.col("y") / max(1, STRIP // (extent[0] if whole else block + 2 * reach)))
    strips = px.groupBy(*keys, strip.alias("_strip")).agg(*[F.collect_list(v).alias(c) for c, v in lists.items()])
    names = list(lists)

    def measure(table: pa.Table) -> pa.Table:
        code, cell, dab, *centre = (table.column(c).combine_chunks().flatten().to_numpy() for c in names)
        x, y, nuc, null = ((code >> 3) & (1 << 30) - 1) + NOWHERE, code >> 33, code & 3, code & 4 > 0
        ids, at = np.unique(cell, return_inverse=True)
        if whole:
            x0, y0, width, height = -1, -1, extent[0] + 2, extent[1] + 2
            core = (nuc == 1) & (cell > 0)
            here = np.bincount(at[core], minlength=len(ids)) > 0
            cx, cy = (_means(at, c, core & (c != NOWHERE), len(ids)) for c in (x, y))
            counted = here[at]
        else:
            bx, by = (table.column(c)[0].as_py() for c in ("_bx", "_by"))
            x0, y0, width, height = bx * block - reach, by * block - reach, block + 2 * reach, block + 2 * reach
            cx, cy = np.empty(len(ids)), np.empty(len(ids))
            cx[at], cy[at] = centre
            hx, hy = clipped(cx, extent[0]) // block, clipped(cy, extent[1]) // block
            here = (ids > 0) & (hx == bx) & (hy == by)
            seen = [(v >= home * block - reach) & (v < (home + 1) * block + reach) for v, home in ((x, hx[at]), (y, hy[at]))]
            stray = (cell > 0) & (x // block == bx) & (y // block == by) & ~(seen[0] & seen[1])
            counted = here[at] | stray
        framed = (x >= x0) & (x < x0 + width) & (y >= y0) & (y < y0 + height)
        place = (y[framed] - y0) * width + (x[framed] - x0)
        on, n_rays = np.zeros(len(cell), bool), np.zeros(len(ids), "int64")
        on[framed], n_rays[here] = walk.rings(
            place, cell[framed], ranked(dab[framed], null[framed]), (x0, y0, width, height), ids[here], cx[here], cy[here])
        # By cell: six kinds of pixel, off and on the ring; not nucleus, nucleus or unknown.
        sort = at * 6 + on * 3 + nuc
        n, k, s = (np.bincount(sort[some], weights, len(ids) * 6).reshape(-1, 6) for some, weights in (
            (counted, None), (counted & ~null, None), (counted & ~null, dab[counted & ~null])))
        found = n.any(axis=1)
        n, k, s = n[found], k[found], s[found].astype("float64")
        ring, core, cyto = (lambda v: v[:, 3:].sum(axis=1)), (lambda v: v[:, 1] + v[:, 4]), (lambda v: v[:, 0])
        tile = table.select(list(TILE)).take(np.zeros(len(n), "int64"))
        values = [n.sum(axis=1), ring(n), core(n), cyto(n), ring(k), core(k), cyto(k), n_rays[found], ring(s), core(s), cyto(s)]
        return pa.table([*tile.columns, pa.array(ids[found]).cast(to_arrow_type(kind)), *map(pa.array, values)],
                        names=[*CELL, *counts, *sums])

    schema = StructType([*[pixels.schema[c] for c in CELL], *[StructField(c, LongType()) for c in counts],
                         *[StructField(c, DoubleType()) for c in sums]])
    cells = strips.groupBy(*keys).applyInArrow(measure, schema)
    if not whole:
        cells = cells.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in (*counts, *sums)])
    mean = lambda c: F.when(F.col(f"_k_{c}") > 0, F.col(f"_s_{c}") / F.col(f"_k_{c}"))
    keep = (F.col("n_px") >= min_area) & (F.col("n_nucleus") > 0) & (F.col("n_ring") >= 3) & (F.col("n_rays") >= max(min_rays, 1))
    return cells.filter(keep).select(
        *CELL, "n_ring", mean("ring").alias("membrane"), mean("nucleus").alias("nucleus"),
        F.when(F.col("_n_cyto") > 3, mean("cyto")).alias("cytoplasm"), "n_rays")


def _means(group: np.ndarray, values: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    """Mean of `some` of the values by group, NaN where there is none."""
    with np.errstate(invalid="ignore"):
        return np.bincount(group[some], values[some], n) / np.bincount(group[some], minlength=n)
