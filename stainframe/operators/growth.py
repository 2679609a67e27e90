"""Cells grown from nuclei, and cell outlines shrunk back to the membrane."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stainframe.operators.pixels import TILE
from stainframe.operators.rasters import _box, block_filter, ellipse_steps, eroded_field


def grow_regions(
    pixels: DataFrame, blocked: str, cap: int = 60, out: str = "grown_id", extent: tuple[int, int] | None = None,
    keys: Sequence[str] = TILE, carry: Sequence[str] = (),
) -> DataFrame:
    """Labels spread from nuclei through 4-neighbours: fewest steps win, then the lowest id.

    Growth stops at `blocked` pixels, at other cells and after `cap` steps. A pixel's label depends
    only on pixels within `cap` steps, so a block with a halo of `cap` gives the exact answer however
    large the raster is.
    """
    def fn(fields):
        return {out: grown_field(fields["nuc_id"], fields[blocked], cap)}

    return block_filter(pixels, fn, ["nuc_id", blocked], {out: "int"}, cap, 128, extent, keys, carry)


def grow_cells(
    pixels: DataFrame, cap: int = 60, extent: tuple[int, int] | None = None, keys: Sequence[str] = TILE, carry: Sequence[str] = (),
) -> DataFrame:
    """`cell_id` grown from nuclei up to the closed membrane `mask`, and `_in`, the 3 x 3 erosion of its cell, in one pass over blocks.

    Stained nuclei are no membrane: left in, closing would bridge the cytoplasm beside them. The halo is what erosion,
    growth and closing reach one after another.
    """
    # 2 is a stained pixel of which it is not known whether a nucleus has it: it takes no part in closing and is not free.
    mark = F.when(F.col("mask"), F.when(F.col("nuc_id").isNull(), 2).when(F.col("nuc_id") == 0, 1)).otherwise(F.lit(0))
    mark = F.coalesce(mark, F.lit(0))

    def fn(fields):
        nuclei, mark = fields["nuc_id"], fields["_mark"]
        there = ~np.isnan(mark)
        closed = ellipse_steps(np.where(mark == 2, np.nan, mark), 5, "close")
        label = grown_field(nuclei, np.where(np.nan_to_num(nuclei) != 0, 0.0, closed), cap)
        return {"cell_id": label, "_in": eroded_field(label, there, 3, 1).astype(float)}

    return block_filter(pixels.withColumn("_mark", mark), fn, ["nuc_id", "_mark"], {"cell_id": "int", "_in": "boolean"}, cap + 5, 128,
                        extent, keys, ["nuc_id", *carry])


def grown_field(nuclei: np.ndarray, blocked: np.ndarray, cap: int) -> np.ndarray:
    """`grow_regions` of a block; a pixel the raster lacks is blocked."""
    label = np.nan_to_num(nuclei)
    free = (label == 0) & (np.nan_to_num(blocked, nan=1.0) <= 0)
    # With a rim, and infinity where nothing spreads from, the four neighbours are four views.
    held = np.full((label.shape[0] + 2, label.shape[1] + 2), np.inf)
    inner = held[1:-1, 1:-1]
    inner[:] = np.where(label > 0, label, np.inf)
    for _ in range(cap):
        around = np.minimum(np.minimum(held[:-2, 1:-1], held[2:, 1:-1]), np.minimum(held[1:-1, :-2], held[1:-1, 2:]))
        reached = free & (around < np.inf)
        if not reached.any():
            break
        np.copyto(inner, around, where=reached)
        free &= ~reached
    return np.where(label == 0, np.where(inner < np.inf, inner, 0.0), label)


def regrow_from_probability(
    pixels: DataFrame, probability: str = "prob", limit: float = 0.5, cap: int = 60,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Cells per tile regrown with membranes where the probability is above the limit.

    A tile without a nucleus goes along and reports no cell: its growth ends at once, while leaving it out would take
    a second pass over the pixels.
    """
    grown = grow_regions(pixels.withColumn("_wall", F.col(probability) > limit), "_wall", cap, extent=extent)
    return grown.groupBy(*TILE).agg(
        F.count_distinct(F.when(F.col("grown_id") > 0, F.col("grown_id"))).alias("n_cells"),
        F.count_if(F.col("grown_id") > 0).alias("cell_px"))


def shrink_to_membrane(
    pixels: DataFrame, rounds: int = 4, dab_limit: float = 0.10, bar_limit: float = 0.0, guard: float = 1.2,
    out: str = "refined_id",
) -> DataFrame:
    """Peels boundary pixels off cells while they are not on the membrane.

    Round i removes boundary pixels with DAB under dab_limit * (1 + i/2) or no bar response, never
    nucleus pixels, and never so many that a cell falls below `guard` nuclei. A tile stops for good
    in the first round that removes nothing. All sums are windows inside a tile.
    """
    tile, cell = Window.partitionBy(*TILE), Window.partitionBy(*TILE, out)
    # Nucleus size of each cell id, where the tile lies: a nucleus pixel outside of its cell is counted by a second row.
    roles = F.when((F.col("nuc_id") > 0) & ~F.col("nuc_id").eqNullSafe(F.col("cell_id")), F.array(F.lit(0), F.lit(1)))
    df = pixels.withColumn("_role", F.explode(F.coalesce(roles, F.array(F.lit(0)))))
    df = df.withColumn("_id", F.when(F.col("_role") == 1, F.col("nuc_id")).otherwise(F.col("cell_id")))
    df = df.withColumn("_size", F.count_if((F.col("nuc_id") > 0) & (F.col("nuc_id") == F.col("_id"))).over(
        Window.partitionBy(*TILE, "_id"))).filter(F.col("_role") == 0).drop("_role", "_id")
    df = df.withColumns({out: F.col("cell_id"), "_live": F.lit(True)})
    for i in range(rounds):
        df = _box(df, "_lo", F.col(out), F.min, (-1, 1), (-1, 1), TILE)
        weak = (F.col("dab") < dab_limit * (1 + 0.5 * i)) | (F.col("bar") <= bar_limit)
        peel = F.col("_live") & (F.col(out) > 0) & (F.col("_lo") != F.col(out)) & weak & (F.col("nuc_id") == 0)
        df = df.withColumn("_peel", peel)
        left = F.count(F.lit(1)).over(cell) - F.count_if("_peel").over(cell)
        df = df.withColumn("_peel", F.col("_peel") & ~F.coalesce(left < F.col("_size") * guard, F.lit(False)))
        df = df.withColumn("_live", F.max("_peel").over(tile)).withColumn(
            out, F.when(F.col("_peel"), F.lit(0)).otherwise(F.col(out)))
    return df.drop("_live", "_lo", "_peel", "_size")
