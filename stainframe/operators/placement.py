"""Cells in space: duplicates across tiles, nearest matches, regions and polygon fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.functions.spatial import exists_within, in_ring_cell, ring_bounds, ring_cells, ring_grids

REGION_GRID = 1024


def dedup_hybrid(cells: DataFrame, radius: float) -> DataFrame:
    """All centre cells, and those padding cells that no centre cell of the slide is near (inclusive)."""
    placed = cells.withColumns({"x": F.col("centroid_x"), "y": F.col("centroid_y")})
    centre = F.coalesce(F.col("is_center"), F.lit(True))
    flagged = exists_within(placed.filter(~centre), placed.filter(centre), ["slide_id"], radius)
    orphans = flagged.filter(~F.col("near"))
    return cells.filter(centre).unionByName(orphans.select(*cells.columns))


def nearest_match_rate(
    ours: DataFrame, others: DataFrame, keys: Sequence[str], radius: float = 10.0
) -> DataFrame:
    """Share of our centroids with another centroid nearer than `radius`, per group and overall (nulls)."""
    flagged = exists_within(ours, others, keys, radius, inclusive=False)
    return flagged.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("near").alias("n_matched"),
        F.avg(F.col("near").cast("int")).alias("match_rate"))


def assign_regions(cells: DataFrame, regions: DataFrame, grid: int = REGION_GRID) -> DataFrame:
    """Region of each cell: the first polygon, in order, that holds its centroid, else `Outside`.

    Polygons are listed, by number and box alone, under the grid squares their box touches; cells look up their own
    square, so a crowded slide is spread over squares. Whether a polygon holds a centroid is read from one cell of
    the polygon's own grid with the few edges that pass there, so a point's work does not follow the number of
    vertices and no ring travels with the points. A polygon given twice counts once.
    """
    known = regions.select("slide_id", "ord", "name", "ring").distinct().withColumn(
        "_ring", F.xxhash64("slide_id", "ord", "name", "ring"))
    box = ring_grids(known, ["slide_id", "_ring", "ord", "name"])
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / grid), F.floor(F.col(b) / grid)))
    listed = box.withColumn("_gx", span("_x0", "_x1")).withColumn("_gy", span("_y0", "_y1")).select(
        F.col("slide_id").alias("_slide"), "_ring", "_gx", "_gy", "ord", "name", "_x0", "_x1", "_y0", "_y1", "_h", "_w")
    points = cells.select("slide_id", "cell_id", F.col("centroid_x").alias("_x"), F.col("centroid_y").alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    near = ((F.col("slide_id") == F.col("_slide")) & (F.floor(x / grid) == F.col("_gx"))
            & (F.floor(y / grid) == F.col("_gy")) & x.between(F.col("_x0"), F.col("_x1"))
            & y.between(F.col("_y0"), F.col("_y1")))
    boxed = points.join(listed, near, "left").select(
        "slide_id", "cell_id", "_x", "_y", "ord", "name", "_ring",
        F.floor((y - F.col("_y0")) / F.col("_h")).alias("_row"), F.floor((x - F.col("_x0")) / F.col("_w")).alias("_col"))
    tested = boxed.join(ring_cells(known, ["slide_id", "_ring"]), ["slide_id", "_ring", "_row", "_col"], "left")
    hits = tested.select("slide_id", "cell_id", F.when(in_ring_cell(x, y), F.struct("ord", "name")).alias("_hit"))
    return hits.groupBy("slide_id", "cell_id").agg(
        F.coalesce(F.min("_hit")["name"], F.lit("Outside")).alias("region_assigned"))


def polygon_pixels(polygons: DataFrame) -> DataFrame:
    """Every pixel centre inside each polygon, one row per polygon and pixel.

    A polygon is cut into pixel rows; each row's edge crossings, sorted, bound its filled spans. The
    work is the area filled, not the bounding box times the number of edges.
    """
    n = F.size("ring")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(F.col("ring"), i).alias("a"), F.get(F.col("ring"), (i + 1) % n).alias("b")))
    b = ring_bounds(F.col("ring"))
    rows = polygons.select("slide_id", "cell_id", edges.alias("_e"), F.explode(
        F.sequence(F.ceil(b["y0"]), F.floor(b["y1"]))).alias("y"))
    spanning = F.filter("_e", lambda e: (e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y")))
    at = F.transform(spanning, lambda e: e["a"]["x"] + (F.col("y") - e["a"]["y"]) * (
        e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))
    crossings = rows.withColumn("_c", F.sort_array(at)).filter(F.size("_c") > 1)
    spans = crossings.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_c") - 2, F.lit(2)))).withColumns({
        "_a": F.ceil(F.get("_c", F.col("_i"))), "_b": F.ceil(F.get("_c", F.col("_i") + 1)) - 1})
    return spans.filter(F.col("_b") >= F.col("_a")).withColumn("x", F.explode(F.sequence("_a", "_b"))).select(
        "slide_id", "cell_id", "x", "y")


def polygon_rasterize(polygons: DataFrame) -> DataFrame:
    """One owner per pixel: the later cell overwrites the earlier. Pixels below zero are off the slide.

    Of cells with the same outline only the latest can own a pixel, so an outline is filled once.
    """
    latest = polygons.groupBy("slide_id", "ring").agg(F.max("cell_id").alias("cell_id"))
    filled = polygon_pixels(latest).filter((F.col("x") >= 0) & (F.col("y") >= 0))
    return filled.groupBy("slide_id", "x", "y").agg(F.max("cell_id").alias("cell_id"))
