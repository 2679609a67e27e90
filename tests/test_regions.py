"""Points in polygons by the cells of a ring's own grid, against the plain even-odd rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stainframe.operators import placement
from stainframe.functions.spatial import ring_cells
from stainframe.operators.placement import assign_regions

REGION = "slide_id string, ord int, name string, ring array<struct<x:double,y:double>>"
CELL = "slide_id string, cell_id long, centroid_x double, centroid_y double"


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def star(rng, n, reach, whole=False):
    """A ring of n vertices in turn around a centre, at any distance from it."""
    got = []
    for i in range(n):
        a, r = 2 * math.pi * i / n, reach * rng.uniform(0.2, 1)
        x, y = reach + r * math.cos(a), reach + r * math.sin(a)
        got.append((float(round(x)), float(round(y))) if whole else (x, y))
    return got


def rings():
    rng = random.Random(5)
    comb = [p for i in range(200) for p in ((10.0 * i, 0.0), (10.0 * i + 5, 2000.0))] + [(2000.0, -5.0)]
    tangle = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(120)]
    return {"square": [(100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0)], "star": star(rng, 500, 800),
            "steps": star(rng, 300, 30, whole=True), "comb": comb, "turned comb": [(y, x) for x, y in comb], "tangle": tangle,
            "line": [(0.0, 5.0), (50.0, 5.0)], "dot": [(7.0, 7.0)],
            "closed": [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0), (0.0, 0.0)]}


@pytest.mark.parametrize("name", sorted(rings()))
def test_cells_give_the_even_odd_rule(spark, name):
    ring = rings()[name]
    rng = random.Random(9)
    top = max(max(p) for p in ring) * 1.1
    at = [(rng.uniform(-5, top), rng.uniform(-5, top)) for _ in range(1500)]
    at += [(float(round(x)), float(round(y))) for x, y in at[:300]] + ring[:200]
    at += [(p[0] + d, p[1]) for p in ring[:100] for d in (-1.0, 1.0)]
    cells = spark.createDataFrame([("S", i, float(x), float(y)) for i, (x, y) in enumerate(at)], CELL)
    regions = spark.createDataFrame([("S", 1, "in", [{"x": x, "y": y} for x, y in ring])], REGION)
    got = {r.cell_id: r.region_assigned for r in assign_regions(cells, regions).collect()}
    assert got == {i: "in" if inside(x, y, ring) else "Outside" for i, (x, y) in enumerate(at)}


def test_first_polygon_wins_and_repeats_count_once(spark):
    ring = lambda a, b: [{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    regions = spark.createDataFrame([("S", 2, "wide", ring(0.0, 5000.0)), ("S", 1, "core", ring(1000.0, 2000.0)),
                                     ("S", 1, "core", ring(1000.0, 2000.0)), ("T", 1, "none", []), ("T", 2, "null", None)], REGION)
    cells = spark.createDataFrame([("S", 1, 1500.0, 1500.0), ("S", 2, 4000.0, 100.0), ("S", 3, 6000.0, 1.0),
                                   ("T", 4, 1.0, 1.0), (None, 5, 1.0, 1.0), ("S", 6, None, 1.0)], CELL)
    got = {r.cell_id: r.region_assigned for r in assign_regions(cells, regions).collect()}
    assert got == {1: "core", 2: "wide", 3: "Outside", 4: "Outside", 5: "Outside", 6: "Outside"}
    assert assign_regions(cells.limit(0), regions).count() == 0
    assert {r.region_assigned for r in assign_regions(cells, regions.limit(0)).collect()} == {"Outside"}


def test_work_of_a_point_does_not_follow_the_vertices(spark):
    n = 100_000
    ring = [{"x": 3000 + 2900 * math.cos(2 * math.pi * i / n), "y": 3000 + 2900 * math.sin(2 * math.pi * i / n)} for i in range(n)]
    regions = spark.createDataFrame([("S", 1, "disc", ring)], REGION)
    held = F.size("edges") / 4 + F.size("turns")
    got = ring_cells(regions, ["slide_id", "ord"]).agg(F.avg(held).alias("mean"), F.max(held).alias("most"), F.count("*").alias("n")).first()
    # Where the outline runs level it stays in one row of cells longer, by the root of its length.
    assert got["mean"] <= 8 and got["most"] <= math.sqrt(n) and got["n"] <= 8 * n
    points = [("S", i, 3000 + 40 * (i % 149 - 74) + 0.3, 3000 + 40 * (i // 149 - 74) + 0.7) for i in range(149 * 149)]
    rows = assign_regions(spark.createDataFrame(points, CELL), regions).collect()
    assert {r.cell_id for r in rows if r.region_assigned == "disc"} == {
        i for _, i, x, y in points if math.hypot(x - 3000, y - 3000) < 2900 * math.cos(math.pi / n)}


def test_an_outline_is_filled_once(spark, monkeypatch):
    ring = [(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)]
    rows = [("S", i, ring) for i in (3, 9, 5)] + [("S", 7, [(x + 2, y) for x, y in ring]), ("T", 1, ring)]
    polygons = spark.createDataFrame(rows, "slide_id string, cell_id bigint, ring array<struct<x: double, y: double>>")
    seen, fill = [], placement.polygon_pixels
    monkeypatch.setattr(placement, "polygon_pixels", lambda p: seen.append(p.count()) or fill(p))
    got = {(r.slide_id, r.x, r.y): r.cell_id for r in placement.polygon_rasterize(polygons).collect()}
    want = {("S", x, y): 9 if x < 5 else 7 for x in range(1, 7) for y in range(1, 4)}
    assert seen == [3] and got == want | {("T", x, y): 1 for x in range(1, 5) for y in range(1, 4)}
