"""Tiling, sampling, split and placement queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stainframe.operators import placement as P
from stainframe.operators import tiling as T
from stainframe.verify.registry import query, rounded

BEST = """
best AS (SELECT slide_id, width, height, base_mpp, l.level AS level, l.downsample AS downsample,
  row_number() OVER (PARTITION BY slide_id ORDER BY abs(base_mpp * l.downsample - 0.5), l.level) AS a,
  row_number() OVER (PARTITION BY slide_id ORDER BY CASE WHEN base_mpp * l.downsample <= 0.5 * 1.2 THEN 0 ELSE 1 END,
    CASE WHEN base_mpp * l.downsample <= 0.5 * 1.2 THEN -l.level ELSE l.level END) AS b
  FROM (SELECT *, unnest(levels) AS l FROM slides) s)"""


@query("best_level", f"""WITH {BEST}
SELECT x.slide_id, x.level AS nearest_level, round(x.base_mpp * x.downsample, 6) AS nearest_mpp, y.level AS last_level
FROM best x JOIN best y USING (slide_id) WHERE x.a = 1 AND y.b = 1""")
def _(t):
    near = T.best_level(t.slides).select("slide_id", F.col("level").alias("nearest_level"), F.col("mpp").alias("nearest_mpp"))
    last = T.best_level(t.slides, rule="last").select("slide_id", F.col("level").alias("last_level"))
    return rounded(near.join(last, "slide_id"))


GRID = """
grid AS (SELECT slide_id, CAST(gx.i * 352 AS BIGINT) AS x_l0, CAST(gy.i * 352 AS BIGINT) AS y_l0 FROM slides, range(12) gx(i), range(12) gy(i)
  WHERE gx.i * 352 <= width - 512 AND gy.i * 352 <= height - 512)"""


@query("tile_grid", f"WITH {GRID} SELECT * FROM grid")
def _(t):
    return T.tile_grid(t.slides.withColumn("downsample", F.lit(1.0))).select("slide_id", "x_l0", "y_l0")


OVERLAP = f"""{GRID}, overlap AS (
  SELECT g.slide_id, x_l0, y_l0, avg(CASE WHEN tissue THEN 1.0 ELSE 0.0 END) AS tissue FROM grid g JOIN thumbs m
    ON g.slide_id = m.slide_id AND tx >= floor(x_l0 / 64) AND tx < floor((x_l0 + 512) / 64) AND ty >= floor(y_l0 / 64) AND ty < floor((y_l0 + 512) / 64)
  GROUP BY ALL)"""


@query("tile_tissue_overlap", f"WITH {OVERLAP} SELECT slide_id, x_l0, y_l0, round(tissue, 6) AS tissue FROM overlap WHERE tissue >= 0.05")
def _(t):
    tiles = T.tile_grid(t.slides.withColumn("downsample", F.lit(1.0)))
    return rounded(T.tile_tissue_overlap(tiles, t.thumbs).filter("tissue >= 0.05"))


@query("tile_bins", "SELECT cell_id, CAST(floor(centroid_x / 704) AS BIGINT) AS tile_x, CAST(floor(centroid_y / 704) AS BIGINT) AS tile_y FROM cells")
def _(t):
    return T.tile_bins(t.cells).select("cell_id", "tile_x", "tile_y")


@query("tile_grade_stats", "SELECT slide_id, tile_x, tile_y, n_cells, round(mean_grade, 6) AS mean_grade, " + ", ".join(
    f"round(CAST(100 AS DOUBLE) * n{g} / n_cells, 6) AS grade_{g}_pct" for g in range(4)) + " FROM tile_grades")
def _(t):
    return rounded(T.tile_grade_stats(T.tile_bins(t.graded)))


def md5_of(*cols: str, seed: int = 42) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


@query("sample_slides", f"SELECT slide_id FROM slides ORDER BY {md5_of('slide_id')}, slide_id LIMIT 15")
def _(t):
    return T.sample_slides(t.slides, 15).select("slide_id")


@query("sample_tiles_per_slide", f"""SELECT slide_id, tile_key FROM
(SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY {md5_of('tile_key')}, tile_key) AS rn FROM tiles) t WHERE rn <= 100""")
def _(t):
    return T.sample_per_group(t.tiles, ["slide_id"], 100, "tile_key").select("slide_id", "tile_key")


SPLIT = f"""
s AS (SELECT slide_id, row_number() OVER (ORDER BY {md5_of('slide_id')}, slide_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT slide_id FROM items) d),
z AS (SELECT *, greatest(1, CAST(round_even(n * 0.7, 0) AS BIGINT)) AS a, greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT)) AS b FROM s),
split AS (SELECT item_id, slide_id, image, CASE WHEN r < a THEN 'Train' WHEN r < a + b THEN 'Validation' ELSE 'Test' END AS split FROM items JOIN z USING (slide_id))"""


@query("split_by_slide", f"WITH {SPLIT} SELECT item_id, slide_id, split FROM split")
def _(t):
    return T.split_by_slide(t.items).select("item_id", "slide_id", "split")


@query("split_by_slide_int", f"""WITH s AS (SELECT slide_id, row_number() OVER (ORDER BY {md5_of('slide_id')}, slide_id) - 1 AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT slide_id FROM items) d)
SELECT item_id, slide_id, CASE WHEN r < floor(n * 0.7) THEN 'Train' WHEN r < floor(n * 0.7) + floor(n * 0.15) THEN 'Validation' ELSE 'Test' END AS split
FROM items JOIN s USING (slide_id)""")
def _(t):
    return T.split_by_slide(t.items, rule="int").select("item_id", "slide_id", "split")


@query("cap_per_slide", f"""WITH {SPLIT} SELECT item_id, split FROM (SELECT *,
  row_number() OVER (PARTITION BY split, slide_id ORDER BY {md5_of('item_id')}, item_id) AS rn FROM split) q WHERE rn <= 50""")
def _(t):
    return T.sample_per_group(T.split_by_slide(t.items), ["split", "slide_id"], 50, "item_id").select("item_id", "split")


ROWS = f"""
rows_ AS (SELECT item_id, slide_id, CASE WHEN row_number() OVER (ORDER BY {md5_of('item_id')}, item_id) <= count(*) OVER () - greatest(1, CAST(floor((count(*) OVER ()) * 0.15) AS BIGINT))
  THEN 'train' ELSE 'validation' END AS split FROM items)"""


@query("split_by_row", f"WITH {ROWS} SELECT item_id, split FROM rows_")
def _(t):
    return T.split_by_row(t.items, "item_id").select("item_id", "split")


@query("split_leakage_check", f"WITH {ROWS} SELECT slide_id, count(DISTINCT split) AS n_splits FROM rows_ GROUP BY slide_id HAVING count(DISTINCT split) > 1")
def _(t):
    return T.split_leakage_check(T.split_by_row(t.items, "item_id"))


@query("drop_zero_cell_tiles", "SELECT tile_key FROM tiles WHERE tile_key NOT IN (SELECT tile_key FROM manifest WHERE num_cells % 7 = 0 OR num_cells % 5 = 0)")
def _(t):
    m = t.manifest.select("tile_key", (F.col("num_cells") % 7).alias("num_cells"), (F.col("num_cells") % 5).alias("kept_instances"))
    return T.drop_zero_cell_tiles(t.tiles, m).select("tile_key")


@query("evenly_spaced_tiles", """
WITH v AS (SELECT *, row_number() OVER (ORDER BY mean_grade, slide_id, tile_x, tile_y) - 1 AS rank, count(*) OVER () AS m FROM tile_grades WHERE n_cells >= 4)
SELECT slide_id, tile_x, tile_y, n_cells, round(mean_grade, 6) AS mean_grade, rank FROM v
WHERE rank IN (SELECT floor(i * ((SELECT max(m) FROM v) - 1) / CAST(29 AS DOUBLE) + 1e-9) FROM range(30) r(i))""")
def _(t):
    return rounded(T.evenly_spaced_tiles(t.tile_grades, 30, 4).select(
        "slide_id", "tile_x", "tile_y", "n_cells", "mean_grade", "rank"))


STRAT = """
v AS (SELECT * FROM tile_grades WHERE n_cells >= 3),
q AS (SELECT quantile_cont(mean_grade, 0.333) AS lo, quantile_cont(mean_grade, 0.667) AS hi FROM v),
c AS (SELECT v.*, CASE WHEN mean_grade >= hi THEN 'high' WHEN mean_grade <= lo THEN 'low' ELSE 'mid' END AS category FROM v, q),
k AS (SELECT category, slide_id, row_number() OVER (PARTITION BY category ORDER BY slide_id) - 1 AS i, count(*) OVER (PARTITION BY category) AS k FROM (SELECT DISTINCT category, slide_id FROM c) d),
r AS (SELECT c.*, row_number() OVER (PARTITION BY category, slide_id ORDER BY mean_grade, tile_x, tile_y) - 1 AS rank, count(*) OVER (PARTITION BY category, slide_id) AS sz FROM c),
t AS (SELECT r.*, i, least(sz, greatest(1, 50 // k) + CASE WHEN i < 50 - greatest(1, 50 // k) * k THEN 1 ELSE 0 END) AS take FROM r JOIN k USING (category, slide_id)),
f AS (SELECT t.*, CASE WHEN sz <= take THEN TRUE WHEN take <= 1 THEN rank = 0
  ELSE list_contains([CAST(floor(j * (sz - 1) / CAST(take - 1 AS DOUBLE) + 1e-9) AS BIGINT) for j in range(take)], rank) END AS hit FROM t),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN i ELSE 0 END,
  CASE WHEN hit THEN rank ELSE 0 END, """ + md5_of("slide_id", "tile_x", "tile_y") + """, slide_id, tile_x, tile_y) AS rn FROM f) z WHERE rn <= 50)"""


@query("stratified_tiles", f"WITH {STRAT} SELECT category, slide_id, tile_x, tile_y, n_cells, round(mean_grade, 6) AS mean_grade FROM chosen")
def _(t):
    return rounded(T.stratified_tiles(t.tile_grades, 50, 3).select(
        "category", "slide_id", "tile_x", "tile_y", "n_cells", "mean_grade"))


@query("category_summary", f"""WITH {STRAT} SELECT category, count(*) AS n_tiles, CAST(sum(n_cells) AS BIGINT) AS total_cells, round(min(mean_grade), 6) AS min_grade,
  round(max(mean_grade), 6) AS max_grade, round(avg(mean_grade), 6) AS avg_grade, """ + ", ".join(
    f"CAST(sum(n{g}) AS BIGINT) AS grade_{g}" for g in range(4)) + ", count(DISTINCT slide_id) AS n_slides FROM chosen GROUP BY category")
def _(t):
    return rounded(T.category_summary(T.stratified_tiles(t.tile_grades, 50, 3)))


@query("weighted_resample", """
WITH w AS (SELECT item_id, CAST(round(greatest(CAST(p_size AS DOUBLE) / 100, 0.01) * 1000000) AS BIGINT) AS w FROM items),
r AS (SELECT item_id, CAST(sum(w) OVER (ORDER BY item_id) AS BIGINT) AS hi, w, row_number() OVER (ORDER BY item_id) AS pos, CAST(sum(w) OVER () AS BIGINT) AS total FROM w),
d AS (SELECT pos AS draw, CAST(floor(CAST(('0x' || substr(md5(concat_ws(':', '42', CAST(pos AS VARCHAR))), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) * total) AS BIGINT) AS pt FROM r)
SELECT draw, item_id FROM d JOIN r ON pt >= hi - w AND pt < hi""")
def _(t):
    return T.weighted_resample(t.items.withColumn("f", F.col("p_size") / 100), "item_id", "f")


@query("shard_slides", "SELECT slide_id, (row_number() OVER (ORDER BY slide_id) - 1) % 4 AS shard FROM (SELECT DISTINCT slide_id FROM items) d")
def _(t):
    return T.shard_slides(t.items, 4)


@query("concat_slides", """SELECT slide_id, tile_x, tile_y, n_cells, CAST(NULL AS DOUBLE) AS mean_grade FROM tile_grades WHERE n_cells < 3
UNION ALL SELECT slide_id, tile_x, tile_y, n_cells, round(mean_grade, 6) FROM tile_grades WHERE n_cells >= 3""")
def _(t):
    few = t.tile_grades.filter("n_cells < 3").select("slide_id", "tile_x", "tile_y", "n_cells")
    many = t.tile_grades.filter("n_cells >= 3").select("slide_id", "tile_x", "tile_y", "n_cells", "mean_grade")
    return rounded(T.per_slide_table([few, many]))


@query("slide_key_union", """SELECT slide_id, count(DISTINCT src) = 2 AS matched FROM
(SELECT slide_name AS slide_id, 1 AS src FROM baseline UNION ALL SELECT slide_id, 2 FROM cells) u GROUP BY slide_id""")
def _(t):
    return T.slide_key_union(t.baseline.withColumnRenamed("slide_name", "slide_id"), t.cells)


@query("region_value_counts", "SELECT slide_id, region, count(*) AS n FROM cells GROUP BY slide_id, region")
def _(t):
    return T.value_counts(t.cells, "region", ["slide_id"])


@query("dedup_hybrid", """SELECT cell_id FROM cells c WHERE is_center OR NOT EXISTS (SELECT 1 FROM cells o WHERE o.is_center AND o.slide_id = c.slide_id
  AND pow(o.centroid_x - c.centroid_x, 2) + pow(o.centroid_y - c.centroid_y, 2) <= 22500)""")
def _(t):
    return P.dedup_hybrid(t.cells, 150.0).select("cell_id")


@query("nearest_match_rate", """
WITH f AS (SELECT slide_id, EXISTS (SELECT 1 FROM cells o WHERE o.is_center AND o.slide_id = c.slide_id
  AND pow(o.centroid_x - c.centroid_x, 2) + pow(o.centroid_y - c.centroid_y, 2) < 14400) AS near FROM cells c WHERE NOT is_center)
SELECT slide_id, count(*) AS n_cells, count(*) FILTER (WHERE near) AS n_matched, round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END), 6) AS match_rate
FROM f GROUP BY ROLLUP (slide_id)""")
def _(t):
    c = t.cells.select("slide_id", "is_center", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    return rounded(P.nearest_match_rate(c.filter("NOT is_center"), c.filter("is_center"), ["slide_id"], 120.0))


@query("assign_regions", """
WITH e AS (SELECT slide_id, ord, name, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM regions) r),
h AS (SELECT c.cell_id, e.ord, e.name FROM cells c JOIN e USING (slide_id)
  WHERE (e.a.y > c.centroid_y) <> (e.b.y > c.centroid_y) AND c.centroid_x < e.a.x + (c.centroid_y - e.a.y) * (e.b.x - e.a.x) / (e.b.y - e.a.y)
  GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT c.slide_id, c.cell_id, coalesce(arg_min(h.name, h.ord), 'Outside') AS region_assigned FROM cells c LEFT JOIN h USING (cell_id) GROUP BY ALL""")
def _(t):
    return P.assign_regions(t.cells, t.regions)


@query("polygon_rasterize", """
WITH e AS (SELECT slide_id, cell_id, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM polygons) r),
px AS (SELECT e.cell_id, e.slide_id, e.a.x AS ax, e.a.y AS ay, e.b.x AS bx, e.b.y AS by_, y.y AS y FROM e, LATERAL (SELECT unnest(range(CAST(ceil(least(e.a.y, e.b.y)) AS BIGINT), CAST(floor(greatest(e.a.y, e.b.y)) AS BIGINT) + 1)) AS y) y),
cr AS (SELECT slide_id, cell_id, y, list_sort(list(ax + (y - ay) * (bx - ax) / (by_ - ay))) AS xs FROM px WHERE (ay > y) <> (by_ > y) GROUP BY ALL),
f AS (SELECT slide_id, cell_id, y, unnest(range(CAST(ceil(xs[1]) AS BIGINT), CAST(ceil(xs[2]) AS BIGINT))) AS x FROM cr)
SELECT slide_id, x, y, max(cell_id) AS cell_id FROM f WHERE x >= 0 AND y >= 0 GROUP BY ALL""")
def _(t):
    return P.polygon_rasterize(t.polygons)
