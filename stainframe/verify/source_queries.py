"""Source, sink, manifest and whole-job queries and their SQL twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from stainframe.constants import DISCLAIMER
from stainframe.operators import cohorts as C
from stainframe.operators import scoring as S
from stainframe.operators import tiling as T
from stainframe.plans import jobs
from stainframe.schema import CELLS
from stainframe.sources import manifest as V
from stainframe.sources import readers as R
from stainframe.sources import sinks as K
from stainframe.sources.listing import touch
from stainframe.verify.cohort_queries import comparison
from stainframe.verify.pixel_queries import EXTENT
from stainframe.verify.registry import ORACLE, QUERIES, query, rounded
from stainframe.verify.tiling_queries import SPLIT


def scratch(spark, name: str) -> str:
    """A new folder all executors share: under the session's checkpoint folder, else local to a local run."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    base = shared or tempfile.mkdtemp(prefix="stainframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_cells(t) -> str:
    path = scratch(t.spark, "cells")
    have = [F.col(f.name) if f.name in t.cells.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CELLS.fields]
    K.write_cells(t.cells.select("slide_id", *have), path)
    return path


@query("scan_cells", "SELECT slide_id, cell_id, region, round(membrane_ring_dab, 6) AS membrane_ring_dab, round(area_um2, 6) AS area_um2 FROM cells")
def _(t):
    return rounded(R.scan_cells(t.spark, written_cells(t)).select("slide_id", "cell_id", "region", "membrane_ring_dab", "area_um2"))


@query("scan_cells_projected", "SELECT slide_id, cell_id, round(centroid_x, 6) AS centroid_x FROM cells WHERE region = 'Patient_Tissue'")
def _(t):
    return rounded(R.scan_cells(t.spark, written_cells(t), "Patient_Tissue", ["cell_id", "centroid_x"]))


@query("scan_region_summary", """SELECT slide_name, region, total_cells, negative, weak_1plus, moderate_2plus, strong_3plus, round(pct_positive, 6) AS pct_positive, round(h_score, 6) AS h_score,
round(mean_dab_od, 6) AS mean_dab_od, round(100 * CAST(moderate_2plus + strong_3plus AS DOUBLE) / total_cells, 6) AS pct_2plus, 100 * CAST(moderate_2plus + strong_3plus AS DOUBLE) / total_cells >= 75 AS eligible
FROM baseline WHERE region = 'Patient_Tissue'""")
def _(t):
    path = scratch(t.spark, "baseline")
    t.baseline.write.option("header", True).csv(path)
    return rounded(R.scan_region_summary(t.spark, path))


@query("scan_region_polygons", """SELECT slide_id, ord, name, len(ring) AS n_points, round(list_sum(list_transform(ring, lambda p: p.x)), 6) AS sum_x FROM regions""")
def _(t):
    path = scratch(t.spark, "regions")
    feature = F.struct(
        F.struct(F.struct("name").alias("classification")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates")).alias("geometry"))
    # Three polygons per slide.
    docs = t.regions.groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct("ord", feature.alias("f")))).alias("a"))
    docs = docs.select("slide_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("a", lambda e: e["f"]).alias("features"))).alias("value"))
    docs.repartition("slide_id").write.partitionBy("slide_id").text(path)
    got = R.scan_region_polygons(t.spark, path)
    return rounded(got.select("slide_id", "ord", "name", F.size("ring").cast("bigint").alias("n_points"),
                              F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x")))


@query("scan_tile_index", r"""SELECT regexp_extract(image, '([^/]+)/(\d+)_(\d+)\.[A-Za-z]+$', 1) AS slide_id, CAST(regexp_extract(image, '([^/]+)/(\d+)_(\d+)\.[A-Za-z]+$', 2) AS BIGINT) AS x,
CAST(regexp_extract(image, '([^/]+)/(\d+)_(\d+)\.[A-Za-z]+$', 3) AS BIGINT) AS y, regexp_extract(image, '([^/]+/\d+_\d+)\.[A-Za-z]+$', 1) AS tile_key FROM items""")
def _(t):
    root = scratch(t.spark, "tiles")
    touch(t.items.select(F.col("image").alias("path")), root)
    return R.scan_tile_index(t.spark, root)


def masks(t):
    return t.tiles, t.tiles.filter("tile_x % 5 <> 0"), t.tiles.filter("tile_y % 7 <> 0")


@query("pair_tiles_with_masks", "SELECT tile_key FROM tiles WHERE tile_x % 5 <> 0 AND tile_y % 7 <> 0")
def _(t):
    return R.pair_tiles_with_masks(*masks(t))[0].select("tile_key")


@query("pair_tiles_missing", "SELECT tile_key, tile_x % 5 <> 0 AS has_nucleus_mask, tile_y % 7 <> 0 AS has_cell_mask FROM tiles WHERE NOT (tile_x % 5 <> 0 AND tile_y % 7 <> 0)")
def _(t):
    return R.pair_tiles_with_masks(*masks(t))[1].select("tile_key", "has_nucleus_mask", "has_cell_mask")


@query("slide_pixel_size", """SELECT item_id, round(coalesce(CASE WHEN k % 3 = 0 THEN NULL ELSE 0.2 + k * 0.01 END, CASE WHEN k % 2 = 0 THEN 0.46 END, 0.5), 6) AS pixel_size
FROM items LEFT JOIN (SELECT DISTINCT concat('S', lpad(CAST(s_suppkey % 30 AS VARCHAR), 2, '0')) AS slide_id, s_suppkey % 30 AS k FROM supplier) s USING (slide_id)""")
def _(t):
    s = t.supplier.selectExpr("concat('S', lpad(cast(s_suppkey % 30 as string), 2, '0')) AS slide_id", "s_suppkey % 30 AS k").distinct()
    s = s.selectExpr("slide_id", "CASE WHEN k % 3 = 0 THEN NULL ELSE 0.2D + k * 0.01D END AS pixel_size", "CASE WHEN k % 2 = 0 THEN 0.46D END AS mpp")
    return rounded(R.slide_pixel_size(t.items, s).select("item_id", "pixel_size"))


@query("sink_cells_with_columns", """SELECT slide_id, count(*) AS n_cells, round(sum(raw_membrane_dab), 4) AS sum_ring, count(membrane_completeness) AS n_complete, count(area_um2) AS n_area FROM cells GROUP BY slide_id""")
def _(t):
    path = scratch(t.spark, "measured")
    fresh = t.cells.select("slide_id", "cell_id", F.col("raw_membrane_dab").alias("membrane_ring_dab"), "membrane_completeness")
    K.write_cells(K.cells_with_columns(t.cells, fresh), path, 2)
    back = R.scan_cells(t.spark, path)
    return back.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("membrane_ring_dab"), 4).alias("sum_ring"),
        F.count("membrane_completeness").alias("n_complete"), F.count("area_um2").alias("n_area"))


def _dec(c: str) -> str:
    return f"coalesce(printf('%.4f', round({c} + 1e-9, 4)), '')"


# Tiles of four by four, so that the smallest data too have more cells than files.
@query("sink_tile_csv", f"""SELECT slide_id, CAST(floor(centroid_x / 2816) AS BIGINT) AS tile_x, CAST(floor(centroid_y / 2816) AS BIGINT) AS tile_y, cell_id, {_dec('centroid_x')} AS centroid_x, {_dec('centroid_y')} AS centroid_y,
{_dec('membrane_thickness_px')} AS thickness_px, {_dec('membrane_thickness_px * 0.5')} AS thickness_um, {_dec('membrane_completeness')} AS completeness, {_dec('membrane_ring_dab')} AS dab_intensity, grade AS composite_grade FROM graded""")
def _(t):
    cells = T.tile_bins(t.graded, 8.0).withColumn("membrane_thickness_um", F.col("membrane_thickness_px") * 0.5)
    path = scratch(t.spark, "tile-csv")
    K.write_tile_csv(K.tile_csv_rows(cells), path)
    return K.read_tile_csv(t.spark, path)


@query("sink_comparison_csv")
def _(t):
    path = scratch(t.spark, "comparison")
    rows = QUERIES["compare_cohorts"](t.spark, t.path)
    K.write_comparison_csv(rows, path)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = t.spark.read.option("header", True).csv(path).columns
    return t.spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in head)).option("header", True).csv(path)


# The twins of the queries that were written, with the column that writing adds.
ORACLE["sink_comparison_csv"] = f"SELECT *, '{DISCLAIMER}' AS disclaimer FROM ({ORACLE['compare_cohorts']}) s"
ORACLE["sink_summary_json"] = f"SELECT '{DISCLAIMER}' AS disclaimer, bl_slides AS slides, co_cells AS cells, n_matched, n_gained FROM ({ORACLE['cohort_summary']}) s"


@query("sink_summary_json")
def _(t):
    path = scratch(t.spark, "summary")
    K.write_summary_json(rounded(C.cohort_summary(rounded(comparison(t)))), path)
    back = t.spark.read.json(path)
    return back.select("disclaimer", "baseline.slides", "cohort.cells", "comparison.n_matched", "comparison.n_gained")


@query("sink_dataset_splits", f"""WITH {SPLIT} SELECT item_id, image, split, 'brightfield' AS parent_dataset, 'Brightfield' AS image_modality, 'IHC' AS stain, CAST(0.5 AS DOUBLE) AS pixel_size FROM split""")
def _(t):
    path = scratch(t.spark, "splits")
    items = T.split_by_slide(t.items).withColumn("pixel_size", F.lit(0.5))
    K.write_dataset_splits(K.dataset_items(items, "brightfield"), path)
    return t.spark.read.parquet(path).select("item_id", "image", "split", "parent_dataset", "image_modality", "stain", "pixel_size")


@query("manifest_pending", "SELECT tile_key FROM tiles WHERE tile_key NOT IN (SELECT tile_key FROM manifest WHERE config_hash = 'h1')")
def _(t):
    return R.manifest_pending(t.tiles, t.manifest, "h1").select("tile_key")


@query("manifest_append", "SELECT tile_key, round(CAST(tile_x + tile_y AS DOUBLE), 6) AS value FROM tiles WHERE tile_x % 3 = 0")
def _(t):
    path = scratch(t.spark, "manifest")
    done = t.tiles.withColumn("num_cells", F.col("tile_x") + F.col("tile_y"))
    for part in ("tile_x % 3 = 0 AND tile_y % 2 = 0", "tile_x % 3 = 0 AND tile_y % 2 = 1"):
        K.manifest_append(K.manifest_records(done.filter(part), "labels", "h1", ["num_cells"]), path)
    return rounded(R.manifest_stats(R.latest_records(t.spark.read.parquet(path)), "h1").select("tile_key", "value"))


@query("manifest_versions", "SELECT tile_key, round(CAST(CASE WHEN tile_x % 3 = 0 THEN tile_x + tile_y ELSE tile_y END AS DOUBLE), 6) AS value FROM tiles WHERE tile_x % 3 < 2")
def _(t):
    """Two writers, a version rewritten, a writer that never publishes: `tile_x % 3 = 0` is recorded twice, the later record counts."""
    path = scratch(t.spark, "versions")
    records = lambda df, value: K.manifest_records(df.withColumn("num_cells", value), "labels", "h1", ["num_cells"])
    V.append(records(t.tiles.filter("tile_x % 3 < 2"), F.col("tile_y")), path)
    V.append(records(t.tiles.filter("tile_x % 3 = 0"), F.col("tile_x") + F.col("tile_y")), path)
    V.stage(records(t.tiles, F.lit(-1)), path)
    V.compact(t.spark, path)
    return rounded(R.manifest_stats(V.read(t.spark, path), "h1").select("tile_key", "value"))


@query("manifest_stats", "SELECT tile_key, 'num_cells' AS name, round(num_cells, 6) AS value FROM manifest WHERE config_hash = 'h0' AND num_cells IS NOT NULL")
def _(t):
    m = t.manifest.withColumn("stats", F.when(F.col("num_cells").isNotNull(), F.create_map(F.lit("num_cells"), F.col("num_cells"))))
    return rounded(R.manifest_stats(m, "h0"))


@query("config_stamp", """SELECT item_id, substr(sha256('{"brand": "' || p_brand || '", "size": ' || CAST(p_size AS VARCHAR) || ', "slide": "' || slide_id || '"}'), 1, 12) AS stamp FROM items""")
def _(t):
    return t.items.select("item_id", R.config_stamp({"size": "p_size", "brand": "p_brand", "slide": "slide_id"}).alias("stamp"))


@query("skip_processed_slides", "SELECT DISTINCT slide_id FROM slides WHERE slide_id NOT IN (SELECT slide_id FROM slides WHERE width = 3500)")
def _(t):
    return R.skip_processed_slides(t.slides.select("slide_id").distinct(), t.slides.filter("width = 3500"))


FILES = """files AS (SELECT slide_id, concat('/dir', CAST(d AS VARCHAR), '/', slide_id, ext) AS path, d AS priority, ext FROM (SELECT *, CAST(substr(slide_id, 2) AS BIGINT) AS i FROM slides) s,
(VALUES (0, '.svs', 3), (0, '.tif', 5), (1, '.svs', 2), (1, '.txt', 1)) v(d, ext, m) WHERE i % m = 0)"""


@query("resolve_slide_path", f"WITH {FILES} SELECT s.slide_id, b.path, b.path IS NOT NULL AS resolved FROM slides s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY priority, CASE ext WHEN '.svs' THEN 0 ELSE 1 END, path) AS rn FROM files WHERE ext <> '.txt') q WHERE rn = 1) b USING (slide_id)")
def _(t):
    root, i = scratch(t.spark, "slides"), F.substring("slide_id", 2, 9).cast("bigint")
    v = F.inline(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(e).alias("ext"), F.lit(m).alias("m")) for d, e, m in ((0, ".svs", 3), (0, ".tif", 5), (1, ".svs", 2), (1, ".txt", 1))]))
    there = t.slides.select("slide_id", i.alias("i"), v).filter("i % m = 0")
    touch(there.select(F.concat(F.lit("dir"), "d", F.lit("/"), "slide_id", "ext").alias("path")), root)
    # A third root does not exist.
    files = R.list_slide_files(t.spark, [f"{root}/dir{d}" for d in (0, 1, 2)], [".svs", ".tif"])
    found = R.resolve_slide_path(t.slides, files, [".svs", ".tif"])
    return found.withColumn("path", F.regexp_extract("path", r"(/dir\d+/[^/]+)$", 1)).withColumn("path", F.when(F.col("resolved"), F.col("path")))


@query("scan_membrane_index", "SELECT tile_key, round(CASE WHEN tile_x % 2 = 0 THEN CAST(tile_y AS DOUBLE) / 100 ELSE 0 END, 6) AS fraction FROM tiles")
def _(t):
    index = t.tiles.filter("tile_x % 2 = 0").select("tile_key", (F.col("tile_y") / 100).alias("fraction"))
    return rounded(R.scan_membrane_index(t.tiles, index).select("tile_key", "fraction"))


STATUS = "CASE s_suppkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'already_done' WHEN 2 THEN 'slide_not_found' WHEN 3 THEN 'error_open' ELSE 'error_read' END"


@query("processing_status_summary", f"""SELECT CASE WHEN st LIKE 'error%' THEN 'error' ELSE st END AS status, count(*) AS n_slides, CAST(sum(n) AS BIGINT) AS n_cells, CAST(sum(m) AS BIGINT) AS n_measured, round(coalesce(CAST(sum(m) AS DOUBLE) / nullif(sum(n), 0), 0), 6) AS measured_rate
FROM (SELECT {STATUS} AS st, s_suppkey * 10 AS n, CASE WHEN s_suppkey % 5 < 2 THEN s_suppkey * 7 ELSE 0 END AS m FROM supplier) z GROUP BY 1""")
def _(t):
    r = t.supplier.selectExpr(f"{STATUS} AS status", "s_suppkey * 10 AS n_cells", "CASE WHEN s_suppkey % 5 < 2 THEN s_suppkey * 7 ELSE 0 END AS n_measured")
    return rounded(R.processing_status_summary(r))


@query("labels_from_pixels")
def _(t):
    return rounded(jobs.label_cells(t.pixels.select("slide_id", "tile_id", "x", "y", "r", "g", "b", "nuc_id"), 20, EXTENT).groupBy(
        "slide_id", "tile_id").agg(F.count_distinct(F.when(F.col("cell_id") > 0, F.col("cell_id"))).alias("n_cells"),
                                   F.count_if(F.col("cell_id") > 0).alias("cell_px")))


@query("measured_cells")
def _(t):
    return rounded(jobs.measure_cells(t.pixels.drop("bar", "prob", "pred_id"), 0.5, EXTENT))
