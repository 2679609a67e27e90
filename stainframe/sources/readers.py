"""Reading cell tables, region files, baselines, tile listings and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stainframe.constants import PATIENT
from stainframe.operators.cohorts import baseline_summary
from stainframe.schema import BASELINE, CELLS, GEOJSON, nan_to_null
from stainframe.sources.listing import list_files


#: The place of a line in its files.
LINE = "_line"


def scan_cells(spark: SparkSession, folder: str, region: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells of a cohort: files `<slide>_cells.parquet`, or a table partitioned by `slide_id`.

    The schema is given, so a column a file lacks reads as null and no footer is merged. Unreadable
    files are skipped. Column and region choices reach the Parquet scan.
    """
    df = spark.read.schema(CELLS).option("ignoreCorruptFiles", True).parquet(folder)
    if "slide_id" not in df.columns:
        # A table partitioned by slide keeps the slide in its directory, plain files in their name.
        df = df.withColumn("slide_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_cells\.parquet", 1))
    if region is not None:
        df = df.filter(F.col("region") == region)
    if columns is not None:
        df = df.select("slide_id", *columns)
    return nan_to_null(df)


def clean_region_summary(raw: DataFrame, region: str = PATIENT) -> DataFrame:
    """Typed baseline rows of one region: repeated headers and rows that do not parse are dropped.

    With a column `_line` that orders the rows, the last row of each slide stays.
    """
    ints = ("total_cells", "negative", "weak_1plus", "moderate_2plus", "strong_3plus")
    floats = ("pct_positive", "h_score", "mean_dab_od")
    text = raw.select(*[F.trim(F.col(c)).alias(c) if c != LINE else F.col(c) for c in raw.columns]).filter(F.col("slide_name") != "slide_name")
    typed = text.withColumns({
        **{c: F.expr(f"try_cast({c} AS bigint)") for c in ints}, **{c: F.expr(f"try_cast({c} AS double)") for c in floats}})
    found = baseline_summary(typed.dropna(subset=[*ints, *floats]), region)
    if LINE not in raw.columns:
        return found
    # A slide given on several lines has its last one.
    names = [F.col(c) for c in found.columns if c != LINE]
    return found.groupBy("slide_name").agg(F.max_by(F.struct(*names), LINE).alias("_s")).select("_s.*")


def scan_region_summary(spark: SparkSession, path: str, region: str = PATIENT) -> DataFrame:
    """Baseline rows of one region; further fields of a line are cut off, and the last line of a slide counts.

    Lines follow one another by file, block and place in the block.
    """
    raw = (spark.read.schema(BASELINE).option("header", True).option("comment", "#").option("enforceSchema", True)
           .option("mode", "PERMISSIVE").csv(path))
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at"))
    return clean_region_summary(raw.select("*", line.alias(LINE)), region)


def scan_region_polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON feature collections, one file per slide: outer ring and class name of every polygon."""
    docs = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    name = F.col("_metadata.file_path")
    slide = F.coalesce(F.nullif(F.regexp_extract(name, r"slide_id=([^/]+)/", 1), F.lit("")),
                       F.regexp_extract(name, r"([^/]+)\.(?:geo)?json$", 1))
    feats = docs.select(slide.alias("slide_id"), F.posexplode("features").alias("ord", "f"))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), 0), lambda p: F.struct(
        F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return feats.filter(F.col("f.geometry.type") == "Polygon").select(
        "slide_id", "ord", F.coalesce(F.col("f.properties.classification.name"), F.lit("Unknown")).alias("name"),
        ring.alias("ring"))


def parse_tile_path(path: str | Column) -> list[Column]:
    """Slide and corner from `tiles/<slide>/<x>_<y>.png`."""
    p = F.col(path) if isinstance(path, str) else path
    pattern = r"([^/]+)/(\d+)_(\d+)\.[A-Za-z]+$"
    slide = F.regexp_extract(p, pattern, 1)
    x, y = F.regexp_extract(p, pattern, 2), F.regexp_extract(p, pattern, 3)
    return [slide.alias("slide_id"), x.try_cast("bigint").alias("x"), y.try_cast("bigint").alias("y"),
            F.concat(slide, F.lit("/"), x, F.lit("_"), y).alias("tile_key")]


def scan_tile_index(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles `<slide>/<x>_<y>.png` under a folder from the file listing alone, made in tasks; no image is read."""
    return list_files(spark, [folder], [".png"]).select(*parse_tile_path("path")).filter(F.col("x").isNotNull())


def list_slide_files(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str]) -> DataFrame:
    """(slide_id, path, priority, ext): files named after a slide in any of `roots`, the first of which comes first."""
    return list_files(spark, list(roots), list(extensions)).select(F.col("stem").alias("slide_id"), "path", "priority", "ext")


def pair_tiles_with_masks(tiles: DataFrame, nuclei: DataFrame, cells: DataFrame, key: str = "tile_key") -> tuple[DataFrame, DataFrame]:
    """Tiles that have both masks, and the tiles that lack one, saying which."""
    n = nuclei.select(key).distinct().withColumn("has_nucleus_mask", F.lit(True))
    c = cells.select(key).distinct().withColumn("has_cell_mask", F.lit(True))
    flagged = tiles.join(n, key, "left").join(c, key, "left").fillna(False, ["has_nucleus_mask", "has_cell_mask"])
    both = F.col("has_nucleus_mask") & F.col("has_cell_mask")
    return flagged.filter(both).drop("has_nucleus_mask", "has_cell_mask"), flagged.filter(~both)


def slide_pixel_size(items: DataFrame, slides: DataFrame, default: float = 0.5) -> DataFrame:
    """Microns per pixel of each item's slide; the join side is chosen by Spark from its real size."""
    known = slides.select("slide_id", F.coalesce("pixel_size", "mpp").alias("_mpp"))
    return items.join(known, "slide_id", "left").withColumn("pixel_size", F.coalesce("_mpp", F.lit(default))).drop("_mpp")


def resolve_slide_path(slides: DataFrame, files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Best file of each slide: directory priority, then extension order; none found reads null.

    `files`: `slide_id, path, priority, ext`.
    """
    place = F.create_map(*[v for i, e in enumerate(extensions) for v in (F.lit(e), F.lit(i))])[F.col("ext")]
    best = files.filter(place.isNotNull()).groupBy("slide_id").agg(
        F.min_by("path", F.struct(F.col("priority"), place, F.col("path"))).alias("path"))
    return slides.select("slide_id").distinct().join(best, "slide_id", "left").withColumn("resolved", F.col("path").isNotNull())


def scan_membrane_index(tiles: DataFrame, index: DataFrame) -> DataFrame:
    """Membrane fraction of each tile; a tile the index lacks has none."""
    return tiles.join(index.select("tile_key", "fraction"), "tile_key", "left").withColumn(
        "fraction", F.coalesce("fraction", F.lit(0.0)))


def skip_processed_slides(slides: DataFrame, done: DataFrame) -> DataFrame:
    return slides.join(done.select("slide_id"), "slide_id", "left_anti")


def processing_status_summary(results: DataFrame) -> DataFrame:
    """Slides per status and the share of cells measured; every error text counts as one status."""
    status = F.when(F.col("status").startswith("error"), "error").otherwise(F.col("status"))
    return results.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n_slides"), F.sum("n_cells").alias("n_cells"), F.sum("n_measured").alias("n_measured"),
        F.coalesce(F.try_divide(F.sum("n_measured").cast("double"), F.sum("n_cells")), F.lit(0.0)).alias("measured_rate"))


# ---- manifest ---------------------------------------------------------------------------------------


def _of(manifest: DataFrame, config_hash: str, step: str | None) -> DataFrame:
    """Records of one configuration and, if it is named, one step."""
    own = manifest.filter(F.col("config_hash") == config_hash)
    return own if step is None else own.filter(F.col("step") == step)


def manifest_pending(
    tiles: DataFrame, manifest: DataFrame, config_hash: str, key: str = "tile_key", step: str | None = None
) -> DataFrame:
    """Tiles with no record of `step` under this configuration; another configuration's records do not count.

    Without a step, for a manifest of one step only, a record of any step counts.
    """
    return tiles.join(_of(manifest, config_hash, step).select(key), key, "left_anti")


def manifest_stats(manifest: DataFrame, config_hash: str, step: str | None = None) -> DataFrame:
    """Recorded figures of finished tiles, one row per tile and name."""
    return _of(manifest, config_hash, step).filter(F.col("stats").isNotNull()).select(
        "tile_key", F.explode("stats").alias("name", "value"))


def latest_records(manifest: DataFrame) -> DataFrame:
    """The last record of each tile, step and configuration; appends may repeat a tile after a lost write.

    Of records of the same time the one whose figures come last as text stays.
    """
    keys = [k for k in ("step", "config_hash", "tile_key") if k in manifest.columns]
    ties = [F.desc(F.to_json("stats"))] if "stats" in manifest.columns else []
    last = Window.partitionBy(*keys).orderBy(F.desc("completed_at"), *ties)
    return manifest.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") == 1).drop("_rn")


def config_stamp(params: dict[str, str | Column]) -> Column:
    """First 12 hex digits of the SHA-256 of the parameters as JSON, keys sorted, `, ` and `: ` between."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(params)):
        value = params[name]
        value = F.col(value) if isinstance(value, str) else value
        # to_json quotes and escapes the value; its one-field wrapper is cut off.
        json = F.to_json(F.struct(value.alias("v")))
        parts += [F.lit(("" if i == 0 else ", ") + f'"{name}": '), F.substring(json, F.lit(6), F.length(json) - 6)]
    return F.substring(F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256), 1, 12)
