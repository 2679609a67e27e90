"""Writing measured cells, exports, splits, scores and manifest records.

Every writer goes to a path of its own and relies on Spark's commit protocol; none overwrites what
the same job reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stainframe.constants import DISCLAIMER
from stainframe.schema import CELLS, MEASURED


def cells_with_columns(cells: DataFrame, measured: DataFrame, keys: Sequence[str] = ("slide_id", "cell_id")) -> DataFrame:
    """Cell rows with the measured columns replaced by those of `measured`, in the table's order."""
    kept = [c for c in cells.columns if c not in MEASURED]
    fresh = [c for c in MEASURED if c in measured.columns]
    out = cells.select(*kept).join(measured.select(*keys, *fresh), list(keys), "left")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in CELLS.fields if f.name not in out.columns}
    return out.withColumns(missing).select("slide_id", *[F.col(f.name).cast(f.dataType) for f in CELLS.fields])


def write_cells(cells: DataFrame, path: str, files_per_slide: int | None = None) -> None:
    """Zstd Parquet partitioned by slide.

    Rows are gathered by slide and partitions evened out to the advisory size, so a giant slide is written by
    several tasks and a slide is not scattered over one file per task. With `files_per_slide` every slide is
    spread by a hash slice of the cell over that many files instead.
    """
    if files_per_slide is None:
        placed = cells.hint("rebalance", F.col("slide_id"))
    else:
        placed = cells.repartition("slide_id", F.pmod(F.xxhash64("cell_id"), F.lit(files_per_slide)))
    (placed.write.partitionBy("slide_id").option("compression", "zstd")
     .mode("errorifexists").parquet(path))


def _decimals(c: str, digits: int = 4) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.round(F.col(c) + 1e-9, digits))).otherwise(F.lit(""))


def tile_csv_rows(cells: DataFrame) -> DataFrame:
    """The eight export columns as text, four decimals, unmeasured left empty."""
    return cells.select(
        "slide_id", "tile_x", "tile_y", "cell_id", _decimals("centroid_x").alias("centroid_x"), _decimals("centroid_y").alias("centroid_y"),
        _decimals("membrane_thickness_px").alias("thickness_px"), _decimals("membrane_thickness_um").alias("thickness_um"),
        _decimals("membrane_completeness").alias("completeness"), _decimals("membrane_ring_dab").alias("dab_intensity"),
        F.col("grade").alias("composite_grade"))


def write_tile_csv(rows: DataFrame, path: str) -> None:
    """A CSV file for each tile, in a folder of its slide and tile; a tile's rows stand in order of their cells."""
    (rows.repartition("slide_id", "tile_x", "tile_y").sortWithinPartitions("slide_id", "tile_x", "tile_y", "cell_id")
     .write.partitionBy("slide_id", "tile_x", "tile_y").option("header", True).option("emptyValue", "").csv(path))


def read_tile_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `write_tile_csv`: numbers as the text that was written, unmeasured ones empty."""
    texts = ("centroid_x", "centroid_y", "thickness_px", "thickness_um", "completeness", "dab_intensity")
    schema = (f"cell_id bigint, {', '.join(f'{c} string' for c in texts)}, composite_grade int, "
              "slide_id string, tile_x bigint, tile_y bigint")
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def write_comparison_csv(comparison: DataFrame, path: str) -> None:
    """Comparison or flip rows with the disclaimer in a column of its own."""
    comparison.withColumn("disclaimer", F.lit(DISCLAIMER)).write.option("header", True).csv(path)


def summary_document(summary: DataFrame) -> DataFrame:
    """The one-row cohort summary as a nested document."""
    pick = lambda prefix: F.struct(*[F.col(c).alias(c[len(prefix):]) for c in summary.columns if c.startswith(prefix)])
    rest = [c for c in summary.columns if not c.startswith(("bl_", "co_"))]
    return summary.select(F.lit(DISCLAIMER).alias("disclaimer"), pick("bl_").alias("baseline"), pick("co_").alias("cohort"),
                          F.struct(*rest).alias("comparison"))


def write_summary_json(summary: DataFrame, path: str) -> None:
    summary_document(summary).write.json(path)


def dataset_items(items: DataFrame, name: str, modality: str = "Brightfield", stain: str = "IHC") -> DataFrame:
    """Items with the fixed dataset fields; needs `split` and `pixel_size`."""
    return items.withColumns({"parent_dataset": F.lit(name), "image_modality": F.lit(modality), "stain": F.lit(stain)})


def write_dataset_splits(items: DataFrame, path: str) -> None:
    items.write.partitionBy("split").parquet(path)


def tile_score_rows(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per tile: a column per known model in fixed order, null for absent ones, and their mean."""
    wide = scores.groupBy("tile_id").pivot("model", list(models)).agg(F.max("score"))
    mean = scores.groupBy("tile_id").agg(F.avg("score").alias("consensus_score"))
    return wide.join(mean, "tile_id")


def write_tile_scores(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def manifest_records(done: DataFrame, step: str, config_hash: str, stats: Sequence[str]) -> DataFrame:
    """Records of finished tiles: time, and figures as a map."""
    pairs = [v for s in stats for v in (F.lit(s), F.col(s).cast("double"))]
    return done.select(
        F.lit(step).alias("step"), F.lit(config_hash).alias("config_hash"), "tile_key",
        F.current_timestamp().alias("completed_at"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")).alias("stats"))


def manifest_append(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("step", "config_hash").parquet(path)
