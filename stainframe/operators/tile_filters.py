"""Tile scores and the keep-lists of tiles and cells built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainframe.constants import DAB_POSITIVE
from stainframe.functions.lineage import by_merge
from stainframe.operators.instances import cell_density, nucleus_ring_score
from stainframe.operators.pixels import TILE, gray8, hsv_saturation_mean
from stainframe.operators.rasters import laplacian_variance


def tile_epithelial_proxy(pixels: DataFrame) -> DataFrame:
    """0.3 darkness + 0.4 texture + 0.3 saturation."""
    dark = pixels.groupBy(*TILE).agg((1.0 - F.avg(gray8()) / 255.0).alias("darkness"))
    out = dark.join(by_merge(laplacian_variance(pixels)), list(TILE)).join(by_merge(hsv_saturation_mean(pixels)), list(TILE))
    return out.withColumn("score", 0.3 * F.col("darkness") + 0.4 * F.col("texture") + 0.3 * F.col("saturation"))


def tile_vision_score(pixels: DataFrame) -> DataFrame:
    """0.35 DAB + 0.30 ring pattern + 0.20 nucleus density + 0.15 saturation, clipped to 0..1."""
    dab = pixels.groupBy(*TILE).agg(F.least(F.avg("dab") / 0.30, F.lit(1.0)).alias("_dab"))
    density = cell_density(pixels).select(*TILE, F.least(F.col("per_10k_px") / 15.0, F.lit(1.0)).alias("_density"))
    out = dab.join(by_merge(density), list(TILE)).join(by_merge(nucleus_ring_score(pixels)), list(TILE)).join(
        by_merge(hsv_saturation_mean(pixels)), list(TILE))
    score = (0.35 * F.col("_dab") + 0.30 * F.col("ring_score") + 0.20 * F.col("_density") + 0.15 * F.col("saturation"))
    return out.select(*TILE, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def filter_tiles(
    pixels: DataFrame, tile_scores: DataFrame, least_score: float | Column, least_dab: float = DAB_POSITIVE
) -> tuple[DataFrame, DataFrame]:
    """Reason per tile, and the cells kept.

    A tile without nuclei or with a low `score` is dropped; of the others, cells with mean DAB below
    `least_dab` are removed; a tile left without cells is dropped too.
    """
    tiles = pixels.groupBy(*TILE).agg(F.max("nuc_id").alias("_top")).join(
        by_merge(tile_scores.select(*TILE, "score")), list(TILE), "left")
    cells = pixels.filter(F.col("cell_id") > 0).groupBy(*TILE, "cell_id").agg(F.avg("dab").alias("dab_mean"))
    stained = cells.filter(F.col("dab_mean") >= least_dab)
    kept = stained.groupBy(*TILE).agg(F.count(F.lit(1)).alias("n_kept"))
    low = F.coalesce(F.col("score"), F.lit(0.0)) < least_score
    reasons = tiles.join(by_merge(kept), list(TILE), "left").select(
        *TILE, F.when(F.col("_top") == 0, "no_cells").when(low, "stromal")
        .when(F.col("n_kept").isNull(), "negative_dab").otherwise("kept").alias("reason"))
    good = reasons.filter(F.col("reason") == "kept")
    return reasons, stained.join(by_merge(good), list(TILE), "left_semi")


def reason_counts(reasons: DataFrame) -> DataFrame:
    """Tiles per reason, all four present, by one aggregate."""
    names = ("kept", "no_cells", "stromal", "negative_dab")
    one = reasons.agg(F.array(*[
        F.struct(F.lit(n).alias("reason"), F.count_if(F.col("reason") == n).alias("n_tiles")) for n in names]).alias("_r"))
    return one.select(F.explode("_r").alias("_r")).select("_r.*")


def filter_epithelial_proxy(pixels: DataFrame, least: float = 0.35) -> tuple[DataFrame, DataFrame]:
    return filter_tiles(pixels, tile_epithelial_proxy(pixels), least)


def filter_ring_pattern(pixels: DataFrame, least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    return filter_tiles(pixels, nucleus_ring_score(pixels).withColumnRenamed("ring_score", "score"), least)


def filter_tile_score(pixels: DataFrame, least: float = 0.30) -> tuple[DataFrame, DataFrame]:
    return filter_tiles(pixels, tile_vision_score(pixels), least)


def filter_epithelial_cluster(pixels: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`clusters`: tile and `epithelial`; tiles of the other cluster are stromal."""
    return filter_tiles(pixels, clusters.select(*TILE, F.col("epithelial").cast("double").alias("score")), 0.5)
