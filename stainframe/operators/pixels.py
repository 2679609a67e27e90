"""Per-pixel masks and per-tile figures. A pixel row is `slide_id, tile_id, x, y, r, g, b, ...`.

Tiles are small rasters, so (slide, tile) is the unit of work: `by_tile` places each tile's pixels
together once, and every window, aggregate and join below that groups by tile then needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stainframe.constants import DAB_LEVELS, DAB_POSITIVE
from stainframe.functions import grading as G
from stainframe.functions.stain import dab_votes

TILE = ("slide_id", "tile_id")


def by_tile(pixels: DataFrame) -> DataFrame:
    """Pixels placed by tile, which serves every window, aggregate and join by tile that follows.

    The operators do not place by themselves, as a chain of them would then move pixels at every step; the jobs
    do it, and so should a caller who hands an operator a table that is not placed. Block filters undo it.
    """
    return pixels.repartition(*TILE)


def brightness() -> Column:
    return (F.col("r") + F.col("g") + F.col("b")) / F.lit(3.0)


def gray8() -> Column:
    """8-bit luminance, rounded."""
    return F.floor(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114 + 0.5)


def saturation() -> Column:
    """8-bit HSV saturation, rounded."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(top > 0, F.floor((top - low) * F.lit(255.0) / top + 0.5)).otherwise(F.lit(0))


def tile_mean_brightness_filter(pixels: DataFrame, limit: float = 220.0) -> DataFrame:
    means = pixels.groupBy(*TILE).agg(F.avg(brightness()).alias("mean_brightness"))
    return means.filter(F.col("mean_brightness") < limit)


def tile_tissue_fraction(pixels: DataFrame, limit: float = 235.0, step: int = 8) -> DataFrame:
    """Share of dark pixels on every 8th row and column: the fast estimate."""
    grid = pixels.filter((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return grid.groupBy(*TILE).agg(F.avg((brightness() < limit).cast("int")).alias("tissue_fraction"))


def tile_accept(pixels: DataFrame, limit: float = 220.0, least: float = 0.3) -> DataFrame:
    sums = pixels.groupBy(*TILE).agg(
        F.avg(brightness()).alias("mean_brightness"), F.avg((brightness() < limit).cast("int")).alias("dark_share"))
    return sums.filter((F.col("mean_brightness") <= limit) & (F.col("dark_share") >= least))


def tissue_mask_gray(pixels: DataFrame, limit: float = 220.0) -> DataFrame:
    return pixels.withColumn("tissue", brightness() < limit)


def mask_fixed(pixels: DataFrame, limit: float = 0.15, value: str = "dab") -> DataFrame:
    return pixels.withColumn("mask", F.col(value) > limit)


def weak_signal_flag(pixels: DataFrame, limit: float = 1e-4) -> DataFrame:
    return pixels.groupBy(*TILE).agg(F.max("dab").alias("max_dab"), (F.max("dab") < limit).alias("weak"))


def tile_dab_mean(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*TILE).agg(F.avg("dab").alias("dab_mean"))


def hsv_saturation_mean(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*TILE).agg((F.avg(saturation()) / F.lit(255.0)).alias("saturation"))


def otsu_bin(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin with the greatest between-class variance, first if tied, of `hist` = keys, `bin`, `n`.

    At most 256 bins per key, so the running sums are windows over short lists. Null if all values
    share one bin.
    """
    keys = list(keys)
    part = Window.partitionBy(*keys)
    upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.withColumns({
        "_w0": F.sum("n").over(upto).cast("double"), "_s0": F.sum(F.col("n") * F.col("bin")).over(upto).cast("double"),
        "_w": F.sum("n").over(part).cast("double"), "_s": F.sum(F.col("n") * F.col("bin")).over(part).cast("double")})
    w1 = F.col("_w") - F.col("_w0")
    gap = F.col("_s0") / F.col("_w0") - F.try_divide(F.col("_s") - F.col("_s0"), w1)
    var = F.when(w1 > 0, F.col("_w0") * w1 * gap * gap)
    s = s.withColumn("_var", var)
    best = F.max_by("bin", F.when(F.col("_var") > 0, F.struct(F.col("_var"), -F.col("bin"))))
    return s.groupBy(*keys).agg(best.alias("bin"))


def _scaled_bin(value: Column, top: Column) -> Column:
    """0..255 by the largest value; the hair keeps the top value in bin 255 in every engine."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value * 255 / F.greatest(top, F.lit(1e-6)) + F.lit(1e-9))))


def otsu_uint8(pixels: DataFrame, keys: Sequence[str] = TILE, value: str = "dab", mask: str | None = None) -> DataFrame:
    """Otsu threshold of a field per group, on 0..255 of its largest value.

    With `mask` the histogram holds masked pixels only; a group with none has no threshold.
    """
    keys = list(keys)
    inside = pixels if mask is None else pixels.filter(F.col(mask))
    tops = inside.groupBy(*keys).agg(F.max(value).alias("_top"))
    scale = pixels.groupBy(*keys).agg(F.max(value).alias("_all"))
    hist = (inside.select(*keys, value).join(tops, keys).withColumn("bin", _scaled_bin(F.col(value), F.col("_top")))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    best = otsu_bin(hist, keys).join(scale, keys)
    level = F.coalesce(F.col("bin"), F.lit(0))
    return best.select(*keys, level.alias("bin"),
                       (level / F.lit(255.0) * F.greatest(F.col("_all"), F.lit(1e-6))).alias("threshold"))


def threshold_mask(pixels: DataFrame, thresholds: DataFrame, keys: Sequence[str] = TILE, value: str = "dab") -> DataFrame:
    """`mask` = value above its group's threshold; groups without a threshold are all false."""
    return pixels.join(thresholds.select(*keys, "threshold"), list(keys), "left").withColumn(
        "mask", F.coalesce(F.col(value) > F.col("threshold"), F.lit(False)))


def otsu_gray(pixels: DataFrame, keys: Sequence[str] = TILE) -> DataFrame:
    """Otsu threshold of mean brightness, 256 unit bins, at the bin centre; 128 if there is none."""
    hist = (pixels.select(*keys, F.floor(brightness()).alias("bin"))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    return otsu_bin(hist, keys).select(*keys, F.coalesce(F.col("bin") + F.lit(0.5), F.lit(128.0)).alias("threshold"))


def otsu_per_slide(pixels: DataFrame, default: float = 0.15) -> DataFrame:
    """Otsu threshold per slide over all of its pixels; `default` for a slide without a value.

    Two scans and two partial aggregates: the largest value of each slide, then 256 counts of each.
    """
    tops = pixels.groupBy("slide_id").agg(F.max("dab").alias("_top"))
    hist = (pixels.select("slide_id", "dab").filter(F.col("dab").isNotNull()).join(tops, "slide_id")
            .groupBy("slide_id", _scaled_bin(F.col("dab"), F.col("_top")).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    level = F.coalesce("bin", F.lit(0)) / F.lit(255.0) * F.greatest(F.col("_top"), F.lit(1e-6))
    return tops.join(otsu_bin(hist, ["slide_id"]), "slide_id", "left").select(
        "slide_id", F.when(F.col("_top").isNull(), F.lit(default)).otherwise(level).alias("threshold"))


def tile_dab_profile(pixels: DataFrame, min_tissue_px: int = 100) -> DataFrame:
    """Tissue share, DAB-positive share, mean DAB in tissue and the level of each tile."""
    marked = pixels.join(otsu_gray(pixels), list(TILE)).withColumn("_t", brightness() < F.col("threshold"))
    sums = marked.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("n_px"), F.count_if("_t").alias("tissue_px"),
        F.count_if(F.col("_t") & (F.col("dab") > DAB_POSITIVE)).alias("_pos"),
        F.avg(F.when(F.col("_t"), F.col("dab"))).alias("_mean"))
    enough = F.col("tissue_px") >= min_tissue_px
    positive = F.when(enough, F.col("_pos") / F.col("tissue_px")).otherwise(F.lit(0.0))
    level = None
    for name, below in DAB_LEVELS:
        if level is None:
            level = F.when(positive < below, name)
        elif below is not None:
            level = level.when(positive < below, name)
        else:
            level = level.otherwise(name)
    return sums.select(
        *TILE, "tissue_px", (F.col("tissue_px") / F.col("n_px")).alias("tissue_fraction"),
        positive.alias("dab_positive_fraction"),
        F.when(enough, F.col("_mean")).otherwise(F.lit(0.0)).alias("mean_dab_in_tissue"), level.alias("dab_level"))


def compartment_label(pixels: DataFrame) -> DataFrame:
    """0 background, 1 nucleus, 2 cytoplasm, 3 membrane."""
    cell, nucleus = F.col("cell_id") > 0, F.col("nuc_id") > 0
    return pixels.withColumn("label", F.when(nucleus, 1).when(cell & (F.col("bar") > 0), 3).when(cell, 2).otherwise(0))


def soft_compartment_label(pixels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Weights of the four classes; membrane = share of the vector sets whose field is positive there.

    `pixels` has a `votes` column, or DAB of each vector set above `limit` is taken as its vote.
    """
    if "votes" not in pixels.columns:
        pixels = dab_votes(pixels, limit)
    cell, nucleus = F.col("cell_id") > 0, F.col("nuc_id") > 0
    inner = cell & ~nucleus
    w = [F.when(~cell, 1.0).otherwise(0.0), F.when(nucleus, 1.0).otherwise(0.0),
         F.when(inner, 1.0 - F.col("votes")).otherwise(0.0), F.when(inner, F.col("votes")).otherwise(0.0)]
    total = w[0] + w[1] + w[2] + w[3]
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    names = ("w_background", "w_nucleus", "w_cytoplasm", "w_membrane")
    return pixels.select(*TILE, "x", "y", *[(c / total).alias(n) for c, n in zip(w, names)])


def class_balance(pixels: DataFrame, limit: float = 0.15) -> DataFrame:
    """Negative over positive pixels; 1.0 when nothing is positive."""
    p = F.col("dab") > limit
    sums = pixels.agg(F.count_if(p).alias("n_pos"), F.count_if(~p).alias("n_neg"))
    return sums.withColumns({
        "pos_weight": F.coalesce(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")), F.lit(1.0)),
        "pixel_fraction": G.share(F.col("n_pos"), F.col("n_pos") + F.col("n_neg"))})


def membrane_fraction_index(labelled: DataFrame) -> DataFrame:
    """Per tile: membrane pixels, all pixels, share. `labelled` has `label` (3 = membrane)."""
    m = F.count_if(F.col("label") == 3)
    return labelled.groupBy(*TILE).agg(
        m.alias("membrane_px"), F.count(F.lit(1)).alias("total_px"), (m / F.count(F.lit(1))).alias("fraction"))


def validate_tile_labels(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles whose rasters are complete and hold a nucleus and a cell."""
    sums = pixels.groupBy(*TILE).agg(
        F.max("nuc_id").alias("max_nucleus"), F.max("cell_id").alias("max_cell"),
        F.count("nuc_id").alias("n_nucleus_px"), F.count("cell_id").alias("n_cell_px"))
    full = height * width
    return sums.filter((F.col("max_nucleus") > 0) & (F.col("max_cell") > 0)
                       & (F.col("n_nucleus_px") == full) & (F.col("n_cell_px") == full))


def fuse_masks(maps: DataFrame, strategies: str | Sequence[str], models: Sequence[str]) -> DataFrame:
    """Masks from probability maps `model, p`: average, majority_vote, intersection, best_plus_dab.

    `models` gives the order; best is the first, the DAB map the last. One strategy gives a column `mask`, several
    one column each, all from one aggregate.
    """
    yes = F.col("p") > 0.5
    place = F.create_map(*[v for i, m in enumerate(models) for v in (F.lit(m), F.lit(i))])[F.col("model")]
    tests = {
        "average": F.avg("p") > 0.5,
        "majority_vote": F.count_if(yes) > F.count(F.lit(1)) / 2,
        "intersection": F.bool_and(yes),
        "best_plus_dab": F.min_by(yes, place) & F.max_by(yes, place),
    }
    wanted = {"mask": strategies} if isinstance(strategies, str) else {s: s for s in strategies}
    return maps.groupBy(*TILE, "x", "y").agg(*[tests[s].alias(name) for name, s in wanted.items()])


def per_class_accuracy(pixels: DataFrame, truth: str, predicted: str) -> DataFrame:
    return pixels.groupBy(F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("n_px"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))
