"""Tile grids, samples, splits and stratified choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stainframe.constants import TILE_PAD, TILE_PX
from stainframe.functions.lineage import by_merge
from stainframe.functions.ordering import exact_percentiles, rank_within, running_totals, seeded_order, top_n


def best_level(slides: DataFrame, target_mpp: float = 0.5, rule: str = "nearest", slack: float = 1.2) -> DataFrame:
    """Pyramid level to read. `nearest` to the target (first wins ties), or the `last` one whose
    pixel size is at most slack * target (level 0 if none is)."""
    mpp = lambda lv: F.col("base_mpp") * lv["downsample"]
    if rule == "nearest":
        ranked = F.transform("levels", lambda lv: F.struct(
            F.abs(mpp(lv) - target_mpp).alias("gap"), lv["level"].alias("level"), lv["downsample"].alias("downsample")))
        chosen = F.array_min(ranked)
    else:
        fits = F.filter("levels", lambda lv: (mpp(lv) <= target_mpp * slack) | (lv["level"] == 0))
        chosen = F.array_max(F.transform(fits, lambda lv: F.struct(
            lv["level"].alias("level"), lv["downsample"].alias("downsample"))))
    return (slides.withColumn("_b", chosen)
            .withColumns({"level": F.col("_b.level"), "downsample": F.col("_b.downsample")}).drop("_b")
            .withColumn("mpp", F.col("base_mpp") * F.col("downsample")))


def tile_grid(slides: DataFrame, tile: int = TILE_PX, pad: int = TILE_PAD) -> DataFrame:
    """Level-0 corners of every full tile; stride is tile - 2*pad at the level's `downsample`."""
    stride = tile - 2 * pad if pad > 0 else tile

    def starts(size: str) -> Column:
        last = F.floor(F.col(size) / F.col("downsample")).cast("bigint") - tile
        return F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>"))

    out = slides.select("*", F.explode(starts("width")).alias("_x")).select("*", F.explode(starts("height")).alias("_y"))
    return out.withColumns({
        "x_l0": F.floor(F.col("_x") * F.col("downsample")), "y_l0": F.floor(F.col("_y") * F.col("downsample"))
    }).drop("_x", "_y")


def tile_tissue_overlap(tiles: DataFrame, mask: DataFrame, tile: int = TILE_PX, scale: int = 64) -> DataFrame:
    """Tissue share of every tile's footprint on a thumbnail mask, clamped to the mask.

    The mask is summed along rows and columns once; a tile then reads four corner sums instead of
    every mask cell below it. `mask`: `slide_id, tx, ty, tissue`, one row per thumbnail pixel.
    """
    rows = Window.partitionBy("slide_id", "ty").orderBy("tx")
    cols = Window.partitionBy("slide_id", "tx").orderBy("ty")
    table = (mask.withColumn("_r", F.sum(F.col("tissue").cast("int")).over(rows))
             .withColumn("_s", F.sum("_r").over(cols)).select("slide_id", "tx", "ty", "_s"))
    size = mask.groupBy("slide_id").agg((F.max("tx") + 1).alias("_w"), (F.max("ty") + 1).alias("_h"))
    extent = F.lit(tile) * F.col("downsample")
    boxed = tiles.join(size, "slide_id").withColumns({
        "_x0": F.floor(F.col("x_l0") / scale), "_y0": F.floor(F.col("y_l0") / scale),
        "_x1": F.least(F.floor((F.col("x_l0") + extent) / scale), F.col("_w")),
        "_y1": F.least(F.floor((F.col("y_l0") + extent) / scale), F.col("_h"))})

    def corner(x: Column, y: Column, sign: int) -> Column:
        return F.struct((x - 1).cast("int").alias("tx"), (y - 1).cast("int").alias("ty"), F.lit(sign).alias("sign"))

    x0, x1, y0, y1 = (F.col(c) for c in ("_x0", "_x1", "_y0", "_y1"))
    corners = F.array(corner(x1, y1, 1), corner(x0, y1, -1), corner(x1, y0, -1), corner(x0, y0, 1))
    area = F.greatest(x1 - x0, F.lit(0)) * F.greatest(y1 - y0, F.lit(0))
    probe = boxed.select("slide_id", "x_l0", "y_l0", area.alias("_area"), F.explode(corners).alias("_c")).select(
        "slide_id", "x_l0", "y_l0", "_area", "_c.*")
    hit = probe.join(by_merge(table), ["slide_id", "tx", "ty"], "left")
    # Corners left of or above the mask find no row and count zero.
    on = F.sum(F.coalesce(F.col("_s"), F.lit(0)) * F.col("sign"))
    return hit.groupBy("slide_id", "x_l0", "y_l0").agg(
        F.when(F.first("_area") > 0, on / F.first("_area")).otherwise(F.lit(0.0)).alias("tissue"))


def tile_bins(cells: DataFrame, downsample: float | Column = 2.0, tile: int = TILE_PX, pad: int = TILE_PAD) -> DataFrame:
    """Tile of each cell's centroid, so that a tile's pixels meet its cells by an equi-join.

    `downsample` is a number, or a column of `cells` for slides read at different levels.
    """
    step = (tile - 2 * pad) * downsample
    return cells.withColumns({
        "tile_x": F.floor(F.col("centroid_x") / step), "tile_y": F.floor(F.col("centroid_y") / step)})


def tile_grade_stats(cells: DataFrame) -> DataFrame:
    pct = lambda v: (F.lit(100.0) * F.avg((F.col("grade") == v).cast("int"))).alias(f"grade_{v}_pct")
    return cells.groupBy("slide_id", "tile_x", "tile_y").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("grade").alias("mean_grade"), *[pct(v) for v in range(4)])


def sample_slides(slides: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return slides.orderBy(seeded_order(seed, "slide_id"), "slide_id").limit(n)


def sample_per_group(items: DataFrame, keys: Sequence[str], n: int, item: str, seed: int = 42) -> DataFrame:
    """At most n items of each group, chosen by a seeded hash of the item."""
    return top_n(items, keys, [seeded_order(seed, item), F.col(item)], n)


def split_sizes(n: Column, train: float, validation: float, rule: str) -> tuple[Column, Column]:
    """Group counts of a split: `round` (half to even, at least one each) or `int` (cut off)."""
    if rule == "int":
        return F.floor(n * F.lit(train)), F.floor(n * F.lit(validation))
    a = F.greatest(F.lit(1), F.rint(n * F.lit(train)).cast("bigint"))
    b = F.greatest(F.lit(1), F.rint(n * F.lit(validation)).cast("bigint"))
    short = n - a - b < 0
    return (F.when(short, F.greatest(F.lit(1), n - 2)).otherwise(a), F.when(short, F.lit(1)).otherwise(b))


def split_by_slide(
    items: DataFrame, train: float = 0.70, validation: float = 0.15, seed: int = 42, rule: str = "round"
) -> DataFrame:
    """Whole slides go to Train, Validation or Test in seeded order, so no slide is in two."""
    slides = items.select("slide_id").distinct().withColumn("_h", seeded_order(seed, "slide_id"))
    ranked = rank_within(slides, [], [F.col("_h"), F.col("slide_id")], "_rank", "_n")
    a, b = split_sizes(F.col("_n"), train, validation, rule)
    split = F.when(F.col("_rank") < a, "Train").when(F.col("_rank") < a + b, "Validation").otherwise("Test")
    return items.join(ranked.select("slide_id", split.alias("split")), "slide_id")


def split_by_row(items: DataFrame, item: str, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Rows go to train or validation in seeded order, at least one to validation.

    Only the cut matters, so nothing is sorted as a whole: rows are counted per hash prefix, prefixes
    before and after the cut are settled by their count, and only the one prefix the cut falls in is
    ranked. A slide may land on both sides; `split_leakage_check` shows it.
    """
    hashed = items.withColumn("_h", seeded_order(seed, item)).withColumn("_p", F.substring("_h", 1, 4))
    # At most 65536 prefixes.
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_cum": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
    cut = F.col("_total") - F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(validation)))
    counts = counts.select("_p", (F.col("_cum") - F.col("_n")).alias("_before"), "_cum", cut.alias("_cut"))
    joined = hashed.join(F.broadcast(counts), "_p")
    open_ = (F.col("_before") < F.col("_cut")) & (F.col("_cum") > F.col("_cut"))
    settled = joined.filter(~open_).withColumn(
        "split", F.when(F.col("_cum") <= F.col("_cut"), "train").otherwise("validation"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", item)) + F.col("_before")
    ranked = joined.filter(open_).withColumn("_place", place).withColumn(
        "split", F.when(F.col("_place") <= F.col("_cut"), "train").otherwise("validation")).drop("_place")
    return settled.unionByName(ranked).drop("_h", "_p", "_before", "_cum", "_cut")


def split_leakage_check(items: DataFrame) -> DataFrame:
    """Slides that are in more than one split."""
    return (items.groupBy("slide_id").agg(F.count_distinct("split").alias("n_splits"))
            .filter(F.col("n_splits") > 1))


def drop_zero_cell_tiles(tiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Without the tiles whose record says no cell was found or kept; `tile_key` is slide/x_y."""
    empty = manifest.filter((F.col("num_cells") == 0) | (F.col("kept_instances") == 0))
    return tiles.join(empty.select("tile_key"), "tile_key", "left_anti")


def _is_spaced(rank: Column, size: Column, n: Column) -> Column:
    """Is `rank` one of floor(i * (size-1) / (n-1)), i = 0 .. n-1 ? With n = 1 only rank 0 is."""
    step = (size - 1) / (n - 1)
    i = F.ceil(rank / step - F.lit(1e-9))
    hit = (i < n) & (F.floor(i * step + F.lit(1e-9)) == rank)
    return F.when(n <= 1, rank == 0).when(size <= n, F.lit(True)).otherwise(hit)


def evenly_spaced_tiles(tiles: DataFrame, n: int = 30, min_cells: int = 10) -> DataFrame:
    """n tiles at even ranks of the mean grade, tiles with too few cells left out."""
    ranked = rank_within(tiles.filter(F.col("n_cells") >= min_cells), [],
                         [F.col("mean_grade"), F.col("slide_id"), F.col("tile_x"), F.col("tile_y")])
    return ranked.filter(_is_spaced(F.col("rank"), F.col("group_size"), F.lit(n))).drop("group_size")


def stratified_tiles(tiles: DataFrame, per_category: int = 10, min_cells: int = 10, seed: int = 42) -> DataFrame:
    """Tiles spread over low, mid and high mean grade, over slides, and over each slide's grade range.

    Categories are terciles. Every slide of a category gives an equal quota at even grade ranks, and
    seeded picks fill what is missing. Only figures per slide and category are ranked as short lists;
    tiles themselves are ranked by the range-split helper, so one slide may hold most of them.
    """
    valid = tiles.filter(F.col("n_cells") >= min_cells)
    cuts = exact_percentiles(valid, [], "mean_grade", {"_lo": 0.333, "_hi": 0.667}).withColumn("_one", F.lit(0))
    # One row of cut-points. High is tested first: it overwrites low where both hold.
    valid = valid.withColumn("_one", F.lit(0)).join(F.broadcast(cuts), "_one").withColumn(
        "category", F.when(F.col("mean_grade") >= F.col("_hi"), "high")
        .when(F.col("mean_grade") <= F.col("_lo"), "low").otherwise("mid")).drop("_one", "_lo", "_hi")
    tile = [F.col("slide_id"), F.col("tile_x"), F.col("tile_y")]
    ranked = rank_within(valid, ["category", "slide_id"], [F.col("mean_grade"), *tile[1:]], "_rank", "_size")

    slides = rank_within(valid.select("category", "slide_id").distinct(), ["category"], [F.col("slide_id")], "_i", "_k")
    quota = F.greatest(F.lit(1), F.floor(F.lit(per_category) / F.col("_k")))
    quota = quota + (F.col("_i") < per_category - quota * F.col("_k")).cast("int")
    slides = slides.select("category", "slide_id", "_i", quota.alias("_quota"))
    pool = ranked.join(slides, ["category", "slide_id"])
    take = _is_spaced(F.col("_rank"), F.col("_size"), F.least(F.col("_quota"), F.col("_size")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in tile]))
    # Quota picks come first in slide order, fills after them in seeded order; then the head.
    pool = pool.withColumns({"_fill": (~take).cast("int"), "_a": F.when(take, F.col("_i")).otherwise(F.lit(0)),
                             "_b": F.when(take, F.col("_rank")).otherwise(F.lit(0)), "_h": key})
    order = [F.col(c) for c in ("_fill", "_a", "_b", "_h", "slide_id", "tile_x", "tile_y")]
    out = top_n(pool, ["category"], order, per_category)
    return out.drop("_rank", "_size", "_i", "_quota", "_fill", "_a", "_b", "_h")


def category_summary(tiles: DataFrame) -> DataFrame:
    """Per category: tiles, cells, grade range and totals, number of slides."""
    return tiles.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum("n_cells").alias("total_cells"),
        F.min("mean_grade").alias("min_grade"), F.max("mean_grade").alias("max_grade"),
        F.avg("mean_grade").alias("avg_grade"),
        *[F.sum(f"n{g}").alias(f"grade_{g}") for g in range(4)], F.count_distinct("slide_id").alias("n_slides"))


def top_k_tiles(profile: DataFrame, k: int = 20, min_tissue_px: int = 100) -> DataFrame:
    """The k tiles with the highest mean tissue DAB; a top-k report, kept per partition by Spark."""
    return (profile.filter(F.col("tissue_px") >= min_tissue_px)
            .orderBy(F.desc("mean_dab_in_tissue"), "tile_id").limit(k))


def weighted_resample(tiles: DataFrame, key: str, fraction: str, seed: int = 42, floor: float = 0.01) -> DataFrame:
    """As many seeded draws with replacement as there are tiles, weight max(fraction, floor).

    Weights are whole millionths, so running totals are exact in any order of addition. Each draw must
    find the tile whose stretch of the running total holds it. Both sides are put into as many equal
    stretches as there are tiles: a heavy tile covers several, a draw falls into one, and the match is
    an equi-join with at most 1/floor tiles to test per draw.
    """
    weight = F.round(F.greatest(F.coalesce(F.col(fraction), F.lit(0.0)), F.lit(floor)) * 1_000_000).cast("bigint")
    run = running_totals(tiles.select(key, weight.alias("_w")), [F.col(key)], {
        "_hi": F.col("_w"), "_pos": F.lit(1).cast("bigint")})
    run = run.withColumn("_lo", F.col("_hi") - F.col("_w"))
    stretch = lambda c: F.floor(c / F.col("_hi_total") * F.col("_pos_total")).cast("bigint")
    spread = run.select(key, "_lo", "_hi", F.explode(
        F.sequence(stretch(F.col("_lo")), stretch(F.col("_hi") - 1))).alias("_s"))
    uniform = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_pos").cast("string"))), 1, 8), 16, 10)
    draws = run.select(
        F.col("_pos").alias("draw"), "_hi_total", "_pos_total",
        F.floor(uniform.cast("bigint") / F.lit(4294967296.0) * F.col("_hi_total")).cast("bigint").alias("_at"))
    draws = draws.select("draw", "_at", stretch(F.col("_at")).alias("_s"))
    hit = draws.join(spread, "_s").filter((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return hit.select("draw", key)


def shard_slides(slides: DataFrame, n: int) -> DataFrame:
    """Slide i, in name order, goes to shard i mod n."""
    ranked = rank_within(slides.select("slide_id").distinct(), [], [F.col("slide_id")])
    return ranked.select("slide_id", (F.col("rank") % n).alias("shard"))


def slide_key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Slides of either source, with a flag for those in both."""
    left, right = a.select("slide_id").distinct(), b.select("slide_id").distinct()
    matched = left.intersect(right).withColumn("matched", F.lit(True))
    return left.union(right).distinct().join(matched, "slide_id", "left").fillna(False, ["matched"])


def value_counts(df: DataFrame, column: str, within: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*within, column).agg(F.count(F.lit(1)).alias("n"))


def per_slide_table(parts: Sequence[DataFrame]) -> DataFrame:
    """Per-slide tables stacked by column name; a column one of them lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


