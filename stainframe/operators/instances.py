"""From label rasters to rows: areas, filters and stain measurements per nucleus and cell.

`pixels` has `nuc_id`, `cell_id` (0 = background, same id for a nucleus and its cell) and, where a
measurement needs them, `dab`, `bar` and `prob`. Groups are (slide, tile, id), so a pixel table
placed by tile is aggregated where it lies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stainframe.constants import (
    DAB_POSITIVE, MAX_NUCLEUS, MAX_RATIO, MIN_CELL, MIN_COVERAGE, MIN_NUCLEUS,
)
from stainframe.functions import grading as G
from stainframe.functions.lineage import by_merge
from stainframe.operators.pixels import TILE
from stainframe.operators.rasters import col_window, ellipse_widths, erode_labels, erosions, row_window

CELL = (*TILE, "cell_id")


def instance_areas(pixels: DataFrame) -> DataFrame:
    """Pixels of each id as nucleus and as cell; a missing one has none."""
    both = pixels.select(*TILE, F.explode(F.array(
        F.struct(F.col("nuc_id").alias("id"), F.lit(1).alias("n"), F.lit(0).alias("c")),
        F.struct(F.col("cell_id").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("c")))).alias("v"))
    return both.filter(F.col("v.id") > 0).groupBy(*TILE, F.col("v.id").alias("id")).agg(
        F.sum("v.n").alias("nuc_area"), F.sum("v.c").alias("cell_area"))


def instance_centroids(pixels: DataFrame, label: str) -> DataFrame:
    return (pixels.filter(F.col(label) > 0).groupBy(*TILE, F.col(label).alias("id"))
            .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))


def relabel_contiguous(instances: DataFrame) -> DataFrame:
    """New ids 1..n per tile in id order; the list of a tile's instances is short."""
    rank = F.dense_rank().over(Window.partitionBy(*TILE).orderBy("id"))
    return instances.withColumn("new_id", rank)


def with_compartments(pixels: DataFrame, scope: str = "cell") -> DataFrame:
    """`ring` = cell minus its 5 x 5 erosion done twice, `edge` = cell minus its 3 x 3 erosion.

    `scope="union"` erodes the union of all cells, so touching cells have no ring between them.
    """
    return compartments(erosions(pixels, "cell_id", {"_in5": (5, 2), "_in3": (3, 1)}, scope))


def compartments(df: DataFrame) -> DataFrame:
    """`ring` and `edge` from the two erosions of `with_compartments`."""
    cell = F.col("cell_id") > 0
    return df.withColumns({"ring": cell & ~F.col("_in5"), "edge": cell & ~F.col("_in3")}).drop("_in5", "_in3")


def _mean(value: str | Column, test: Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(test, value))


def finite_dab() -> Column:
    """`dab`, refused where it is null, NaN or infinite."""
    bad = F.col("dab").isNull() | F.isnan("dab") | (F.abs("dab") == float("inf"))
    return F.when(bad, F.raise_error(F.lit("dab holds NaN or infinity")).cast("double")).otherwise(F.col("dab"))


def perimeter_coverage(pixels: DataFrame, limit: float = 0.05) -> DataFrame:
    """Share of each cell's boundary pixels with DAB above the limit. Refuses NaN and infinite DAB."""
    edge = erode_labels(pixels.withColumn("dab", finite_dab()), "cell_id", 3, 1, "_in")
    return edge.filter((F.col("cell_id") > 0) & ~F.col("_in")).groupBy(*TILE, F.col("cell_id").alias("id")).agg(
        F.avg((F.col("dab") > limit).cast("int")).alias("coverage"))


def first_failed(
    max_ratio: float = MAX_RATIO, min_coverage: float = MIN_COVERAGE, min_nucleus: int = MIN_NUCLEUS,
    max_nucleus: int = MAX_NUCLEUS, min_cell: int = MIN_CELL,
) -> Column:
    """The first test a nucleus fails by `nuc_area`, `cell_area` and `coverage`, or `kept`."""
    ratio = F.col("cell_area") / F.col("nuc_area")
    return (F.when(F.col("nuc_area") < min_nucleus, "small_nucleus")
            .when(F.col("nuc_area") > max_nucleus, "large_nucleus")
            .when(F.col("cell_area") < min_cell, "small_cell")
            .when(ratio > max_ratio, "high_ratio")
            .when(F.coalesce(F.col("coverage"), F.lit(0.0)) < min_coverage, "low_membrane")
            .otherwise("kept"))


def filter_cells(
    pixels: DataFrame, max_ratio: float = MAX_RATIO, min_coverage: float = MIN_COVERAGE,
    min_nucleus: int = MIN_NUCLEUS, max_nucleus: int = MAX_NUCLEUS, min_cell: int = MIN_CELL,
) -> DataFrame:
    """Every nucleus with the first test it fails as `reason`, or `kept`."""
    areas = instance_areas(pixels).filter(F.col("nuc_area") > 0)
    joined = areas.join(by_merge(perimeter_coverage(pixels)), [*TILE, "id"], "left")
    return joined.withColumn("reason", first_failed(max_ratio, min_coverage, min_nucleus, max_nucleus, min_cell))


def keep_cells(pixels: DataFrame, size: int | None = None, pad: int = 0, limit: float = 0.05) -> DataFrame:
    """Pixels of cells grown from nuclei, with the cells of `filter_cells` numbered 1..n per tile and the others background.

    `pixels` has `_in`, the 3 x 3 erosion of its own cell, and a nucleus lies in the cell of its id. With `size` and `pad`
    the rule of `center_zone_filter` holds too. All is windows over a tile sorted once by cell: no join, no second pass.
    """
    cell, upto = Window.partitionBy(*CELL), Window.partitionBy(*TILE).orderBy("cell_id")
    own = F.col("nuc_id") == F.col("cell_id")
    edge = F.when(~F.col("_in"), (F.col("dab") > limit).cast("int"))
    df = pixels.withColumns({
        "nuc_area": F.count_if(own).over(cell), "cell_area": F.count(F.lit(1)).over(cell), "coverage": F.avg(edge).over(cell)})
    keep = (F.col("cell_id") > 0) & (F.col("nuc_area") > 0) & (first_failed() == "kept")
    if pad and size:
        for c in ("x", "y"):
            middle = F.avg(F.when(own, F.col(c))).over(cell)
            keep = keep & (middle >= pad) & (middle < size - pad)
    first = F.coalesce(F.lag("cell_id").over(upto) != F.col("cell_id"), F.lit(True))
    df = df.withColumns({"_keep": F.coalesce(keep, F.lit(False)), "_first": first})
    df = df.withColumn("_new", F.sum((F.col("_keep") & F.col("_first")).cast("int")).over(upto).cast("int"))
    return df.withColumns({
        "nuc_id": F.when(F.col("_keep") & own, F.col("_new")).otherwise(F.lit(0)),
        "cell_id": F.when(F.col("_keep"), F.col("_new")).otherwise(F.lit(0))}).drop(
        "nuc_area", "cell_area", "coverage", "_in", "_keep", "_first", "_new")


def filter_reason_counts(filtered: DataFrame) -> DataFrame:
    reasons = ["kept", "small_nucleus", "large_nucleus", "small_cell", "high_ratio", "low_membrane"]
    wide = filtered.groupBy(*TILE).pivot("reason", reasons).count().fillna(0, reasons)
    return wide.withColumn("total", sum((F.col(r) for r in reasons[1:]), F.col(reasons[0])))


def drop_small_instances(pixels: DataFrame, min_px: int) -> DataFrame:
    """Cells under `min_px` pixels become background."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*CELL))
    return pixels.withColumn("cell_id", F.when(size >= min_px, F.col("cell_id")).otherwise(F.lit(0)))


def tile_stats(pixels: DataFrame) -> DataFrame:
    areas = instance_areas(pixels)
    nuc, cell = F.col("nuc_area"), F.col("cell_area")
    has_n, has_c = nuc > 0, cell > 0
    ratio = F.when(has_n & has_c, cell / nuc)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = areas.groupBy(*TILE).agg(
        F.count_if(has_n).alias("num_nuclei"), F.count_if(has_c).alias("num_cells"),
        zero(_mean(nuc, has_n)).alias("mean_nucleus_area"), zero(_mean(cell, has_c)).alias("mean_cell_area"),
        zero(F.avg(ratio)).alias("mean_cell_nucleus_ratio"), zero(F.stddev_pop(ratio)).alias("std_cell_nucleus_ratio"))
    cover = pixels.groupBy(*TILE).agg(F.avg((F.col("cell_id") > 0).cast("int")).alias("tile_coverage"))
    zeros = [c for c in sums.columns if c not in TILE]
    return cover.join(by_merge(sums), list(TILE), "left").fillna(0, zeros)


def area_ratio_stats(pixels: DataFrame) -> DataFrame:
    """Cell to nucleus area ratio per tile; a tile has few instances, so its median is one aggregate."""
    areas = instance_areas(pixels).filter((F.col("nuc_area") > 0) & (F.col("cell_area") > 0))
    r = F.col("cell_area") / F.col("nuc_area")
    return areas.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"),
        F.stddev_pop(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"))


def center_zone_filter(pixels: DataFrame, size: int, pad: int) -> DataFrame:
    """Nuclei whose centroid is inside the unpadded zone of a size x size tile."""
    inside = lambda c: (F.col(c) >= pad) & (F.col(c) < size - pad)
    return instance_centroids(pixels, "nuc_id").filter(inside("cx") & inside("cy"))


def _in_nucleus() -> Column:
    return F.col("nuc_id") == F.col("cell_id")


def ring_fixed(pixels: DataFrame, min_area: int = 20, min_ring: int = 5, min_cytoplasm: int = 4) -> DataFrame:
    """Mean DAB of the fixed ring, the cytoplasm (cell minus nucleus minus ring) and the nucleus."""
    df = with_compartments(pixels).filter(F.col("cell_id") > 0)
    ring, nuc = F.col("ring"), _in_nucleus()
    cyto = ~ring & ~nuc
    sums = df.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_px"), F.count_if(nuc).alias("n_nucleus"), F.count_if(ring).alias("n_ring"),
        F.count_if(cyto).alias("n_cytoplasm"), _mean("dab", ring).alias("membrane"),
        _mean("dab", cyto).alias("cytoplasm"), _mean("dab", nuc).alias("nucleus"))
    sums = sums.filter((F.col("n_px") >= min_area) & (F.col("n_nucleus") > 0) & (F.col("n_ring") >= min_ring))
    return sums.withColumn("cytoplasm", F.when(F.col("n_cytoplasm") >= min_cytoplasm, F.col("cytoplasm")))


def ring_bar_weighted(pixels: DataFrame, scope: str = "cell") -> DataFrame:
    """Bar-weighted mean DAB of the ring (plain mean without weight), and the plain mean."""
    df = with_compartments(pixels, scope).filter(F.col("ring"))
    w = F.greatest(F.col("bar"), F.lit(0.0))
    return df.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_ring"), F.avg("dab").alias("raw_membrane_dab"),
        F.when(F.sum(w) > 0, F.sum(F.col("dab") * w) / F.sum(w)).otherwise(F.avg("dab")).alias("membrane_ring_dab"))


def cell_bar_weighted(pixels: DataFrame, min_area: int = 20, min_membrane: int = 3, min_cytoplasm: int = 4) -> DataFrame:
    """Weights over the whole cell; membrane is where the bar response is positive."""
    df = erode_labels(pixels, "cell_id", 3, 1, "_in3").filter(F.col("cell_id") > 0)
    on, nuc = F.col("bar") > 0, _in_nucleus()
    w, cyto, edge = F.greatest(F.col("bar"), F.lit(0.0)), ~on & ~nuc, ~F.col("_in3")
    sums = df.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_px"), F.count_if(nuc).alias("n_nucleus"), F.count_if(on).alias("n_membrane"),
        F.count_if(cyto).alias("n_cytoplasm"),
        F.when(F.sum(w) > 0, F.sum(F.col("dab") * w) / F.sum(w)).otherwise(F.avg("dab")).alias("membrane"),
        _mean("dab", cyto).alias("cytoplasm"), _mean("dab", nuc).alias("nucleus"),
        F.avg(F.when(edge, on.cast("int"))).alias("completeness"))
    sums = sums.filter((F.col("n_px") >= min_area) & (F.col("n_nucleus") > 0) & (F.col("n_membrane") >= min_membrane))
    return sums.withColumn("cytoplasm", F.when(F.col("n_cytoplasm") >= min_cytoplasm, F.col("cytoplasm")))


def cell_soft_weighted(pixels: DataFrame, membrane: str, cytoplasm: str, least: float = 0.1) -> DataFrame:
    """Mean DAB weighted by class probability, where both weights amount to something."""
    m, c = F.greatest(F.col(membrane), F.lit(0.0)), F.greatest(F.col(cytoplasm), F.lit(0.0))
    sums = pixels.filter(F.col("cell_id") > 0).groupBy(*CELL).agg(
        F.sum(membrane).alias("_m"), F.sum(cytoplasm).alias("_c"),
        F.try_divide(F.sum(F.col("dab") * m), F.sum(m)).alias("membrane"),
        F.try_divide(F.sum(F.col("dab") * c), F.sum(c)).alias("cytoplasm"))
    return sums.filter((F.col("_m") > least) & (F.col("_c") > least)).drop("_m", "_c")


def cell_class_compartments(pixels: DataFrame, label: str = "label", min_area: int = 20, least: int = 3) -> DataFrame:
    """Mean DAB of the pixels classed membrane (3) and cytoplasm (2) in each cell."""
    m, c = F.col(label) == 3, F.col(label) == 2
    sums = pixels.filter(F.col("cell_id") > 0).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_px"), F.count_if(m).alias("n_membrane"), F.count_if(c).alias("n_cytoplasm"),
        _mean("dab", m).alias("membrane"), _mean("dab", c).alias("cytoplasm"))
    return sums.filter((F.col("n_px") >= min_area) & (F.col("n_membrane") >= least) & (F.col("n_cytoplasm") >= least))


def membrane_completeness(pixels: DataFrame, require_dab: bool = True) -> DataFrame:
    """Share of edge pixels with a positive bar response and, if required, DAB above the limit."""
    df = erode_labels(pixels, "cell_id", 3, 1, "_in3").filter((F.col("cell_id") > 0) & ~F.col("_in3"))
    hit = F.col("bar") > 0
    if require_dab:
        hit = hit & (F.col("dab") > DAB_POSITIVE)
    return df.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_edge"), F.avg(hit.cast("int")).alias("membrane_completeness"))


def measure_cells(pixels: DataFrame, mpp: float, scope: str = "cell", min_px: int = 20, min_ring: int = 3) -> DataFrame:
    """The membrane columns of every cell from one aggregate: ring DAB, completeness, thickness, grade."""
    return measure_compartments(with_compartments(pixels, scope), mpp, min_px, min_ring)


def measure_compartments(pixels: DataFrame, mpp: float, min_px: int = 20, min_ring: int = 3) -> DataFrame:
    """`measure_cells` of pixels that have their `ring` and `edge`."""
    df = pixels.filter(F.col("cell_id") > 0)
    ring, edge = F.col("ring"), F.col("edge")
    w = F.when(ring, F.greatest(F.col("bar"), F.lit(0.0)))
    hit = (F.col("bar") > 0) & (F.col("dab") > DAB_POSITIVE)
    n_ring, n_edge = F.count_if(ring), F.count_if(edge)
    sums = df.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_px"), n_ring.alias("n_ring"), F.avg("dab").alias("dab_mean"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        F.when(F.sum(w) > 0, F.sum(F.col("dab") * w) / F.sum(w)).otherwise(_mean("dab", ring)).alias("membrane_ring_dab"),
        _mean("dab", ring).alias("raw_membrane_dab"),
        F.avg(F.when(edge, hit.cast("int"))).alias("membrane_completeness"),
        F.when(n_edge > 3, n_ring / n_edge).alias("membrane_thickness_px"))
    enough = (F.col("n_px") >= min_px) & (F.col("n_ring") >= min_ring)
    out = sums.withColumns({c: F.when(enough, F.col(c)) for c in (
        "membrane_ring_dab", "raw_membrane_dab", "membrane_completeness", "membrane_thickness_px")})
    return out.withColumns({
        "membrane_thickness_um": F.col("membrane_thickness_px") * mpp,
        "grade_dab": G.grade_dab("membrane_ring_dab").cast("tinyint"),
        "grade_composite": G.grade_composite(
            "membrane_thickness_px", "membrane_completeness", "raw_membrane_dab").cast("tinyint"),
        "thresholds_calibrated": F.lit(False)})


def thickness_ratio(pixels: DataFrame, scope: str = "union", min_edge: int = 3) -> DataFrame:
    """Ring pixels per edge pixel, null for cells with hardly an edge."""
    sums = with_compartments(pixels, scope).filter(F.col("cell_id") > 0).groupBy(*CELL).agg(
        F.count_if("ring").alias("n_ring"), F.count_if("edge").alias("n_edge"))
    return sums.withColumn(
        "thickness_ratio", F.when(F.col("n_edge") > min_edge, F.try_divide(F.col("n_ring"), F.col("n_edge"))))


def repeat_ring(pixels: DataFrame, steps: int = 2) -> DataFrame:
    """Pixels of the ring that repeat runs measure, as `id` with the pixel's own columns.

    A cell grown `steps` times by the 3 x 3 cross, without the cell eroded once by it; the outside of the raster never
    counts. The ring reaches outside the cell, and a pixel may be in several. Only pixels an erosion
    takes are spread: they and their surroundings are all of the ring.
    """
    own = F.col("cell_id")
    stays = [agg(own).over(w.rangeBetween(-1, 1)) == own for w in (row_window(), col_window()) for agg in (F.min, F.max)]
    df = pixels.withColumn("_stays", stays[0] & stays[1] & stays[2] & stays[3])
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-steps, steps + 1)
                        for dy in range(-steps, steps + 1) if abs(dx) + abs(dy) <= steps])
    spread = df.filter((own > 0) & ~F.col("_stays")).select(
        *TILE, own.alias("id"), "x", "y", F.explode(offsets).alias("o")).select(
        *TILE, "id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()
    return spread.join(by_merge(df), [*TILE, "x", "y"]).filter((own != F.col("id")) | ~F.col("_stays")).drop("_stays")


def repeat_run_cells(pixels: DataFrame, min_px: int = 5, min_ring: int = 3) -> DataFrame:
    """Per cell of a repeat run: mean bar response of its ring, completeness, their grade, and the disc of the ring's area.

    Cells or rings of fewer pixels are left out.
    """
    ring = repeat_ring(pixels).groupBy(*TILE, F.col("id").alias("cell_id")).agg(
        F.count(F.lit(1)).alias("n_ring"), F.avg("bar").alias("ring_bar"),
        F.avg((F.col("dab") > DAB_POSITIVE).cast("int")).alias("completeness"))
    sizes = pixels.filter(F.col("cell_id") > 0).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_px"))
    return ring.join(by_merge(sizes), list(CELL)).filter((F.col("n_px") >= min_px) & (F.col("n_ring") >= min_ring)).withColumns({
        "grade": G.grade_bar_completeness("ring_bar", "completeness"),
        "thickness_disc": 2.0 * F.sqrt(F.col("n_ring") / (math.pi + 1e-8))})


def nucleus_rings(pixels: DataFrame, k: int) -> DataFrame:
    """Pixels inside the k x k elliptic dilation of each nucleus but outside that nucleus.

    A pixel may be in the ring of several nuclei. Only boundary pixels of a nucleus are spread: the
    kernel's rows are centred, so the dilation of the boundary and the nucleus itself cover all of it. A
    boundary pixel gives one span for each row of the kernel; the spans of a nucleus on one raster row, bounded by
    its size, are laid over each other before they become pixels.
    """
    edge = erode_labels(pixels, "nuc_id", 3, 1, "_in").filter((F.col("nuc_id") > 0) & ~F.col("_in"))
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in ellipse_widths(k).items()])
    spans = edge.select(*TILE, F.col("nuc_id").alias("id"), "x", "y", F.explode(rows).alias("o")).groupBy(
        *TILE, "id", (F.col("y") + F.col("o.dy")).alias("y")).agg(F.collect_set(F.struct(
            (F.col("x") - F.col("o.w")).alias("lo"), (F.col("x") + F.col("o.w")).alias("hi"))).alias("_s"))
    spread = spans.select(*TILE, "id", "y", F.explode(F.array_distinct(F.flatten(
        F.transform("_s", lambda s: F.sequence(s.lo, s.hi))))).alias("x"))
    return spread.join(by_merge(pixels), [*TILE, "x", "y"]).filter(F.col("nuc_id") != F.col("id"))


def expansion_ring_dab(pixels: DataFrame, radius: int = 10, min_area: int = 20, min_px: int = 3) -> DataFrame:
    """Mean DAB of the ring a nucleus grows into, beside the cell's own ring, which stands in if it is small."""
    ring = nucleus_rings(pixels, 2 * radius + 1).groupBy(*TILE, F.col("id").alias("cell_id")).agg(
        F.count(F.lit(1)).alias("n_expansion"), F.avg("dab").alias("_exp"))
    model = ring_fixed(pixels, min_area, min_px).select(*CELL, F.col("membrane").alias("model_dab"))
    out = model.join(by_merge(ring), list(CELL), "left").fillna(0, ["n_expansion"])
    return out.withColumn("expansion_dab", F.when(F.col("n_expansion") >= min_px, F.col("_exp"))
                          .otherwise(F.col("model_dab"))).drop("_exp")


def hscore_by_boundary(pixels: DataFrame, radius: int = 10) -> DataFrame:
    """Per tile, H-score and positivity by the cell's ring and by the expanded nucleus."""
    both = expansion_ring_dab(pixels, radius)
    m, e = G.grade_dab("model_dab"), G.grade_dab("expansion_dab")
    return both.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("n_cells"), G.h_score(m).alias("model_h_score"), G.pct_at_least(m).alias("model_pct_positive"),
        G.h_score(e).alias("expansion_h_score"), G.pct_at_least(e).alias("expansion_pct_positive"))


def nucleus_interior_dab(pixels: DataFrame, min_px: int = 10) -> DataFrame:
    """Mean DAB of each nucleus and of its 5 x 5 erosion, the latter null if that is small."""
    df = erode_labels(pixels, "nuc_id", 5, 1, "_in").filter(F.col("nuc_id") > 0)
    inner = F.col("_in")
    return df.groupBy(*TILE, F.col("nuc_id").alias("id")).agg(
        F.avg("dab").alias("nucleus_dab"), F.count_if(inner).alias("n_interior"),
        F.when(F.count_if(inner) > min_px, _mean("dab", inner)).alias("interior_dab"))


def nucleus_ring_score(pixels: DataFrame, k: int = 11, min_px: int = 10) -> DataFrame:
    """How ring-like the stain is: mean of ring/(ring + nucleus) over all nuclei, times DAB presence."""
    ids = pixels.filter(F.col("nuc_id") > 0).groupBy(*TILE, F.col("nuc_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_nucleus"), F.avg("dab").alias("nucleus"))
    rings = nucleus_rings(pixels, k).groupBy(*TILE, "id").agg(
        F.count(F.lit(1)).alias("n_ring"), F.avg("dab").alias("ring"))
    pair = ids.join(by_merge(rings), [*TILE, "id"]).filter(
        (F.col("n_ring") >= min_px) & (F.col("n_nucleus") >= min_px) & (F.col("ring") + F.col("nucleus") > 0.01))
    ratio = pair.groupBy(*TILE).agg(F.avg(F.col("ring") / (F.col("ring") + F.col("nucleus"))).alias("_ratio"))
    tiles = pixels.groupBy(*TILE).agg(F.least(F.avg("dab") / 0.15, F.lit(1.0)).alias("_presence"))
    return tiles.join(by_merge(ratio), list(TILE), "left").select(
        *TILE, F.coalesce(F.col("_ratio") * F.col("_presence"), F.lit(0.0)).alias("ring_score"))


def cell_density(pixels: DataFrame, label: str = "nuc_id", mpp: float = 0.5) -> DataFrame:
    """Instances per 10,000 pixels and per square millimetre."""
    n = F.count_distinct(F.when(F.col(label) > 0, F.col(label)))
    px = F.count(F.lit(1))
    return pixels.groupBy(*TILE).agg(
        n.alias("n_instances"), (n / px * 10000).alias("per_10k_px"), (n / (px * (mpp / 1000.0) ** 2)).alias("per_mm2"))
