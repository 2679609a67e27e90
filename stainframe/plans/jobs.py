"""The three jobs: pixels to labels, labels to measured cells, cells to eligibility.

Each is one plan from tables to tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.constants import PATIENT
from stainframe.functions.stain import with_dab
from stainframe.operators import cohorts as C
from stainframe.operators import growth as W
from stainframe.operators import instances as I
from stainframe.operators import pixels as P
from stainframe.operators import rasters as R
from stainframe.operators import scoring as S
from stainframe.sources.readers import manifest_pending


def label_cells(
    pixels: DataFrame, cap: int = 60, extent: tuple[int, int] | None = None, tile_size: int | None = None, pad: int = 0
) -> DataFrame:
    """Pixels with nuclei in, pixels with filtered cells out.

    Stain separation, a threshold per slide, a closed membrane mask, growth from the nuclei, the cell
    filter and, with `pad`, the centre-zone rule. All work stays inside tiles: closing, growth and the erosion that the
    filter reads are one pass over blocks, and pixels are placed by tile after it, where they are filtered and numbered.
    """
    stained = with_dab(pixels)
    # Thresholds are one row a slide; a merge join would deal all pixels out by slide.
    thresholds = F.broadcast(P.otsu_per_slide(stained))
    marked = P.threshold_mask(stained, thresholds, ["slide_id"]).select(*P.TILE, "x", "y", "nuc_id", I.finite_dab().alias("dab"), "mask")
    grown = P.by_tile(W.grow_cells(marked, cap, extent, carry=["dab"]))
    return I.keep_cells(grown, tile_size, pad).select(*P.TILE, "x", "y", "nuc_id", "cell_id", "dab")


def pending_pixels(pixels: DataFrame, manifest: DataFrame, config_hash: str, step: str | None = None) -> DataFrame:
    """Pixels of the tiles still to do in a step under this configuration."""
    keyed = pixels.withColumn("tile_key", F.concat_ws("/", "slide_id", F.col("tile_id").cast("string")))
    return manifest_pending(keyed, manifest, config_hash, step=step)


def measure_cells(pixels: DataFrame, mpp: float = 0.5, extent: tuple[int, int] | None = None) -> DataFrame:
    """Labelled pixels in, measured and graded cells out: bar filter, compartments, one aggregate.

    Pixels move once, to the blocks of the bar filter, where compartments are read too; then sums of cells do.
    """
    stained = pixels if "dab" in pixels.columns else with_dab(pixels)
    barred = R.bar_filter_compartments(stained, "zero", extent, carry=["cell_id", "dab"])
    return I.measure_compartments(I.compartments(barred), mpp)


def eligibility(cells: DataFrame, baseline: DataFrame, region: str = PATIENT) -> DataFrame:
    """Which slides change eligibility between the baseline and this cohort?"""
    return C.compare_cohorts(C.baseline_summary(baseline, region), S.slide_summary(cells, region))
