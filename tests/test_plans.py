"""Tables that `explode` makes are large whatever their files say: no plan may send them whole through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stainframe.operators.growth import shrink_to_membrane
from stainframe.operators.rasters import eroded_field, erosions
from stainframe.verify import all_queries, views

FOLDER = "/root/testdata/sf0.001"
KEYS = ("consensus_instances filter_ring_pattern expansion_ring_dab grade_bar_completeness hscore_by_boundary ring_adaptive_relaxed "
        "ring_adaptive nucleus_ring_score thickness_disc thickness_radial_fwhm thickness_ray_fwhm tile_vision_score filter_tile_score "
        "tissue_mask_he energy_blend").split()


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("key", KEYS)
def test_no_broadcast_of_pixels(spark, key):
    assert broadcasts(all_queries()[key](spark, FOLDER)) == 0


def test_thumbnail_sums_are_not_broadcast(spark):
    # The one table sent is the size of each slide's thumbnail.
    assert broadcasts(all_queries()["tile_tissue_overlap"](spark, FOLDER)) == 1


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


@pytest.mark.parametrize("key, name, most", [
    ("sobel_energy", "FileScan", 1), ("energy_blend", "FileScan", 1), ("morph_ellipse", "Sort", 2), ("expand_nuclei", "Sort", 1),
    ("tissue_mask_ihc", "Sort", 3)])
def test_steps_of_pixels(spark, key, name, most):
    """Pixels are read once, and an ellipse of any size sorts them once, by block."""
    assert nodes(all_queries()[key](spark, FOLDER), name) <= most


def test_rasters_of_a_task_do_not_grow_with_the_list(spark, monkeypatch):
    monkeypatch.setattr(views, "RASTERS_PER_TASK", 1)
    t = views.Tables(spark, FOLDER)
    assert t.pixels.rdd.getNumPartitions() >= t.supplier.count() > spark.sparkContext.defaultParallelism


def test_erosions_share_their_sorts(spark):
    assert nodes(all_queries()["measure_cells"](spark, FOLDER), "Sort [") <= 2


def test_shrinking_counts_nuclei_where_they_lie(spark):
    """A nucleus pixel outside of its cell counts for the cell of its id, and no table of nuclei is sent about."""
    assert broadcasts(all_queries()["shrink_to_membrane"](spark, FOLDER)) == 0
    rows = [("S", 1, x, 0, 1 if x < 4 else 0, 0 if x < 3 else 1 if x < 7 else 0, 0.0, 0.0) for x in range(8)]
    px = spark.createDataFrame(rows, "slide_id string, tile_id bigint, x int, y int, nuc_id int, cell_id int, dab double, bar double")
    kept = {r.x for r in shrink_to_membrane(px).filter("refined_id = 1").collect()}
    # Four nucleus pixels guard five cell pixels: the cell of four loses none.
    assert kept == {3, 4, 5, 6}


def test_measuring_reads_compartments_where_bars_are_filtered(spark):
    assert nodes(all_queries()["measured_cells"](spark, FOLDER), "Window") == 0


@pytest.mark.parametrize("scope", ["cell", "union"])
def test_block_erosion_is_that_of_windows(spark, scope):
    rng = np.random.default_rng(7)
    label = np.kron(rng.integers(0, 3, (5, 6)), np.ones((4, 4))).astype(float)
    label[rng.random(label.shape) < 0.1] = np.nan
    rows = [("S", 1, x, y, int(label[y, x])) for y, x in np.argwhere(~np.isnan(label)).tolist()]
    px = spark.createDataFrame(rows, "slide_id string, tile_id bigint, x int, y int, cell_id int")
    got = erosions(px, "cell_id", {"a": (5, 2), "b": (3, 1)}, scope).collect()
    for name, k, n in (("a", 5, 2), ("b", 3, 1)):
        want = eroded_field(label, ~np.isnan(label), k, n, scope)
        assert all(bool(r[name]) == want[r["y"], r["x"]] for r in got)


@pytest.mark.parametrize("key", ["ring_adaptive", "ring_adaptive_relaxed"])
def test_rings_are_read_where_tiles_lie(spark, key):
    """The list of tiles is dealt out once; no pixel, ray or ring is shuffled after that, so none is written to disk."""
    df = all_queries()[key](spark, FOLDER)
    assert nodes(df, "Exchange") == 1 and nodes(df, "Join") == 0


def test_regrowth_reads_pixels_once(spark):
    assert nodes(all_queries()["regrow_from_probability"](spark, FOLDER), "FileScan") <= 1


def test_consensus_drops_background_before_it_joins(spark):
    """Background rows go first, and the list of best models is hashed: nothing is sorted or sent about for it."""
    df = all_queries()["consensus_pixels"](spark, FOLDER)
    assert broadcasts(df) == 0 and nodes(df, "SortMergeJoin") == 0
    px = spark.createDataFrame([("S", 1, 0, 0, m, i) for m, i in (("A", 3), ("B", 0), ("C", 1))]
                               + [("S", 1, 1, 0, m, i) for m, i in (("A", 0), ("B", 0), ("C", 4))],
                               "slide_id string, tile_id bigint, x int, y int, model string, inst_id int")
    from stainframe.operators.matching import consensus_pixels
    assert [tuple(r) for r in consensus_pixels(px, ["A", "B", "C"]).collect()] == [("S", 1, 0, 0, 1)]


def test_labelling_passes_over_blocks_once_and_does_as_its_steps(spark):
    """Closing, growth and erosion are one pass, filter and numbers need no join; cells are those of the steps one by one."""
    from stainframe.functions.stain import with_dab
    from stainframe.operators import growth, instances, pixels, rasters
    from stainframe.plans.jobs import label_cells

    cols = ["slide_id", "tile_id", "x", "y", "r", "g", "b", "nuc_id"]
    px = views.Tables(spark, FOLDER).pixels.select(*cols).filter("(x * 7 + y * 5 + tile_id) % 83 <> 0")
    px = px.selectExpr(*cols[:4], "if((x * 3 + y) % 19 = 0, 90, r) AS r", "g", "b", "if((x + y * 31) % 101 = 0, null, nuc_id) AS nuc_id").localCheckpoint()
    got = label_cells(px, 12, (64, 64), 64, 10)
    assert nodes(got, "FlatMapGroupsInArrow") == 1 and nodes(got, "SortMergeJoin") == 0

    stained = with_dab(px)
    marked = pixels.threshold_mask(stained, pixels.otsu_per_slide(stained), ["slide_id"]).withColumn("mask", F.expr("mask AND nuc_id = 0"))
    closed = rasters.morph_ellipse(marked, "mask", "close", 5, 1, "_wall").withColumn("_wall", F.expr("_wall AND nuc_id = 0"))
    grown = growth.grow_regions(closed, "_wall", 12, "cell_id", carry=["nuc_id", "dab"])
    keep = instances.filter_cells(grown).filter("reason = 'kept'").join(
        instances.center_zone_filter(grown, 64, 10), ["slide_id", "tile_id", "id"], "left_semi")
    new = {(r.slide_id, r.tile_id, r.id): r.new_id for r in instances.relabel_contiguous(keep.select("slide_id", "tile_id", "id")).collect()}
    number = lambda r, i: new.get((r.slide_id, r.tile_id, i), 0)
    want = {(r.slide_id, r.tile_id, r.x, r.y): (number(r, r.nuc_id), number(r, r.cell_id), r.dab) for r in grown.collect()}
    assert new and {(r.slide_id, r.tile_id, r.x, r.y): (r.nuc_id, r.cell_id, r.dab) for r in got.collect()} == want
