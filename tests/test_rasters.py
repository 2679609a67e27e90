"""Raster operators against direct numpy loops, and the invariants of growth and shrinking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import disc_tile, tile_rows, to_raster
from stainframe.functions import stain
from stainframe.functions.envelope import NONE, column_gaps, row_envelope
from stainframe.operators import growth as W
from stainframe.operators import rasters as R


def test_palette_known_answers(spark):
    colours = [(200, 180, 220), (140, 100, 60), (60, 40, 80), (200, 205, 245), (255, 255, 255)]
    df = stain.deconvolve(spark.createDataFrame(colours, "r int, g int, b int")).collect()
    want = [(0.349173, 0.129293, 0), (0.370180, 1.586332, 0), (1.826115, 1.068098, 0), (0.3341, 0, 0), (0, 0, 0)]
    for row, (h, d, r) in zip(df, want):
        assert (row["hematoxylin"], row["dab"], row["residual"]) == pytest.approx((h, d, r), abs=1e-4)


def test_zero_vector_does_not_divide_by_zero():
    with pytest.raises(np.linalg.LinAlgError):
        stain.inverse([(0, 0, 0), (1, 0, 0), (0, 1, 0)])


@pytest.mark.parametrize("border", ["zero", "reflect"])
def test_bar_filter_against_loops(tile, rasters, border):
    got = to_raster(R.bar_filter_max(tile, "dab", "out", border), "out")
    pad = np.pad(rasters["dab"], 12, mode="constant" if border == "zero" else "reflect")
    kernels = R.bar_kernels()
    for y, x in [(0, 0), (20, 9), (31, 31), (63, 63), (42, 54), (12, 63)]:
        want = max((pad[y:y + 25, x:x + 25] * k).sum() for k in kernels)
        assert got[y, x] == pytest.approx(want, abs=1e-9)


def test_bar_kernels_are_zero_mean_and_normed():
    k = R.bar_kernels()
    assert k.shape == (8, 25, 25)
    assert np.allclose(k.sum(axis=(1, 2)), 0, atol=1e-9) and np.allclose(np.abs(k).sum(axis=(1, 2)), 1)


def test_blocks_do_not_show(spark):
    """A raster over several blocks gives what one block would."""
    rng = np.random.default_rng(0)
    big = {"dab": rng.random((150, 140))}
    df = tile_rows(spark, big)
    got = to_raster(R.gaussian_smooth(df, "dab", 1.0), "out", (150, 140))
    w = R.gaussian_weights(1.0)
    pad = np.pad(big["dab"], 4, mode="symmetric")
    for y, x in [(0, 0), (127, 127), (128, 128), (149, 139), (130, 5), (64, 128)]:
        assert got[y, x] == pytest.approx((pad[y:y + 9, x:x + 9] * np.outer(w, w)).sum(), abs=1e-12)


def test_median_and_distance(tile, rasters):
    med = to_raster(R.median_filter(tile, "dab", 7), "out")
    pad = np.pad(rasters["dab"], 3, mode="edge")
    dist = to_raster(R.distance_to_mask(tile.withColumn("m", F.col("dab") > 0.4), "m", 9), "distance")
    ys, xs = np.nonzero(rasters["dab"] > 0.4)
    for y, x in [(0, 0), (20, 20), (33, 40), (63, 0), (9, 30)]:
        assert med[y, x] == np.median(pad[y:y + 7, x:x + 7])
        assert dist[y, x] == pytest.approx(min(9.0, np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min())))


@pytest.mark.parametrize("k", [1, 3, 7, 15])
def test_median_of_bytes(spark, k):
    a = np.random.default_rng(k).integers(0, 256, (30, 26))
    a[:12, :9] = 255
    got = to_raster(R.median_bytes(tile_rows(spark, {"v": a}), "v", k), "out", (30, 26))
    pad = np.pad(a, k // 2, mode="edge")
    want = [[np.median(pad[y:y + k, x:x + k]) for x in range(26)] for y in range(30)]
    assert np.array_equal(got, want)


@pytest.mark.parametrize("share", [0.0, 0.002, 0.05, 0.6])
def test_envelope_is_the_nearest_pixel(share):
    on = np.random.default_rng(7).random((37, 53)) < share
    got = row_envelope(column_gaps(on))
    if not on.any():
        assert (got == NONE).all()
        return
    y, x = np.mgrid[:37, :53]
    ys, xs = np.nonzero(on)
    want = ((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(axis=2)
    assert np.array_equal(got, want)


def test_distance_without_a_limit(spark):
    """Rasters over several strips with missing pixels, one with a single set pixel in a corner and one with none."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for tile, share in enumerate((0.0, 0.01, 0.4)):
        on, there = rng.random((70, 45)) < share, rng.random((70, 45)) < 0.9
        if tile == 1:
            on[:] = False
            on[69, 44] = there[69, 44] = True
        ys, xs = np.nonzero(on & there)
        for y, x in np.argwhere(there).tolist():
            rows.append(("S", tile, x, y, bool(on[y, x]), None if x % 2 else x))
            want[tile, x, y] = float(np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min())) if len(ys) else None
    df = spark.createDataFrame(rows, "slide_id string, tile_id int, x int, y int, m boolean, note bigint")
    got = R.distance_to_mask(df, "m", None, carry=["note"]).collect()
    assert {(r["tile_id"], r["x"], r["y"]): r["distance"] for r in got} == want
    assert all(r["note"] == (None if r["x"] % 2 else r["x"]) for r in got)
    assert R.distance_to_mask(df.limit(0), "m", None).collect() == []


def test_cell_erosion_keeps_touching_cells_apart(spark):
    cell = np.zeros((12, 12), int)
    cell[1:11, 1:6], cell[1:11, 6:11] = 1, 2
    df = tile_rows(spark, {"cell_id": cell})
    own = to_raster(R.erode_labels(df, "cell_id", 3, 1, "k", "cell"), "k", (12, 12))
    union = to_raster(R.erode_labels(df, "cell_id", 3, 1, "k", "union"), "k", (12, 12))
    assert own[5, 5] == 0 and own[5, 6] == 0 and own[5, 3] == 1
    assert union[5, 5] == 1 and union[5, 6] == 1 and union[5, 1] == 0


def flood(nuc, wall, cap):
    label = nuc.copy()
    for _ in range(cap):
        new = label.copy()
        for y in range(nuc.shape[0]):
            for x in range(nuc.shape[1]):
                if label[y, x] == 0 and not wall[y, x]:
                    near = [label[b, a] for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))
                            if 0 <= b < nuc.shape[0] and 0 <= a < nuc.shape[1] and label[b, a] > 0]
                    if near:
                        new[y, x] = min(near)
        if (new == label).all():
            break
        label = new
    return label


def test_growth_against_flood_and_invariants(spark):
    r = disc_tile()
    wall = (r["dab"] > 0.4) & ((np.indices((64, 64)).sum(axis=0)) % 9 > 0)
    df = tile_rows(spark, {**r, "wall": wall})
    small = to_raster(W.grow_regions(df, "wall", 8), "grown_id")
    large = to_raster(W.grow_regions(df, "wall", 30, extent=(64, 64)), "grown_id")
    assert (small == flood(r["nuc_id"], wall, 8)).all() and (large == flood(r["nuc_id"], wall, 30)).all()
    assert (large[r["nuc_id"] > 0] == r["nuc_id"][r["nuc_id"] > 0]).all()
    assert (large > 0).sum() >= (small > 0).sum()


def test_growth_without_nuclei_is_empty(spark):
    df = tile_rows(spark, {"nuc_id": np.zeros((8, 8), int), "prob": np.zeros((8, 8))})
    assert W.regrow_from_probability(df, cap=3).collect()[0]["n_cells"] == 0


def test_shrinking_never_eats_nuclei(tile, rasters):
    got = to_raster(W.shrink_to_membrane(tile), "refined_id")
    nuc = rasters["nuc_id"]
    assert (got[nuc > 0] == nuc[nuc > 0]).all()
    assert (got > 0).sum() < (rasters["cell_id"] > 0).sum()


@pytest.mark.parametrize("op, k, rounds", [("dilate", 7, 1), ("erode", 5, 2), ("close", 5, 1)])
def test_ellipse_over_gaps_and_blocks(spark, op, k, rounds):
    """Pixel by pixel on a raster of several blocks with missing pixels and null values; other columns travel, nulls too."""
    r = np.random.default_rng(3)
    n = 140
    there, value = r.random((n, n)) < 0.9, r.integers(0, 50, (n, n))
    rows = [("S", 1, x, y, int(value[y, x]) if (x + y) % 17 else None, None if x % 3 else f"{x}") for y in range(n) for x in range(n) if there[y, x]]
    df = spark.createDataFrame(rows, "slide_id string, tile_id bigint, x int, y int, v int, note string")
    now = {(t[2], t[3]): t[4] for t in rows if t[4] is not None}
    for one in ("dilate", "erode") if op == "close" else (op,):
        for _ in range(rounds):
            pick = min if one == "erode" else max
            now = {(x, y): pick(now[x + dx, y + dy] for dx, dy in R.ellipse_offsets(k) if (x + dx, y + dy) in now) for x, y in now}
    out = R.morph_ellipse(df, "v", op, k, rounds).collect()
    assert len(out) == len(rows) and dict(df.dtypes) | {"out": "int"} == dict(R.morph_ellipse(df, "v", op, k, rounds).dtypes)
    for t in out:
        assert t["out"] == now.get((t["x"], t["y"])) and t["note"] == (None if t["x"] % 3 else f"{t['x']}")


@pytest.mark.parametrize("width", [1, 40, 150])
def test_steps_to_either_side_give_the_envelope(width):
    """Short rows by steps alone, long ones by the envelope where steps leave them open; within a cap both agree."""
    from stainframe.functions.envelope import nearest_in_rows
    rng = np.random.default_rng(width)
    for share in (0, 0.003, 0.1):
        gap = column_gaps(rng.random((20, width)) < share)
        want = row_envelope(gap)
        assert np.array_equal(nearest_in_rows(gap), want)
        near = (want >= 0) & (want <= 81)
        assert np.array_equal(nearest_in_rows(np.where(gap > 9, NONE, gap), 9)[near], want[near])


def test_growth_stays_behind_walls_and_missing_pixels():
    nuclei = np.array([[5, 0, 0, 0], [0, 0, np.nan, 0], [-1, 0, 0, 2]])
    wall = np.array([[0, 0, 0, 1], [0, 1, np.nan, 0], [0, 0, 0, 0]])
    assert W.grown_field(nuclei, wall, 2).tolist() == [[5, 5, 5, 0], [5, 0, 0, 2], [-1, 2, 2, 2]]
    assert W.grown_field(nuclei, wall, 0).tolist() == [[5, 0, 0, 0], [0, 0, 0, 0], [-1, 0, 0, 2]]


def test_small_kernels_shift_by_neighbours(spark):
    """No range frame for a kernel of five or less; a missing pixel is zero, and its neighbour is not taken for it."""
    kernel = np.arange(1.0, 26).reshape(5, 5)
    a = np.random.default_rng(5).integers(0, 9, (7, 9)).astype(float)
    there = np.random.default_rng(6).random(a.shape) < 0.8
    rows = [("S", 1, x, y, a[y, x].item()) for y, x in np.argwhere(there).tolist()]
    df = spark.createDataFrame(rows, "slide_id string, tile_id bigint, x int, y int, v double")
    got = R.convolve_kernel(df, "v", kernel)
    assert "RangeFrame" not in got._jdf.queryExecution().executedPlan().toString()
    # A row sum is held by the pixels there are, as before.
    wide = np.pad(np.where(there, a, 0), 2)
    line = [sum(kernel[j, i] * wide[2:-2, i:i + 9] for i in range(5)) * there for j in range(5)]
    want = sum(np.pad(line[j], ((2, 2), (0, 0)))[j:j + 7] for j in range(5))
    assert all(abs(r["out"] - want[r["y"], r["x"]]) < 1e-9 for r in got.collect())
