"""Measurements without a SQL twin, against numpy on one tile."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import tile_rows
from stainframe.operators import instances as I
from stainframe.operators import matching as M
from stainframe.operators import pixels as X
from stainframe.operators import profiles as P
from stainframe.plans import jobs


def radial(dab, mask):
    """Width at half height of mean DAB by signed distance, in the cell's box."""
    ys, xs = np.nonzero(mask)
    m, d = mask[ys.min():ys.max() + 1, xs.min():xs.max() + 1], dab[ys.min():ys.max() + 1, xs.min():xs.max() + 1]
    inside, outside = np.argwhere(m), np.argwhere(~m)
    profile = [[] for _ in range(20)]
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            other = outside if m[y, x] else inside
            s = np.sqrt(((other - (y, x)) ** 2).sum(axis=1).min()) * (1 if m[y, x] else -1)
            if -15 <= s < 15:
                profile[int((s + 15) // 1.5)].append(d[y, x])
    centres = -15 + 0.75 + 1.5 * np.arange(20)
    ok = [i for i in range(20) if len(profile[i]) >= 2]
    p = np.interp(centres, centres[ok], [np.mean(profile[i]) for i in ok])
    above = p >= p.max() / 2
    steps = np.diff(above.astype(int))
    rise, fall = np.nonzero(steps == 1)[0], np.nonzero(steps == -1)[0]
    return abs((centres[fall[-1]] if len(fall) else centres[-1]) - (centres[rise[0] + 1] if len(rise) else centres[0]))


def test_radial_thickness(spark, rasters):
    y, x = np.mgrid[:64, :64]
    r = np.sqrt((x - 20) ** 2 + (y - 20) ** 2)
    smooth = dict(rasters, dab=np.where(x + y < 64, 0.6 * np.exp(-((r - 9) / 3) ** 2), rasters["dab"]))
    got = {r["cell_id"]: r["thickness_px"] for r in P.thickness_radial_fwhm(tile_rows(spark, smooth)).collect()}
    want = {i: radial(smooth["dab"], smooth["cell_id"] == i) for i in (1, 2)}
    assert want[1] > 3
    assert got == {i: pytest.approx(w) if w > 0 else None for i, w in want.items()}


def rays(dab, ring):
    pts = np.array(ring)
    side = np.sqrt(((np.roll(pts, -1, 0) - pts) ** 2).sum(axis=1))
    cum = np.concatenate([[0], np.cumsum(side)])

    def at(share):
        s = share * cum[-1]
        i = min(np.searchsorted(cum, s, side="right"), len(pts)) - 1
        return pts[i] + (pts[(i + 1) % len(pts)] - pts[i]) * ((s - cum[i]) / side[i])

    widths = []
    for i in range(16):
        f = i / 16
        p, t = at(f), at(min(1, f + 0.01)) - at(max(0, f - 0.01))
        n = np.array([-t[1], t[0]]) / (np.hypot(*t) + 1e-8)
        v = []
        for d in range(-20, 21):
            x, y = (int(round(c)) for c in p + d * n)
            v.append(dab[y, x] if 0 <= x < 64 and 0 <= y < 64 else 0.0)
        best = now = 0
        for e in v:
            now = now + 1 if e >= max(v) / 2 else 0
            best = max(best, now)
        widths.append(best)
    return np.median(widths)


def test_ray_thickness(spark, tile, rasters):
    ring = [(20.3 + 11.5 * math.cos(a), 20.2 + 11.5 * math.sin(a)) for a in np.arange(8) * math.pi / 4 + 0.1]
    poly = spark.createDataFrame([("S01", 1, 1, ring)], "slide_id string, tile_id bigint, cell_id int, ring array<struct<x:double,y:double>>")
    row = P.thickness_ray_fwhm(poly, tile).collect()[0]
    assert row["n_rays"] == 16 and row["thickness_px"] == rays(rasters["dab"], ring)


def adaptive(dab, cell, nuc, i, n_rays=16, band=3):
    ys, xs = np.nonzero(nuc == i)
    cy, cx = ys.mean(), xs.mean()
    mask, ring = cell == i, np.zeros_like(cell, bool)
    for k in range(n_rays):
        a = 2 * math.pi * k / n_rays
        px = [int(min(63, max(0, cx + math.cos(a) * d))) for d in range(1, 61)]
        py = [int(min(63, max(0, cy + math.sin(a) * d))) for d in range(1, 61)]
        inside = [j for j in range(60) if mask[py[j], px[j]]]
        if not inside or inside[-1] + 1 < 5:
            continue
        end = inside[-1] + 1
        v = [dab[py[j], px[j]] for j in range(end // 2, end)]
        peak = end // 2 + int(np.argmax(v))
        for j in range(max(0, peak - band), min(60, peak + band + 1)):
            if mask[py[j], px[j]]:
                y0, x0 = max(0, py[j] - 1), max(0, px[j] - 1)
                ring[y0:py[j] + 2, x0:px[j] + 2] |= mask[y0:py[j] + 2, x0:px[j] + 2]
    return dab[ring].mean(), dab[mask & ~(nuc == i) & ~ring].mean()


def test_adaptive_ring(tile, rasters):
    got = {r["cell_id"]: r for r in P.ring_adaptive(tile, (64, 64)).collect()}
    for i in (1, 2):
        m, c = adaptive(rasters["dab"], rasters["cell_id"], rasters["nuc_id"], i)
        assert (got[i]["membrane"], got[i]["cytoplasm"]) == pytest.approx((m, c))


def adaptive_by_rows(rows, n_rays=16, band=3):
    """`adaptive` of pixels as rows x, y, nuc_id, cell_id, dab, of which some are missing, come twice or hold nulls."""
    at = defaultdict(list)
    for r in rows:
        at[r[:2]].append(r)
    mean = lambda v: np.mean(known) if (known := [e for e in v if e is not None]) else None
    rank = lambda v: (v is not None, v)
    out = {}
    for i in {r[3] for r in rows if r[3]}:
        mine = [r for r in rows if r[3] == i]
        core = [r for r in mine if r[2] == i]
        if not core:
            continue
        cx, cy = mean([r[0] for r in core]), mean([r[1] for r in core])
        ring, used = set(), 0
        for k in range(n_rays):
            a = 2 * math.pi * k / n_rays
            p = [tuple(int(min(63, max(0, c))) for c in (cx + math.cos(a) * d, cy + math.sin(a) * d)) for d in range(1, 61)]
            inside = [j for j in range(60) if any(r[3] == i for r in at[p[j]])]
            if not inside or inside[-1] + 1 < 5:
                continue
            end = inside[-1] + 1
            looked = [(rank(max((r[4] for r in at[p[j]]), key=rank)), -j) for j in range(end // 2, end) if at[p[j]]]
            marked = [p[j] for j in inside if abs(j + max(looked)[1]) <= band]
            used += bool(marked)
            ring |= {(x + a, y + b) for x, y in marked for a in (-1, 0, 1) for b in (-1, 0, 1)}
        on = [r for r in mine if r[:2] in ring]
        cyto = [r for r in mine if r[:2] not in ring and r[2] is not None and r[2] != i]
        out[i] = (len(on), mean([r[4] for r in on]), mean([r[4] for r in core]), mean([r[4] for r in cyto]), used)
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_adaptive_ring_of_odd_rows(spark, rasters, monkeypatch, block):
    """Whole or in blocks, pixels that are missing, come twice or hold nulls count as in a join of rows."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng, rows = np.random.default_rng(3), []
    for y, x in np.ndindex(64, 64):
        for again in range(rng.choice([0, 1, 2], p=[0.1, 0.8, 0.1])):
            row = [x, y, *(rasters[k][y, x].item() for k in ("nuc_id", "cell_id", "dab"))]
            if again:
                row[3:] = int(rng.integers(0, 3)), float(rng.random())
            if rng.random() < 0.1:
                row[rng.integers(0, 5)] = None
            rows.append(tuple(row))
    # A cell that reaches further than its rays, so that no block sees all of it.
    rows += [(x, 63 + y, 3 if x < 2 else 0, 3, 0.1 * y) for x in range(200) for y in range(5)]
    px = spark.createDataFrame([("S", 1, *r) for r in rows] + [(None, 1, *r) for r in rows],
                               "slide_id string, tile_id bigint, x int, y int, nuc_id int, cell_id int, dab double")
    got = {r[2]: tuple(r)[3:] for r in P.ring_adaptive(px, (64, 64)).collect()}
    want = adaptive_by_rows(rows)
    assert set(got) == set(want) == {1, 2, 3}
    for i, v in want.items():
        assert got[i] == (v[0], *(pytest.approx(e) for e in v[1:4]), v[4])


def test_filter_refuses_nan(spark, rasters):
    bad = dict(rasters, dab=np.where(rasters["cell_id"] == 1, np.nan, rasters["dab"]))
    with pytest.raises(Exception, match="NaN"):
        I.filter_cells(tile_rows(spark, bad)).collect()


def test_filter_on_empty_tile(spark):
    zero = np.zeros((8, 8), int)
    df = tile_rows(spark, {"nuc_id": zero, "cell_id": zero, "dab": zero.astype(float)})
    assert I.filter_cells(df).count() == 0
    assert I.tile_stats(df).collect()[0]["num_cells"] == 0


def test_greedy_matching_below_half(spark):
    # p=2 has the best pair and takes g=1; p=1 then takes what is left of its list.
    rows = [("S", 1, 1, 1, 0.45), ("S", 1, 1, 2, 0.31), ("S", 1, 2, 1, 0.48), ("S", 1, 3, 2, 0.30)]
    pairs = spark.createDataFrame(rows, "slide_id string, tile_id bigint, p int, g int, iou double")
    got = {(r["p"], r["g"]) for r in M.match_instances(pairs, 0.3).collect()}
    assert got == {(2, 1), (1, 2)}


def test_consensus_instances(spark):
    a, b, c = np.zeros((10, 10), int), np.zeros((10, 10), int), np.zeros((10, 10), int)
    a[1:5, 1:5], b[1:5, 2:6], c[1:5, 1:6] = 1, 4, 2
    a[7:9, 7:9] = 2  # one model only
    df = None
    for name, raster in (("A", a), ("B", b), ("C", c)):
        part = tile_rows(spark, {"inst_id": raster}).withColumn("model", F.lit(name))
        df = part if df is None else df.unionByName(part)
    got = {(r["x"], r["y"], r["consensus_id"]) for r in M.consensus_instances(df).collect()}
    votes = (a == 1).astype(int) + (b == 4) + (c == 2)
    assert got == {(x, y, 1) for y, x in np.argwhere(votes >= 1.5)}


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(40)], "k int, node int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(39) if i != 20], "k int, a int, b int")
    got = {r["node"]: r["component"] for r in M.connected_components(nodes, edges, ["k"]).collect()}
    assert all(got[i] == (0 if i <= 20 else 21) for i in range(40))


def test_jobs_move_pixels_few_times(spark, tile, tmp_path):
    """On a stored pixel table the measuring job has two shuffles of pixels, the ring operator on placed pixels one."""
    path = str(tmp_path / "pixels")
    tile.write.parquet(path)
    pixels = spark.read.parquet(path)

    def shuffles(df):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        return sum("Exchange hashpartitioning" in line for line in plan.splitlines())

    assert shuffles(jobs.measure_cells(pixels)) <= 2
    assert shuffles(I.ring_fixed(X.by_tile(pixels))) <= 1
