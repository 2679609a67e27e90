"""Order, percentile and radius helpers, with one group that holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stainframe.functions.ordering import full_join_on, percentile_batch, exact_percentiles, rank_within, running_totals, seeded_order, top_n
from stainframe.functions.spatial import exists_within
from stainframe.operators import grids as D
from stainframe.operators import tiling as T
from stainframe.operators.cohorts import paired_agreement, t_test_p
from stainframe.operators.placement import dedup_hybrid


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(4000) < 0.7, "hot", rng.choice(["a", "b", "c"], 4000))
    values = np.where(rng.random(4000) < 0.4, 0.25, np.round(rng.normal(0, 3, 4000), 3))
    rows = [(str(k), float(v), i) for i, (k, v) in enumerate(zip(keys, values))]
    return spark.createDataFrame(rows, "k string, v double, i int").repartition(6).cache(), rows


def test_percentiles_equal_numpy(skewed):
    df, rows = skewed
    probs = {"p0": 0.0, "p2": 0.02, "p50": 0.5, "p98": 0.98, "p100": 1.0}
    for r in exact_percentiles(df, ["k"], "v", probs).collect():
        mine = [v for k, v, _ in rows if k == r["k"]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(mine, 100 * p), abs=1e-12)
    whole = exact_percentiles(df, [], "v", probs).collect()[0]
    assert whole["p98"] == pytest.approx(np.percentile([v for _, v, _ in rows], 98), abs=1e-12)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert exact_percentiles(empty, ["k"], "v", {"m": 0.5}).count() == 0


def test_ranks_and_totals(skewed):
    df, rows = skewed
    got = {r["i"]: (r["rank"], r["group_size"]) for r in rank_within(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for key in ("hot", "a"):
        mine = sorted((v, i) for k, v, i in rows if k == key)
        for n, (_, i) in enumerate(mine):
            assert got[i] == (n, len(mine))
    run = running_totals(df, [F.col("i")], {"s": F.col("i").cast("bigint")}).orderBy("i").collect()
    assert [r["s"] for r in run] == list(np.cumsum(range(4000))) and run[0]["s_total"] == sum(range(4000))


@pytest.mark.parametrize("n", [5, 1500])
def test_top_n(skewed, n):
    df, rows = skewed
    got = top_n(df, ["k"], [F.col("v"), F.col("i")], n).collect()
    for key in ("hot", "b"):
        want = sorted((v, i) for k, v, i in rows if k == key)[:n]
        assert sorted((r["v"], r["i"]) for r in got if r["k"] == key) == want


def test_seeded_order_is_stable(spark):
    df = spark.range(5).select(seeded_order(42, "id").alias("h"))
    import hashlib
    assert [r["h"] for r in df.collect()] == [hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(5)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_radius_lookup_with_a_crowd(spark, inclusive):
    rng = np.random.default_rng(5)
    spread = rng.integers(0, 300, (250, 2))
    crowd = rng.integers(100, 104, (250, 2))
    a, b = np.vstack([spread, crowd]), np.vstack([rng.integers(0, 300, (120, 2)), rng.integers(99, 106, (120, 2))])
    left = spark.createDataFrame([("S", i, float(x), float(y)) for i, (x, y) in enumerate(a)], "slide_id string, i int, x double, y double")
    right = spark.createDataFrame([("S", float(x), float(y)) for x, y in b], "slide_id string, x double, y double")
    got = {r["i"]: r["near"] for r in exists_within(left, right, ["slide_id"], 5.0, inclusive).collect()}
    d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2).min(axis=1)
    assert len(got) == len(a)
    assert all(got[i] == bool(d <= 25 if inclusive else d < 25) for i, d in enumerate(d2))


def test_dedup_keeps_centres_and_orphans(spark):
    rows = [("S", 1, 10.0, 10.0, True), ("S", 2, 13.0, 14.0, False), ("S", 3, 13.1, 14.0, False), ("T", 4, 10.0, 10.0, False)]
    cells = spark.createDataFrame(rows, "slide_id string, cell_id int, centroid_x double, centroid_y double, is_center boolean")
    assert {r["cell_id"] for r in dedup_hybrid(cells, 5.0).collect()} == {1, 3, 4}


def test_t_statistic_and_p(spark):
    # Known tail areas of Student's t.
    df = spark.createDataFrame([(2.0, 10.0, 0.073388), (0.0, 5.0, 1.0), (3.169, 10.0, 0.0100), (17.4646, 122.0, 0.0)], "t double, d double, p double")
    for r in df.withColumn("got", t_test_p(F.col("t"), F.col("d"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-5)
    # The recorded mean and population deviation give the recorded statistic.
    assert 112.4265 / (71.3943 / 123**0.5) == pytest.approx(17.4646, abs=1e-3)
    few = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert paired_agreement(few).collect()[0]["paired_t"] is None


def test_slides_of_different_size_and_scale_have_their_own_grid(spark):
    cells = spark.range(4000).selectExpr(
        "if(id % 2 = 0, 'A', 'B') AS slide_id", "id AS cell_id", "CAST((id * 37) % 900 AS double) AS centroid_x", "CAST((id * 91) % 700 AS double) AS centroid_y",
        "CAST(id % 4 AS int) AS grade", "if(id % 2 = 0, 0.05D, 0.1D) AS scale", "if(id % 2 = 0, 40, 85) AS width", "if(id % 2 = 0, 30, 66) AS height",
        "if(id % 2 = 0, 2.0D, 4.0D) AS downsample")
    squares = D.scatter_to_grid(cells, "grade", "scale", "width", "height")
    tissue = squares.select("slide_id", "gx", "gy")
    last = D.grid_last_writer(cells, "grade", "cell_id", "scale", "width", "height")
    grades = D.grid_grade(cells, tissue, "scale", "width", "height")
    bins = T.tile_bins(cells, F.col("downsample"))
    for slide, scale, w, h, step in (("A", 0.05, 40, 30, 2.0), ("B", 0.1, 85, 66, 4.0)):
        one, own = cells.filter(F.col("slide_id") == slide), lambda df: df.filter(F.col("slide_id") == slide)  # noqa: E731, B023
        same = lambda a, b: sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
        assert same(own(squares), D.scatter_to_grid(one, "grade", scale, w, h))
        assert same(own(last), D.grid_last_writer(one, "grade", "cell_id", scale, w, h))
        assert same(own(grades), D.grid_grade(one, tissue, scale, w, h))
        assert same(own(bins), T.tile_bins(one, step))


def test_percentiles_of_many_columns_and_groupings_at_once(spark):
    r = np.random.default_rng(8)
    rows = [(None if i % 11 == 0 else f"S{i % 3}", ["a", "b", None][i % 5 % 3], float(r.normal()) if i % 7 else None, float(r.integers(0, 4)), None)
            for i in range(500)]
    df = spark.createDataFrame(rows, "slide string, region string, u double, v double, w double")
    wanted = {"u10": ("u", 0.1), "u50": ("u", 0.5), "v50": ("v", 0.5), "v99": ("v", 0.99), "w50": ("w", 0.5)}
    got = {(g["_set"], g["slide"], g["region"]): g for g in percentile_batch(df, [["slide"], ["slide", "region"], []], wanted).collect()}
    groups = {}
    for slide, region, u, v, _ in rows:
        for key in ((0, slide, None), (1, slide, region), (2, None, None)):
            groups.setdefault(key, []).append((u, v))
    assert set(got) == set(groups)
    for key, own in groups.items():
        u, v = [x for x, _ in own if x is not None], [x for _, x in own]
        want = [np.quantile(u, 0.1), np.quantile(u, 0.5), np.quantile(v, 0.5), np.quantile(v, 0.99)]
        assert np.allclose([got[key][k] for k in ("u10", "u50", "v50", "v99")], want) and got[key]["w50"] is None


def test_full_join_meets_nulls(spark):
    a = spark.createDataFrame([("x", None, 1), ("x", "p", 2), (None, None, 3)], "s string, r string, a int")
    b = spark.createDataFrame([("x", None, 4), (None, None, 5), ("y", None, 6)], "s string, r string, b int")
    df = full_join_on(a, b, ["s", "r"])
    assert {tuple(g) for g in df.collect()} == {("x", None, 1, 4), ("x", "p", 2, None), (None, None, 3, 5), ("y", None, None, 6)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_maximum():
    r = np.random.default_rng(2)
    for n, back, front in ((1, 0, 0), (1, 6, 5), (7, 2, 3), (40, 6, 5), (40, 0, 4), (13, 12, 12)):
        a = r.normal(size=(n, 3))
        a[r.random(a.shape) < 0.2] = -np.inf
        want = np.stack([a[max(0, i - back):i + front + 1].max(axis=0) for i in range(n)])
        assert np.array_equal(D.running_max(a, back, front), want)


def test_grid_filters_do_not_see_blocks(spark, monkeypatch):
    """A grid cut into small blocks gives the same as a whole one, and both the same as plain arrays."""
    r = np.random.default_rng(5)
    rows = [("S", int(x), int(y), float(v)) for x, y, v in zip(r.integers(0, 90, 60), r.integers(0, 70, 60), r.random(60))]
    grid = spark.createDataFrame(list({(s, x, y): (s, x, y, v) for s, x, y, v in rows}.values()), "slide_id string, gx bigint, gy bigint, v double")
    def own(df):
        return {(g["gx"], g["gy"]): g["v"] for g in df.collect()}
    whole = [own(D.fill_gaps(grid, 90, 70)), own(D.smooth(grid, 90, 70)), own(D.grid_gap_fill_smooth(grid, D.smooth(grid, 90, 70, 20.0), 90, 70))]
    monkeypatch.setattr(D, "BLOCK", 16)
    cut = [own(D.fill_gaps(grid, 90, 70)), own(D.smooth(grid, 90, 70)), own(D.grid_gap_fill_smooth(grid, D.smooth(grid, 90, 70, 20.0), 90, 70))]
    for a, b in zip(whole, cut):
        assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    want = {}
    for g in grid.collect():
        for dx in range(-5, 7):
            for dy in range(-5, 7):
                k = (g["gx"] + dx, g["gy"] + dy)
                if 0 <= k[0] < 90 and 0 <= k[1] < 70:
                    want[k] = max(want.get(k, 0.0), g["v"])
    assert whole[0] == want


def test_density_map_of_few_cells(spark):
    cells = spark.createDataFrame([("A", 10.5, 10.5), ("A", 10.9, 10.1), ("A", 30.0, 12.0), ("B", -5.0, 3.0)], "slide_id string, centroid_x double, centroid_y double")
    tissue = spark.createDataFrame([(s, x, y) for s in "AB" for x in range(40) for y in range(25)], "slide_id string, gx bigint, gy bigint")
    got = {(g["gx"], g["gy"]): g for g in D.density_map(cells, tissue, 1.0, 40, 25, radius=2, size=4, sigma=1.0).collect()}
    assert max(g["v"] for g in got.values()) == 1.0 and not got[20, 24]["shown"] if (20, 24) in got else True
    assert got[10, 10]["v"] > 0.9 and got[30, 12]["v"] > 0.9 and got[10, 10]["shown"] and {g["slide_id"] for g in got.values()} == {"A"}
    a, b = (D.density_map(cells.filter(f"slide_id = 'A' AND centroid_x {c} 20"), tissue, 1.0, 40, 25).agg(F.sum("v")).first()[0] for c in "<>")
    assert a > 0 and b > 0
    plan = D.density_map(cells, tissue, 1.0, 40, 25)._jdf.queryExecution().executedPlan().toString()
    assert "Nested" not in plan
