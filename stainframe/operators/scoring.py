"""Roll-ups of graded cells to region, slide and cohort level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainframe.constants import CALIBRATION_MIN, CALIBRATION_RANGES, GRADE_CUTS, MORPHOMETRIC_FILTERS, PATIENT
from stainframe.functions import grading as G
from stainframe.functions.ordering import exact_percentiles, join_on, percentile_batch


def with_grade(cells: DataFrame) -> DataFrame:
    """`grade` taken from the table where it is there, else its stored `grade_dab`, else from membrane intensity."""
    stored = [F.col(c) for c in ("grade", "grade_dab") if c in cells.columns]
    return cells.withColumn("grade", F.coalesce(*stored, G.grade_dab("membrane_ring_dab")))


def thickness_um(cells: DataFrame, mpp: float | Column = 0.5) -> Column:
    """The stored thickness in micrometres where the table has one, else the pixels' at `mpp`."""
    computed = F.col("membrane_thickness_px") * mpp
    return F.coalesce(F.col("membrane_thickness_um"), computed) if "membrane_thickness_um" in cells.columns else computed


def scores(grade: str = "grade") -> list[Column]:
    return [
        *G.grade_counts(grade), G.h_score(grade).alias("h_score"),
        G.pct_at_least(grade).alias("pct_positive"), G.pct_at_least(grade, 3).alias("pct_3plus"),
    ]


def score_by(cells: DataFrame, keys: Sequence[str], denominator: str = "all") -> DataFrame:
    """Scores per group. `denominator="measured"` leaves cells without a membrane value out."""
    graded = with_grade(cells)
    if denominator == "measured":
        graded = graded.filter(F.col("membrane_ring_dab").isNotNull())
    out = graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), *scores())
    return out.withColumn("eligible", G.eligible("pct_positive"))


def region_stats(cells: DataFrame) -> DataFrame:
    return with_grade(cells).groupBy("slide_id", "region").agg(
        F.count(F.lit(1)).alias("n_cells"), G.h_score("grade").alias("h_score"),
        G.pct_at_least("grade").alias("pct_positive"), G.pct_at_least("grade", 3).alias("pct_3plus"),
        F.avg("membrane_ring_dab").alias("mean_membrane_dab"),
        F.avg("membrane_completeness").alias("mean_completeness"),
        F.avg("membrane_thickness_px").alias("mean_thickness_px"))


def slide_summary(cells: DataFrame, region: str = PATIENT, mpp: float | Column = 0.5) -> DataFrame:
    """One row per slide over its cells of `region`, or over all its cells if it has none there.

    `mpp` is a number, or a column of `cells` for slides of different scale.

    Cells are aggregated by (slide, in region) in one pass; the row to keep is chosen afterwards from
    at most two per slide, so the fallback costs no window over a slide's cells.
    """
    graded = with_grade(cells).withColumn("_hit", F.coalesce(F.col("region") == region, F.lit(False)))
    measured = F.col("membrane_ring_dab")
    sums = graded.groupBy("slide_id", "_hit").agg(
        F.count(F.lit(1)).alias("total_cells"), *G.grade_counts("grade"),
        G.pct_at_least("grade").alias("pct_2plus"), G.h_score("grade").alias("h_score"),
        F.coalesce(F.avg(measured), F.lit(0.0)).alias("mean_membrane_dab"),
        F.count(measured).alias("n_measured"),
        F.coalesce(F.avg("membrane_completeness"), F.lit(0.0)).alias("mean_completeness"),
        F.coalesce(F.avg(thickness_um(cells, mpp)), F.lit(0.0)).alias("mean_thickness_um"),
        F.coalesce(F.avg("raw_membrane_dab"), F.lit(0.0)).alias("mean_raw_dab"))
    fields = [c for c in sums.columns if c != "slide_id"]
    chosen = (sums.groupBy("slide_id").agg(F.max_by(F.struct(*fields), "_hit").alias("s"))
              .select("slide_id", "s.*"))
    medians = exact_percentiles(graded, ["slide_id", "_hit"], measured, {"median_membrane_dab": 0.5})
    out = join_on(chosen, medians, ["slide_id", "_hit"], "left").drop("_hit")
    return out.withColumns({
        "median_membrane_dab": F.coalesce(F.col("median_membrane_dab"), F.lit(0.0)),
        "pct_measured": G.share(F.col("n_measured"), F.col("total_cells")) * 100,
        "has_membrane": F.col("n_measured") > 0,
        "eligible": G.eligible("pct_2plus"),
    })


def thickness_summary(cells: DataFrame, mpp: float | Column = 0.5) -> DataFrame:
    """Thickness and grade figures per slide and per slide and region; `level` is `slide` or `region`.

    A region may be null by itself, so the level, not the region, tells the whole slide from a part.
    """
    graded = with_grade(cells).select("slide_id", "region", "grade", "membrane_thickness_px", thickness_um(cells, mpp).alias("_um"))
    t = F.col("membrane_thickness_px")
    level = F.when(F.grouping("region") == 1, "slide").otherwise("region").alias("level")
    sums = graded.groupingSets([["slide_id"], ["slide_id", "region"]], "slide_id", "region").agg(
        level,
        F.count(F.lit(1)).alias("n_cells"), F.count(t).alias("thickness_valid"),
        F.avg(t).alias("mean_px"), F.stddev_pop(t).alias("std_px"), F.avg("_um").alias("mean_um"),
        *G.grade_counts("grade"), G.h_score("grade").alias("h_score"),
        G.pct_at_least("grade").alias("pct_positive"))
    probs = {"p5": 0.05, "p25": 0.25, "median_px": 0.5, "p75": 0.75, "p95": 0.95}
    cuts = percentile_batch(graded, [["slide_id"], ["slide_id", "region"]], {k: ("membrane_thickness_px", p) for k, p in probs.items()})
    cuts = cuts.withColumn("level", F.when(F.col("_set") == 0, "slide").otherwise("region")).drop("_set")
    out = join_on(sums, cuts, ["slide_id", "region", "level"], "left")
    return out.withColumn(
        "coverage_pct", G.share(F.col("thickness_valid"), F.col("n_cells")) * 100)


def calibrate_thresholds(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Grade cut-points from the quartiles of membrane intensity, kept in range; few cells: defaults."""
    keys = list(keys)
    value = F.col("membrane_ring_dab")
    n = cells.groupBy(*keys).agg(F.count(value).alias("n_values"))
    q = exact_percentiles(cells, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    joined = join_on(n.withColumn("_k", F.lit(0)), q.withColumn("_k", F.lit(0)), [*keys, "_k"], "left").drop("_k")
    cuts = {}
    for i, ((low, high), default) in enumerate(zip(CALIBRATION_RANGES, GRADE_CUTS), start=1):
        kept = F.greatest(F.lit(low), F.least(F.col(f"q{i}"), F.lit(high)))
        few = (F.col("n_values") < CALIBRATION_MIN) | F.col(f"q{i}").isNull()
        cuts[f"t{i}"] = F.when(few, F.lit(default)).otherwise(kept)
    return joined.withColumns(cuts).drop("q1", "q2", "q3")


def aspect_ratio() -> Column:
    return F.col("max_diameter_um") / F.greatest(F.col("min_diameter_um"), F.lit(0.01))


def solidity() -> Column:
    return F.least(F.col("solidity"), F.lit(1.0))


def passes_morphometry(min_area: float, min_solidity: float, max_aspect: float | None) -> Column:
    """A limit of zero, or no aspect limit, switches that test off."""
    test = F.lit(True)
    if min_area > 0:
        test = test & (F.col("area_um2") >= min_area)
    if min_solidity > 0:
        test = test & (solidity() >= min_solidity)
    if max_aspect is not None:
        test = test & (aspect_ratio() <= max_aspect)
    return test


def morphometric_filter(
    cells: DataFrame, min_area: float = 25.0, min_solidity: float = 0.9, max_aspect: float | None = 2.5
) -> DataFrame:
    return cells.filter(passes_morphometry(min_area, min_solidity, max_aspect))


def morphometric_sensitivity(cells: DataFrame, filters=MORPHOMETRIC_FILTERS) -> DataFrame:
    """Scores of every slide under each named filter.

    All filters are conditional aggregates of one pass; the wide row is then unfolded, so cells are
    neither copied per filter nor read again.
    """
    graded = with_grade(cells)
    parts = []
    for name, area, sol, aspect in filters:
        g = F.when(passes_morphometry(area, sol, aspect), F.col("grade"))
        parts.append(F.struct(
            F.lit(name).alias("filter"), F.count(g).alias("total_after"), G.h_score(g).alias("h_score"),
            G.pct_at_least(g).alias("pct_positive"), *G.grade_counts(g)))
    wide = graded.groupBy("slide_id").agg(F.count(F.lit(1)).alias("total_before"), F.array(*parts).alias("_f"))
    out = wide.select("slide_id", "total_before", F.explode("_f").alias("_f")).select(
        "slide_id", "total_before", "_f.*")
    return out.withColumn("pct_retained", G.share(F.col("total_after"), F.col("total_before")) * 100)


def morphometric_summary(cells: DataFrame) -> DataFrame:
    c = cells.withColumns({"_sol": solidity(), "_asp": aspect_ratio()})
    pct = lambda test: F.lit(100.0) * F.avg(test.cast("int"))
    sums = c.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("area_um2").alias("area_mean"),
        F.avg("_sol").alias("solidity_mean"), pct(F.col("_sol") < 0.9).alias("solidity_below_09_pct"),
        pct(F.col("solidity") > 1.0).alias("solidity_above_1_pct"), F.avg("_asp").alias("aspect_mean"),
        pct(F.col("_asp") > 2.0).alias("aspect_above_2_pct"), pct(F.col("_asp") > 2.5).alias("aspect_above_25_pct"))
    cuts = {"area_p5": 0.05, "area_p25": 0.25, "area_median": 0.5, "area_p75": 0.75, "area_p95": 0.95}
    cuts = percentile_batch(c, [["slide_id"]], {
        **{k: ("area_um2", p) for k, p in cuts.items()}, "solidity_median": ("_sol", 0.5), "aspect_median": ("_asp", 0.5), "aspect_p95": ("_asp", 0.95)})
    return sums.join(cuts.drop("_set"), "slide_id", "left")


def feature_histogram(cells: DataFrame, bins: int = 50) -> DataFrame:
    """Density histograms of area, solidity and aspect per slide; `bins` equal bins from min to max."""
    long = cells.select("slide_id", F.explode(F.array(
        F.struct(F.lit("area_um2").alias("feature"), F.col("area_um2").alias("v")),
        F.struct(F.lit("solidity").alias("feature"), solidity().alias("v")),
        F.struct(F.lit("aspect_ratio").alias("feature"), F.least(aspect_ratio(), F.lit(6.0)).alias("v")),
    )).alias("f")).select("slide_id", "f.feature", "f.v").filter(F.col("v").isNotNull())
    # Equal values are counted first, so the bounds join and the bins see distinct values only.
    counts = long.groupBy("slide_id", "feature", "v").agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.groupBy("slide_id", "feature").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    placed = counts.join(bounds, ["slide_id", "feature"]).withColumn("width", width)
    # A hair is added before the floor so that a value on a bin edge lands above it in every engine.
    at = F.floor((F.col("v") - F.col("lo")) / F.col("width") + F.lit(1e-9))
    placed = placed.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    return placed.groupBy("slide_id", "feature", "bin").agg(
        F.sum("n").alias("n"), (F.sum("n") / F.first("total") / F.first("width")).alias("density"))
