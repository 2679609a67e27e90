"""Comparing cohorts, regions, pipelines and models from per-slide, per-tile or per-cell figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stainframe.constants import CONTROL, DAB_LEVELS, FLIPS, PATIENT
from stainframe.functions import grading as G
from stainframe.functions.lineage import cut_lineage
from stainframe.functions.ordering import exact_percentiles, full_join_on, percentile_batch, running_totals

COUNT_NAMES = ("negative", "weak_1plus", "moderate_2plus", "strong_3plus")


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson r over rows that have both, null where either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def baseline_summary(baseline: DataFrame, region: str = PATIENT) -> DataFrame:
    """Baseline rows of one region with the share of cells graded 2 or more and eligibility."""
    strong = F.col("moderate_2plus") + F.col("strong_3plus")
    out = baseline.filter(F.col("region") == region).withColumn(
        "pct_2plus", G.share(strong, F.col("total_cells")) * 100)
    return out.withColumn("eligible", G.eligible("pct_2plus"))


def compare_cohorts(baseline: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row per slide of either side, with both sides' figures, deltas and the eligibility flip."""
    bl_fields = ("total_cells", "pct_positive", "pct_2plus", "h_score", "mean_dab_od", *COUNT_NAMES, "eligible")
    co_fields = ("total_cells", "pct_2plus", "h_score", "mean_membrane_dab", "mean_raw_dab", "mean_completeness",
                 "mean_thickness_um", *COUNT_NAMES, "eligible", "has_membrane", "n_measured", "pct_measured")
    rename = {"mean_dab_od": "mean_dab"}
    b = baseline.select(F.col("slide_name").alias("slide_id"), F.lit(True).alias("_b"),
                        *[F.col(c).alias(f"bl_{rename.get(c, c)}") for c in bl_fields])
    c = cohort.select("slide_id", F.lit(True).alias("_c"), *[F.col(c).alias(f"co_{c}") for c in co_fields])
    out = full_join_on(b, c, ["slide_id"])
    both = F.col("_b").isNotNull() & F.col("_c").isNotNull()
    was, now = F.col("bl_eligible"), F.col("co_eligible")
    return out.withColumns({
        "in_baseline": F.col("_b").isNotNull(), "in_cohort": F.col("_c").isNotNull(),
        **{f"delta_{k}": F.col(f"co_{k}") - F.col(f"bl_{k}") for k in ("total_cells", "pct_2plus", "h_score")},
        "eligibility_flip": F.when(~both, "MISSING_DATA").when(was & ~now, "LOST").when(~was & now, "GAINED")
        .when(was & now, "BOTH_ELIGIBLE").otherwise("BOTH_NOT_ELIGIBLE"),
    }).drop("_b", "_c")


def eligibility_flips(comparison: DataFrame) -> DataFrame:
    return comparison.filter(F.col("eligibility_flip").isin("GAINED", "LOST"))


def flip_distribution(comparison: DataFrame) -> DataFrame:
    """Slides per flip class, zero for the classes that do not occur, by one aggregate."""
    one = comparison.agg(F.array(*[
        F.struct(F.lit(f).alias("eligibility_flip"), F.count_if(F.col("eligibility_flip") == f).alias("n_slides"))
        for f in FLIPS]).alias("_f"))
    return one.select(F.explode("_f").alias("_f")).select("_f.*")


def cohort_summary(comparison: DataFrame) -> DataFrame:
    """One row: counts, rates, concordance, cell counts, correlation and mean absolute error.

    The comparison is a row a slide; it is computed once and kept, since means and medians both need it.
    """
    comparison = cut_lineage(comparison)
    flip = F.col("eligibility_flip")
    both = F.col("in_baseline") & F.col("in_cohort")
    n_both = F.count_if(both)
    pct = lambda part, whole: F.lit(100.0) * part / F.greatest(whole, F.lit(1))

    def matched(c: str) -> Column:
        return F.when(both, F.col(c).cast("double"))

    def agreement(name: str) -> list[Column]:
        a, b = matched(f"bl_{name}"), matched(f"co_{name}")
        return [F.when(n_both >= 3, correlation(a, b)).alias(f"{name}_correlation"),
                F.when(n_both >= 3, F.avg(F.abs(a - b))).alias(f"{name}_mae")]

    bl, co = F.count_if(F.col("in_baseline")), F.count_if(F.col("in_cohort"))
    bl_yes, co_yes = F.count_if(F.col("bl_eligible")), F.count_if(F.col("co_eligible"))
    same = F.count_if(flip.isin("BOTH_ELIGIBLE", "BOTH_NOT_ELIGIBLE"))
    out = comparison.agg(
        bl.alias("bl_slides"), bl_yes.alias("bl_eligible"), pct(bl_yes, bl).alias("bl_eligible_pct"),
        co.alias("co_slides"), co_yes.alias("co_eligible"), pct(co_yes, co).alias("co_eligible_pct"),
        F.count_if(F.col("co_has_membrane")).alias("co_with_membrane"),
        F.coalesce(F.sum("co_total_cells"), F.lit(0)).alias("co_cells"),
        F.coalesce(F.sum("co_n_measured"), F.lit(0)).alias("co_measured"),
        n_both.alias("n_matched"), same.alias("n_concordant"),
        F.count_if(flip.isin("GAINED", "LOST")).alias("n_discordant"), pct(same, n_both).alias("concordance_pct"),
        F.count_if(flip == "GAINED").alias("n_gained"), F.count_if(flip == "LOST").alias("n_lost"),
        F.coalesce(F.avg(matched("bl_total_cells")), F.lit(0.0)).alias("bl_mean_cells"),
        F.coalesce(F.avg(matched("co_total_cells")), F.lit(0.0)).alias("co_mean_cells"),
        *agreement("pct_2plus"), *agreement("h_score"))
    medians = percentile_batch(comparison.filter(both), [[]], {
        "bl_median_cells": ("bl_total_cells", 0.5), "co_median_cells": ("co_total_cells", 0.5)})
    return (out.withColumn("_set", F.lit(0)).join(medians, "_set", "left").drop("_set")
            .fillna(0.0, ["bl_median_cells", "co_median_cells"]))


def region_concordance(stats: DataFrame, first: str = PATIENT, second: str = CONTROL) -> DataFrame:
    """Per slide, the H-score and positivity of two regions against each other; no control: infinite ratio."""
    def of(region: str, c: str) -> Column:
        return F.max(F.when(F.col("region") == region, F.col(c)))

    out = stats.filter(F.col("region").isin(first, second)).groupBy("slide_id").agg(
        of(first, "h_score").alias("h_patient"), of(second, "h_score").alias("h_control"),
        of(first, "pct_positive").alias("p_patient"), of(second, "pct_positive").alias("p_control"))
    ratio = F.when(F.col("h_control") > 0, F.col("h_patient") / F.col("h_control")).otherwise(F.lit(float("inf")))
    return out.filter(F.col("h_patient").isNotNull() & F.col("h_control").isNotNull()).select(
        "slide_id", (F.col("h_patient") - F.col("h_control")).alias("h_score_diff"),
        (F.col("p_patient") - F.col("p_control")).alias("pct_pos_diff"), ratio.alias("h_score_ratio"))


def baseline_by_region(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    b = baseline.select(F.col("slide_name").alias("slide_id"), "region",
                        F.col("total_cells").alias("bl_n_cells"), F.col("h_score").alias("bl_h_score"),
                        F.col("pct_positive").alias("bl_pct_positive"))
    return stats.join(b, ["slide_id", "region"], "left")


def compare_pipelines(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per slide and region: cell counts of two runs, and scores of the second on its measured cells."""
    keys = ["slide_id", "region"]
    m = F.col("membrane_ring_dab")
    g = F.when(m.isNotNull(), G.grade_dab(m))
    pct = lambda v: F.lit(100.0) * F.avg((g == v).cast("int"))
    a = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("v1_cells"))
    b = second.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("v2_cells"), F.count(m).alias("n_measured"), F.avg(m).alias("ring_mean"),
        F.stddev_pop(m).alias("ring_std"), (F.lit(100.0) * F.avg(g)).alias("h_score"),
        (F.lit(100.0) * F.avg((g >= 2).cast("int"))).alias("pct_positive"),
        pct(0).alias("pct_negative"), pct(1).alias("pct_1plus"), pct(2).alias("pct_2plus"), pct(3).alias("pct_3plus"),
        F.avg("dab_mean").alias("whole_cell_dab"))
    # The ratio is that of two runs that both have the region; a run without it counts zero cells, not a ratio of zero.
    out = full_join_on(a, b, keys).withColumn("cell_ratio", F.try_divide(F.col("v2_cells").cast("double"), F.col("v1_cells")))
    return out.fillna(0, ["v1_cells", "v2_cells", "n_measured"])


def detections_by_level(tiles: DataFrame) -> DataFrame:
    """Per DAB level: tiles, mean, median and total detections of two models, and their ratios.

    `tiles`: `dab_level, dab_positive_fraction, ours, base`. All four levels are always present.
    """
    t = tiles.withColumn("ratio", F.when(F.col("base") > 0, F.col("ours") / F.col("base")).otherwise(F.lit(0.0)))
    sums = t.groupBy("dab_level").agg(
        F.count(F.lit(1)).alias("tiles"), F.avg("ours").alias("ours_mean"), F.avg("base").alias("base_mean"),
        F.sum("ours").alias("ours_total"), F.sum("base").alias("base_total"),
        (F.lit(100.0) * F.avg("dab_positive_fraction")).alias("mean_dab_positive_pct"))
    medians = percentile_batch(t, [["dab_level"]], {f"{c}_median": (c, 0.5) for c in ("ours", "base", "ratio")})
    sums = sums.join(medians.drop("_set"), "dab_level", "left")
    sums = sums.withColumn("ratio_mean", F.when(F.col("base_mean") > 0, F.col("ours_mean") / F.col("base_mean"))
                           .otherwise(F.lit(float("inf"))))
    levels = tiles.sparkSession.createDataFrame([(n,) for n, _ in DAB_LEVELS], "dab_level string")
    numbers = [c for c in sums.columns if c != "dab_level"]
    return levels.join(sums, "dab_level", "left").fillna(0, numbers)


def selectivity_verdict(negative_ratio: str | Column, overall_ratio: str | Column) -> list[Column]:
    n = F.col(negative_ratio) if isinstance(negative_ratio, str) else negative_ratio
    o = F.col(overall_ratio) if isinstance(overall_ratio, str) else overall_ratio
    return [
        F.when(n < 0.10, "STRONGLY CONFIRMED").when(n < 0.30, "PARTIALLY CONFIRMED").otherwise("REJECTED")
        .alias("negative_verdict"),
        F.when(o < 0.05, "STRONGLY DAB-SELECTIVE (near-zero H&E detections)")
        .when(o < 0.20, "MOSTLY DAB-SELECTIVE (few H&E detections)")
        .when(o < 0.50, "PARTIALLY DAB-SELECTIVE (moderate H&E detections)")
        .otherwise("NOT DAB-SELECTIVE (detects H&E cells freely)").alias("overall_verdict"),
    ]


def detections_by_group(detections: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean, median and total detections per tile group and model, and each model against the first.

    `detections`: `grp, tile, model, n`.
    """
    sums = detections.groupBy("grp", "model").agg(
        F.count(F.lit(1)).alias("tiles"), F.avg("n").alias("mean"), F.sum("n").alias("total"))
    sums = sums.join(exact_percentiles(detections, ["grp", "model"], "n", {"median": 0.5}), ["grp", "model"])
    wide = sums.groupBy("grp").pivot("model", list(models)).agg(
        F.first("tiles").alias("tiles"), F.first("mean").alias("mean"), F.first("median").alias("median"),
        F.first("total").alias("total"))
    first = models[0]
    return wide.withColumns({
        f"ratio_{m}": F.col(f"{m}_mean") / (F.col(f"{first}_mean") + F.lit(1e-8)) for m in models[1:]})


def ring_dab_by_tissue(cells: DataFrame) -> DataFrame:
    """Ring DAB on negative and positive tiles. `cells`: `positive, membrane_ring_dab`."""
    m = F.col("membrane_ring_dab")
    sums = cells.groupBy("positive").agg(
        F.count(m).alias("n_cells"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"))
    sums = sums.join(exact_percentiles(cells, ["positive"], m, {"median": 0.5}), "positive", "left")
    # Two rows, one per flag value: the ratio reads the other flag's mean from a window over them.
    both = Window.partitionBy(F.lit(0))
    mean_of = lambda flag: F.max(F.when(F.col("positive") == flag, F.col("mean"))).over(both)
    return sums.withColumn("neg_pos_ratio", F.try_divide(mean_of(False), mean_of(True)))


def label_presence_audit(detections: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles with and without reference labels against tiles with detections. Both sides: keys and `n`."""
    ref = reference.select(*keys, F.col("n").alias("_ref"))
    t = detections.join(ref, list(keys), "left").withColumns({
        "_ref": F.coalesce(F.col("_ref"), F.lit(0)), "n": F.coalesce(F.col("n"), F.lit(0))})
    return t.groupBy("grp").agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("_ref") == 0).alias("without_labels"),
        F.count_if((F.col("_ref") == 0) & (F.col("n") > 0)).alias("detections_without_labels"),
        F.count_if((F.col("_ref") > 0) & (F.col("n") == 0)).alias("labels_without_detections"))


def cluster_membership_rate(tiles: DataFrame) -> DataFrame:
    """Share of tiles and of cells in the epithelial cluster. `tiles`: `grp, epithelial, n_cells`."""
    inside = F.col("epithelial").cast("int")
    return tiles.groupBy("grp").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("n_cells").alias("cells"),
        F.avg(inside).alias("tile_rate"),
        G.share(F.sum(F.col("n_cells") * inside), F.sum("n_cells")).alias("cell_rate"))


def paired_agreement(pairs: DataFrame, keys: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Agreement of two scores: means, differences, order counts, Pearson r, the two coefficients.

    Fewer than five pairs give nulls. `icc_ref` is the reference coefficient built on between-rater
    and difference sums; it is not the textbook ICC(3,1). Everything comes from one pass of sums.
    """
    m, e = F.col(a).cast("double"), F.col(b).cast("double")
    d = m - e
    n = F.count(F.lit(1))
    sums = pairs.filter(m.isNotNull() & e.isNotNull()).groupBy(*keys).agg(
        n.alias("n_pairs"), F.avg(m).alias("a_mean"), F.stddev_pop(m).alias("a_std"), F.avg(e).alias("b_mean"),
        F.stddev_pop(e).alias("b_std"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("std_diff"),
        F.count_if(d > 0).alias("a_higher"), F.count_if(d < 0).alias("b_higher"), F.count_if(d == 0).alias("equal"),
        correlation(m, e).alias("pearson_r"), F.sum(d * d).alias("_sq"))
    grand = (F.col("a_mean") + F.col("b_mean")) / 2
    between = F.col("n_pairs") * ((F.col("a_mean") - grand) ** 2 + (F.col("b_mean") - grand) ** 2)
    error = F.try_divide(F.col("_sq") / 2, F.col("n_pairs") - 1)
    t = F.try_divide(F.col("mean_diff"), F.col("std_diff") / F.sqrt("n_pairs"))
    enough = F.col("n_pairs") >= 5
    out = sums.withColumns({
        "icc_ref": F.when(enough & (between + error > 0), (between - error) / (between + error)),
        "paired_t": F.when(enough & (F.col("std_diff") > 0), t),
        "pearson_r": F.when(enough & (F.col("a_std") > 0) & (F.col("b_std") > 0), F.col("pearson_r")),
    })
    return out.drop("_sq")


def t_test_p(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided p of Student's t, by Simpson's rule on the angle form of its integral.

    With t = sqrt(df)*tan(a) the density is cos(a)^(df-1), so the tail share is a ratio of two
    integrals over bounded ranges and no gamma function is needed.
    """
    def integral(upper: Column) -> Column:
        h = upper / steps
        at = F.sequence(F.lit(0), F.lit(steps))
        weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        terms = F.transform(at, lambda i: weight(i) * F.pow(F.cos(h * i), df - 1))
        return F.aggregate(terms, F.lit(0.0), lambda acc, e: acc + e) * h / 3

    inside = integral(F.atan(F.abs(t) / F.sqrt(df))) / integral(F.lit(float(3.141592653589793 / 2)))
    return F.greatest(F.lit(0.0), F.lit(1.0) - inside)


def reproducibility_cv(repeats: DataFrame, metrics: Sequence[str], limit: float = 15.0) -> DataFrame:
    """Coefficient of variation over repeats per tile, summarised per metric."""
    long = repeats.unpivot(["tile", "rep"], list(metrics), "metric", "v")
    spread = F.coalesce(F.stddev_samp("v"), F.lit(0.0))
    per_tile = long.groupBy("metric", "tile").agg(
        F.when(F.avg("v") > 0, spread / F.avg("v") * 100).otherwise(F.lit(0.0)).alias("cv"))
    sums = per_tile.groupBy("metric").agg(
        F.count(F.lit(1)).alias("tiles"), F.avg("cv").alias("mean_cv"), F.max("cv").alias("max_cv"),
        (F.lit(100.0) * F.avg((F.col("cv") < limit).cast("int"))).alias("pass_rate_pct"))
    sums = sums.join(exact_percentiles(per_tile, ["metric"], "cv", {"median_cv": 0.5}), "metric")
    return sums.withColumn("passes", F.col("mean_cv") < limit)


def strata_by_percentile(
    tiles: DataFrame, value: str, cuts: Mapping[str, float], names: Sequence[str], out: str = "stratum"
) -> DataFrame:
    """Names the stratum of each tile: below the first percentile, below the second, ..., the rest."""
    q = exact_percentiles(tiles, [], value, {f"_{k}": p for k, p in cuts.items()})
    # One row of cut-points whatever the table holds.
    joined = tiles.withColumn("_one", F.lit(0)).join(F.broadcast(q.withColumn("_one", F.lit(0))), "_one")
    chain = None
    for cut, name in zip(cuts, names):
        test = F.col(value) < F.col(f"_{cut}")
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return joined.withColumn(out, chain.otherwise(names[-1])).drop("_one", *[f"_{k}" for k in cuts])


def strata_report(cells: DataFrame) -> DataFrame:
    """Per stratum: tiles, cells, membrane and cytoplasm means, gap, completeness, scores.

    `cells`: `stratum, tile_key, membrane, cytoplasm, completeness`.
    """
    g = G.grade_dab("membrane")
    return cells.groupBy("stratum").agg(
        F.count_distinct("tile_key").alias("tiles"), F.count(F.lit(1)).alias("cells"),
        F.avg("membrane").alias("membrane_mean"), F.avg("cytoplasm").alias("cytoplasm_mean"),
        (F.avg("membrane") - F.avg("cytoplasm")).alias("gap"), F.avg("completeness").alias("completeness"),
        G.h_score(g).alias("h_score"), G.pct_at_least(g).alias("pct_positive"))


def membrane_gap(cells: DataFrame) -> DataFrame:
    """Membrane minus cytoplasm mean per method. `cells`: `method, membrane, cytoplasm`."""
    gap = F.avg("membrane") - F.avg("cytoplasm")
    return cells.groupBy("method").agg(
        F.count("membrane").alias("n_cells"), F.avg("membrane").alias("membrane_mean"),
        F.avg("cytoplasm").alias("cytoplasm_mean"), gap.alias("gap"),
        F.when(gap > 0, "PASS").otherwise("FAIL").alias("status"))


def bias_corrected_gap(cells: DataFrame, positive: str = "strong", negative: str = "neg") -> DataFrame:
    def gap(name: str) -> Column:
        here = F.col("stratum") == name
        return F.avg(F.when(here, F.col("membrane"))) - F.avg(F.when(here, F.col("cytoplasm")))

    return cells.agg(gap(positive).alias("positive_gap"), gap(negative).alias("negative_gap"),
                     (gap(positive) - gap(negative)).alias("bias_corrected_gap"))


def skip_rate(tiles: DataFrame) -> DataFrame:
    """Share of tiles by the way they were processed. `tiles`: `method`."""
    counts = tiles.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    # One row per method name.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total)


def drift_check(
    tile_stats: DataFrame, metrics: Sequence[str], min_slide: int = 5, min_before: int = 10, width: float = 2.0
) -> DataFrame:
    """Slides whose mean is more than `width` deviations from the tiles of all earlier slides.

    Tiles are summed per slide first; the running sums then go over slides, in slide order.
    """
    sums = []
    for m in metrics:
        sums += [F.sum(m).cast("double").alias(f"{m}_s"), F.sum(F.col(m) * F.col(m)).cast("double").alias(f"{m}_q")]
    slides = tile_stats.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), *sums)
    totals = {"r_n": F.col("n")}
    for m in metrics:
        totals |= {f"r_{m}_s": F.col(f"{m}_s"), f"r_{m}_q": F.col(f"{m}_q")}
    run = running_totals(slides, [F.col("slide_id")], totals)
    before = F.col("r_n") - F.col("n")
    parts = []
    for m in metrics:
        mean = F.try_divide(F.col(f"r_{m}_s") - F.col(f"{m}_s"), before)
        var = F.greatest(F.lit(0.0), F.try_divide(F.col(f"r_{m}_q") - F.col(f"{m}_q"), before) - mean * mean)
        slide_mean = F.col(f"{m}_s") / F.col("n")
        drift = ((F.col("n") >= min_slide) & (before >= min_before) & (F.sqrt(var) > 1e-9)
                 & (F.abs(slide_mean - mean) > width * F.sqrt(var)))
        parts.append(F.struct(F.lit(m).alias("metric"), slide_mean.alias("slide_mean"), mean.alias("earlier_mean"),
                              F.sqrt(var).alias("earlier_sd"), F.coalesce(drift, F.lit(False)).alias("drift")))
    return run.select("slide_id", F.explode(F.array(*parts)).alias("p")).select("slide_id", "p.*")
