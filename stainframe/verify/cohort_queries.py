"""Cohort, pipeline and agreement queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stainframe.constants import FLIPS
from stainframe.functions import grading as G
from stainframe.operators import cohorts as C
from stainframe.operators import scoring as S
from stainframe.verify.registry import query, rounded
from stainframe.verify.scoring_queries import H, P2, SLIDE_SUMMARY

BASE = """
base AS (SELECT slide_name, total_cells, pct_positive, h_score, mean_dab_od, negative, weak_1plus, moderate_2plus, strong_3plus,
  100 * CAST(moderate_2plus + strong_3plus AS DOUBLE) / total_cells AS pct_2plus,
  100 * CAST(moderate_2plus + strong_3plus AS DOUBLE) / total_cells >= 75 AS eligible
  FROM baseline WHERE region = 'Patient_Tissue')"""
COMPARE = f"""{SLIDE_SUMMARY}, {BASE},
cmp AS (
  SELECT coalesce(s.slide_id, b.slide_name) AS slide_id, b.slide_name IS NOT NULL AS in_baseline, s.slide_id IS NOT NULL AS in_cohort,
    b.total_cells AS bl_total_cells, round(b.pct_positive, 6) AS bl_pct_positive, round(b.pct_2plus, 6) AS bl_pct_2plus,
    round(b.h_score, 6) AS bl_h_score, round(b.mean_dab_od, 6) AS bl_mean_dab, b.negative AS bl_negative,
    b.weak_1plus AS bl_weak_1plus, b.moderate_2plus AS bl_moderate_2plus, b.strong_3plus AS bl_strong_3plus, b.eligible AS bl_eligible,
    s.total_cells AS co_total_cells, s.pct_2plus AS co_pct_2plus, s.h_score AS co_h_score, s.mean_membrane_dab AS co_mean_membrane_dab,
    s.mean_raw_dab AS co_mean_raw_dab, s.mean_completeness AS co_mean_completeness, s.mean_thickness_um AS co_mean_thickness_um,
    s.negative AS co_negative, s.weak_1plus AS co_weak_1plus, s.moderate_2plus AS co_moderate_2plus, s.strong_3plus AS co_strong_3plus,
    s.eligible AS co_eligible, s.has_membrane AS co_has_membrane, s.n_measured AS co_n_measured, s.pct_measured AS co_pct_measured,
    s.total_cells - b.total_cells AS delta_total_cells, round(s.pct_2plus - b.pct_2plus, 6) AS delta_pct_2plus,
    round(s.h_score - b.h_score, 6) AS delta_h_score,
    CASE WHEN b.slide_name IS NULL OR s.slide_id IS NULL THEN 'MISSING_DATA' WHEN b.eligible AND NOT s.eligible THEN 'LOST'
      WHEN NOT b.eligible AND s.eligible THEN 'GAINED' WHEN b.eligible THEN 'BOTH_ELIGIBLE' ELSE 'BOTH_NOT_ELIGIBLE' END AS eligibility_flip
  FROM summary s FULL JOIN base b ON s.slide_id IS NOT DISTINCT FROM b.slide_name)"""


def comparison(t):
    return C.compare_cohorts(C.baseline_summary(t.baseline), S.slide_summary(t.cells))


def _loose(df):
    """Deltas are differences of rounded figures in the SQL, so they are kept to 4 digits on both sides."""
    return rounded(df).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("delta_pct_2plus", "delta_h_score")})


@query("compare_cohorts", f"WITH {COMPARE} SELECT * REPLACE (round(delta_pct_2plus + 1e-9, 4) AS delta_pct_2plus, "
       "round(delta_h_score + 1e-9, 4) AS delta_h_score) FROM cmp")
def _(t):
    return _loose(comparison(t))


@query("eligibility_flips", f"WITH {COMPARE} SELECT slide_id, eligibility_flip FROM cmp WHERE eligibility_flip IN ('GAINED', 'LOST')")
def _(t):
    return C.eligibility_flips(comparison(t)).select("slide_id", "eligibility_flip")


@query("flip_distribution", f"""WITH {COMPARE}, f(eligibility_flip) AS (VALUES {', '.join(f"('{f}')" for f in FLIPS)})
SELECT eligibility_flip, count(slide_id) AS n_slides FROM f LEFT JOIN cmp USING (eligibility_flip) GROUP BY eligibility_flip""")
def _(t):
    return C.flip_distribution(comparison(t))


@query("cohort_summary", f"""WITH {COMPARE}, m AS (SELECT * FROM cmp WHERE in_baseline AND in_cohort)
SELECT count(*) FILTER (WHERE in_baseline) AS bl_slides, count(*) FILTER (WHERE bl_eligible) AS bl_eligible,
  round(100.0 * count(*) FILTER (WHERE bl_eligible) / greatest(count(*) FILTER (WHERE in_baseline), 1), 6) AS bl_eligible_pct,
  count(*) FILTER (WHERE in_cohort) AS co_slides, count(*) FILTER (WHERE co_eligible) AS co_eligible,
  round(100.0 * count(*) FILTER (WHERE co_eligible) / greatest(count(*) FILTER (WHERE in_cohort), 1), 6) AS co_eligible_pct,
  count(*) FILTER (WHERE co_has_membrane) AS co_with_membrane, CAST(coalesce(sum(co_total_cells), 0) AS BIGINT) AS co_cells,
  CAST(coalesce(sum(co_n_measured), 0) AS BIGINT) AS co_measured, any_value(n) AS n_matched,
  count(*) FILTER (WHERE eligibility_flip LIKE 'BOTH%') AS n_concordant,
  count(*) FILTER (WHERE eligibility_flip IN ('GAINED', 'LOST')) AS n_discordant,
  round(100.0 * count(*) FILTER (WHERE eligibility_flip LIKE 'BOTH%') / greatest(any_value(n), 1), 6) AS concordance_pct,
  count(*) FILTER (WHERE eligibility_flip = 'GAINED') AS n_gained, count(*) FILTER (WHERE eligibility_flip = 'LOST') AS n_lost,
  round(any_value(a1), 6) AS bl_mean_cells, round(any_value(a2), 6) AS co_mean_cells,
  round(any_value(c1), 6) AS pct_2plus_correlation, round(any_value(m1), 6) AS pct_2plus_mae,
  round(any_value(c2), 6) AS h_score_correlation, round(any_value(m2), 6) AS h_score_mae,
  round(any_value(d1), 6) AS bl_median_cells, round(any_value(d2), 6) AS co_median_cells
FROM cmp, (SELECT count(*) AS n, avg(bl_total_cells) AS a1, avg(co_total_cells) AS a2, corr(bl_pct_2plus, co_pct_2plus) AS c1,
  avg(abs(bl_pct_2plus - co_pct_2plus)) AS m1, corr(bl_h_score, co_h_score) AS c2, avg(abs(bl_h_score - co_h_score)) AS m2,
  quantile_cont(CAST(bl_total_cells AS DOUBLE), 0.5) AS d1, quantile_cont(CAST(co_total_cells AS DOUBLE), 0.5) AS d2 FROM m) s""")
def _(t):
    return rounded(C.cohort_summary(rounded(comparison(t))))


REGION = f"""rs AS (SELECT slide_id, region, count(*) AS n_cells, coalesce(100 * avg(CAST(grade AS DOUBLE)), 0) AS h,
  100 * avg(CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END) AS p FROM graded GROUP BY slide_id, region)"""


@query("region_concordance", f"""WITH {REGION}
SELECT a.slide_id, round(a.h - b.h, 6) AS h_score_diff, round(a.p - b.p, 6) AS pct_pos_diff,
  CASE WHEN b.h > 0 THEN round(a.h / b.h, 6) ELSE CAST('inf' AS DOUBLE) END AS h_score_ratio
FROM rs a JOIN rs b USING (slide_id) WHERE a.region = 'Patient_Tissue' AND b.region = 'iCAP_Control'""")
def _(t):
    return rounded(C.region_concordance(S.region_stats(t.cells)))


@query("baseline_by_region", f"""WITH {REGION}
SELECT slide_id, rs.region, n_cells, round(h, 6) AS h_score, total_cells AS bl_n_cells, round(h_score, 6) AS bl_h_score,
  round(pct_positive, 6) AS bl_pct_positive
FROM rs LEFT JOIN baseline b ON rs.slide_id = b.slide_name AND rs.region = b.region""")
def _(t):
    return rounded(C.baseline_by_region(
        S.region_stats(t.cells).select("slide_id", "region", "n_cells", "h_score"), t.baseline))


@query("compare_pipelines", """
WITH v1 AS (SELECT slide_id, region, count(*) AS n FROM cells WHERE is_center GROUP BY ALL),
v2 AS (SELECT slide_id, region, count(*) AS n, count(membrane_ring_dab) AS n_measured, avg(membrane_ring_dab) AS mu,
  stddev_pop(membrane_ring_dab) AS sd, avg(raw_membrane_dab) AS w,
  100 * avg(CAST(grade AS DOUBLE)) FILTER (WHERE membrane_ring_dab IS NOT NULL) AS h,
  100 * avg(CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE membrane_ring_dab IS NOT NULL) AS p,
  100 * avg(CASE WHEN grade = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE membrane_ring_dab IS NOT NULL) AS p0,
  100 * avg(CASE WHEN grade = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE membrane_ring_dab IS NOT NULL) AS p1,
  100 * avg(CASE WHEN grade = 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE membrane_ring_dab IS NOT NULL) AS p2,
  100 * avg(CASE WHEN grade = 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE membrane_ring_dab IS NOT NULL) AS p3
  FROM graded GROUP BY ALL)
SELECT coalesce(v1.slide_id, v2.slide_id) AS slide_id, coalesce(v1.region, v2.region) AS region,
  coalesce(v1.n, 0) AS v1_cells, coalesce(v2.n, 0) AS v2_cells, coalesce(n_measured, 0) AS n_measured,
  round(mu, 6) AS ring_mean, round(sd, 6) AS ring_std, round(h, 6) AS h_score, round(p, 6) AS pct_positive,
  round(p0, 6) AS pct_negative, round(p1, 6) AS pct_1plus, round(p2, 6) AS pct_2plus, round(p3, 6) AS pct_3plus,
  round(w, 6) AS whole_cell_dab, round(CAST(v2.n AS DOUBLE) / nullif(v1.n, 0), 6) AS cell_ratio
FROM v1 FULL JOIN v2 ON v1.slide_id IS NOT DISTINCT FROM v2.slide_id AND v1.region IS NOT DISTINCT FROM v2.region""")
def _(t):
    return rounded(C.compare_pipelines(
        t.cells.filter("is_center"), t.cells.withColumn("dab_mean", F.col("raw_membrane_dab"))))


# Tile-level figures of two models: all cells, and centre cells only.
TWO = """two AS (SELECT slide_id, tile_x, tile_y, n_cells AS ours, n2 + n3 AS base, CAST(n3 AS DOUBLE) / n_cells AS f,
  CASE WHEN CAST(n3 AS DOUBLE) / n_cells < 0.05 THEN 'Negative' WHEN CAST(n3 AS DOUBLE) / n_cells < 0.15 THEN 'Low'
       WHEN CAST(n3 AS DOUBLE) / n_cells < 0.30 THEN 'Moderate' ELSE 'High' END AS dab_level FROM tile_grades)"""


def two_models(t):
    share = F.col("n3") / F.col("n_cells")
    level = F.when(share < 0.05, "Negative").when(share < 0.15, "Low").when(share < 0.30, "Moderate").otherwise("High")
    return t.tile_grades.select("slide_id", "tile_x", "tile_y", F.col("n_cells").alias("ours"),
                                (F.col("n2") + F.col("n3")).alias("base"), share.alias("dab_positive_fraction"),
                                level.alias("dab_level"))


@query("detections_by_level", f"""WITH {TWO}, l(dab_level) AS (VALUES ('Negative'), ('Low'), ('Moderate'), ('High'))
SELECT dab_level, count(ours) AS tiles, round(coalesce(avg(ours), 0), 6) AS ours_mean, round(coalesce(avg(base), 0), 6) AS base_mean,
  CAST(coalesce(sum(ours), 0) AS BIGINT) AS ours_total, CAST(coalesce(sum(base), 0) AS BIGINT) AS base_total,
  round(coalesce(100 * avg(f), 0), 6) AS mean_dab_positive_pct,
  round(coalesce(quantile_cont(CAST(ours AS DOUBLE), 0.5), 0), 6) AS ours_median,
  round(coalesce(quantile_cont(CAST(base AS DOUBLE), 0.5), 0), 6) AS base_median,
  round(coalesce(quantile_cont(CASE WHEN ours IS NULL THEN NULL WHEN base > 0 THEN CAST(ours AS DOUBLE) / base ELSE 0.0 END, 0.5), 0), 6) AS ratio_median,
  round(CASE WHEN count(ours) = 0 THEN 0 WHEN avg(base) > 0 THEN avg(ours) / avg(base) ELSE CAST('inf' AS DOUBLE) END, 6) AS ratio_mean
FROM l LEFT JOIN two USING (dab_level) GROUP BY dab_level""")
def _(t):
    return rounded(C.detections_by_level(two_models(t)))


@query("selectivity_verdict", f"""WITH {TWO}, r AS (SELECT slide_id, sum(base) / CAST(sum(ours) AS DOUBLE) AS o,
  coalesce(sum(base) FILTER (WHERE f < 0.5) / CAST(sum(ours) FILTER (WHERE f < 0.5) AS DOUBLE), 0) AS n FROM two GROUP BY slide_id)
SELECT slide_id, CASE WHEN n < 0.10 THEN 'STRONGLY CONFIRMED' WHEN n < 0.30 THEN 'PARTIALLY CONFIRMED' ELSE 'REJECTED' END AS negative_verdict,
  CASE WHEN o < 0.05 THEN 'STRONGLY DAB-SELECTIVE (near-zero H&E detections)' WHEN o < 0.20 THEN 'MOSTLY DAB-SELECTIVE (few H&E detections)'
   WHEN o < 0.50 THEN 'PARTIALLY DAB-SELECTIVE (moderate H&E detections)' ELSE 'NOT DAB-SELECTIVE (detects H&E cells freely)' END AS overall_verdict
FROM r""")
def _(t):
    two = two_models(t)
    low = F.col("dab_positive_fraction") < 0.5
    r = two.groupBy("slide_id").agg(
        G.share(F.sum("base"), F.sum("ours")).alias("o"),
        G.share(F.sum(F.when(low, F.col("base"))), F.sum(F.when(low, F.col("ours")))).alias("n"))
    return r.select("slide_id", *C.selectivity_verdict("n", "o"))


@query("detections_by_group", f"""WITH {TWO}, g AS (SELECT dab_level AS grp, count(*) AS tiles,
  avg(ours) AS a, quantile_cont(CAST(ours AS DOUBLE), 0.5) AS ma, CAST(sum(ours) AS BIGINT) AS ta,
  avg(base) AS b, quantile_cont(CAST(base AS DOUBLE), 0.5) AS mb, CAST(sum(base) AS BIGINT) AS tb FROM two GROUP BY dab_level)
SELECT grp, tiles AS ours_tiles, round(a, 6) AS ours_mean, round(ma, 6) AS ours_median, ta AS ours_total,
  tiles AS base_tiles, round(b, 6) AS base_mean, round(mb, 6) AS base_median, tb AS base_total, round(b / (a + 1e-8), 6) AS ratio_base FROM g""")
def _(t):
    long = two_models(t).unpivot(["dab_level", "slide_id", "tile_x", "tile_y"], ["ours", "base"], "model", "n")
    return rounded(C.detections_by_group(long.withColumnRenamed("dab_level", "grp"), ["ours", "base"]))


@query("ring_dab_by_tissue", """
WITH f AS (SELECT g.membrane_ring_dab AS m, t.mean_grade >= 2 AS positive FROM graded g JOIN tile_grades t ON g.slide_id = t.slide_id
  AND floor(g.centroid_x / 704) = t.tile_x AND floor(g.centroid_y / 704) = t.tile_y),
s AS (SELECT positive, count(m) AS n_cells, avg(m) AS mean, stddev_pop(m) AS std, quantile_cont(m, 0.5) AS median FROM f GROUP BY positive)
SELECT positive, n_cells, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median,
  round((SELECT mean FROM s WHERE NOT positive) / (SELECT mean FROM s WHERE positive), 6) AS neg_pos_ratio FROM s""")
def _(t):
    cells = t.cells.withColumns({"tile_x": F.floor(F.col("centroid_x") / 704), "tile_y": F.floor(F.col("centroid_y") / 704)})
    flags = t.tile_grades.select("slide_id", "tile_x", "tile_y", (F.col("mean_grade") >= 2).alias("positive"))
    return rounded(C.ring_dab_by_tissue(cells.join(flags, ["slide_id", "tile_x", "tile_y"]).select(
        "positive", "membrane_ring_dab")))


@query("label_presence_audit", """
WITH d AS (SELECT slide_id AS grp, tile_x, tile_y, CASE WHEN n3 > 1 THEN n3 ELSE 0 END AS n FROM tile_grades),
r AS (SELECT slide_id AS grp, tile_x, tile_y, n0 AS n FROM tile_grades WHERE n0 > 0)
SELECT grp, count(*) AS tiles, count(*) FILTER (WHERE r.n IS NULL) AS without_labels,
  count(*) FILTER (WHERE r.n IS NULL AND d.n > 0) AS detections_without_labels,
  count(*) FILTER (WHERE r.n > 0 AND d.n = 0) AS labels_without_detections
FROM d LEFT JOIN r USING (grp, tile_x, tile_y) GROUP BY grp""")
def _(t):
    g = t.tile_grades.withColumnRenamed("slide_id", "grp")
    d = g.select("grp", "tile_x", "tile_y", F.when(F.col("n3") > 1, F.col("n3")).otherwise(F.lit(0)).alias("n"))
    r = g.filter("n0 > 0").select("grp", "tile_x", "tile_y", F.col("n0").alias("n"))
    return C.label_presence_audit(d, r, ["grp", "tile_x", "tile_y"])


@query("cluster_membership_rate", """
SELECT slide_id AS grp, count(*) AS tiles, CAST(sum(n_cells) AS BIGINT) AS cells,
  round(avg(CASE WHEN mean_grade >= 2 THEN 1.0 ELSE 0.0 END), 6) AS tile_rate,
  round(sum(CASE WHEN mean_grade >= 2 THEN n_cells ELSE 0 END) / CAST(sum(n_cells) AS DOUBLE), 6) AS cell_rate
FROM tile_grades GROUP BY slide_id""")
def _(t):
    return rounded(C.cluster_membership_rate(t.tile_grades.select(
        F.col("slide_id").alias("grp"), (F.col("mean_grade") >= 2).alias("epithelial"), "n_cells")))


PAIRS = """pairs AS (SELECT slide_id, 100 * mean_grade AS a, 100 * CAST(n2 + n3 AS DOUBLE) / n_cells AS b FROM tile_grades)"""


def pairs(t):
    return t.tile_grades.select("slide_id", (100 * F.col("mean_grade")).alias("a"),
                                (F.lit(100.0) * (F.col("n2") + F.col("n3")) / F.col("n_cells")).alias("b"))


@query("paired_agreement", f"""WITH {PAIRS}
SELECT slide_id, count(*) AS n_pairs, round(avg(a), 6) AS a_mean, round(stddev_pop(a), 6) AS a_std, round(avg(b), 6) AS b_mean,
  round(stddev_pop(b), 6) AS b_std, round(avg(a - b), 6) AS mean_diff, round(stddev_pop(a - b), 6) AS std_diff,
  count(*) FILTER (WHERE a > b) AS a_higher, count(*) FILTER (WHERE a < b) AS b_higher, count(*) FILTER (WHERE a = b) AS equal,
  CASE WHEN count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS pearson_r
FROM pairs GROUP BY slide_id""")
def _(t):
    return rounded(C.paired_agreement(pairs(t), ["slide_id"]).drop("icc_ref", "paired_t"))


@query("icc_ref", f"""WITH {PAIRS}, s AS (SELECT slide_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, sum((a - b) * (a - b)) AS q FROM pairs GROUP BY slide_id),
v AS (SELECT slide_id, n, n * (pow(ma - (ma + mb) / 2, 2) + pow(mb - (ma + mb) / 2, 2)) AS msr, q / 2 / nullif(n - 1, 0) AS mse FROM s)
SELECT slide_id, n AS n_pairs, CASE WHEN n >= 5 AND msr + mse > 0 THEN round((msr - mse) / (msr + mse), 6) END AS icc_ref FROM v""")
def _(t):
    return rounded(C.paired_agreement(pairs(t), ["slide_id"]).select("slide_id", "n_pairs", "icc_ref"))


@query("paired_t", f"""WITH {PAIRS} SELECT slide_id, count(*) AS n_pairs,
  CASE WHEN count(*) >= 5 AND stddev_pop(a - b) > 0 THEN round(avg(a - b) / (stddev_pop(a - b) / sqrt(count(*))), 6) END AS paired_t
FROM pairs GROUP BY slide_id""")
def _(t):
    return rounded(C.paired_agreement(pairs(t), ["slide_id"]).select("slide_id", "n_pairs", "paired_t"))


@query("paired_t_p")
def _(t):
    out = C.paired_agreement(pairs(t), ["slide_id"]).select("slide_id", "n_pairs", "paired_t")
    return rounded(out.withColumn("p_value", C.t_test_p(F.col("paired_t"), (F.col("n_pairs") - 1).cast("double"))))


METRICS = ("n_cells", "h_score", "pct_positive", "pct_3plus")


@query("reproducibility_cv", """
WITH long AS (""" + " UNION ALL ".join(
    f"SELECT tile, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM repeats" for m in METRICS) + """),
c AS (SELECT metric, tile, CASE WHEN avg(v) > 0 THEN coalesce(stddev_samp(v), 0) / avg(v) * 100 ELSE 0 END AS cv FROM long GROUP BY ALL)
SELECT metric, count(*) AS tiles, round(avg(cv), 6) AS mean_cv, round(max(cv), 6) AS max_cv,
  round(100 * avg(CASE WHEN cv < 15 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate_pct, round(quantile_cont(cv, 0.5), 6) AS median_cv,
  avg(cv) < 15 AS passes FROM c GROUP BY metric""")
def _(t):
    r = t.repeats.withColumn("n_cells", F.col("n_cells").cast("double"))
    return rounded(C.reproducibility_cv(r, METRICS))


STRATA = """q AS (SELECT quantile_cont(mean_grade, 0.1) AS p10, quantile_cont(mean_grade, 0.5) AS p50, quantile_cont(mean_grade, 0.9) AS p90 FROM tile_grades),
strata AS (SELECT slide_id, tile_x, tile_y, CASE WHEN mean_grade < p10 THEN 'neg' WHEN mean_grade < p50 THEN 'low' WHEN mean_grade < p90 THEN 'high' ELSE 'strong' END AS stratum
  FROM tile_grades, q)"""


def strata(t):
    return C.strata_by_percentile(t.tile_grades, "mean_grade", {"p10": 0.1, "p50": 0.5, "p90": 0.9},
                                  ["neg", "low", "high", "strong"]).select("slide_id", "tile_x", "tile_y", "stratum")


@query("strata_by_percentile", f"WITH {STRATA} SELECT * FROM strata")
def _(t):
    return strata(t)


MEASURED = f"""{STRATA}, mc AS (SELECT stratum, concat(c.slide_id, '/', CAST(tile_x AS STRING), '_', CAST(tile_y AS STRING)) AS tile_key,
  membrane_ring_dab AS membrane, raw_membrane_dab * 0.8 AS cytoplasm, membrane_completeness AS completeness
  FROM cells c JOIN strata s ON c.slide_id = s.slide_id AND floor(c.centroid_x / 704) = tile_x AND floor(c.centroid_y / 704) = tile_y
  WHERE membrane_ring_dab IS NOT NULL)"""


def measured(t):
    cells = t.cells.filter("membrane_ring_dab IS NOT NULL").withColumns(
        {"tile_x": F.floor(F.col("centroid_x") / 704), "tile_y": F.floor(F.col("centroid_y") / 704)})
    return cells.join(strata(t), ["slide_id", "tile_x", "tile_y"]).select(
        "stratum", F.concat("slide_id", F.lit("/"), "tile_x", F.lit("_"), "tile_y").alias("tile_key"),
        F.col("membrane_ring_dab").alias("membrane"), (F.col("raw_membrane_dab") * 0.8).alias("cytoplasm"),
        F.col("membrane_completeness").alias("completeness"))


@query("strata_report", f"""WITH {MEASURED}, g AS (SELECT *, CASE WHEN membrane < 0.10 THEN 0 WHEN membrane < 0.20 THEN 1 WHEN membrane < 0.35 THEN 2 ELSE 3 END AS grade FROM mc)
SELECT stratum, count(DISTINCT tile_key) AS tiles, count(*) AS cells, round(avg(membrane), 6) AS membrane_mean, round(avg(cytoplasm), 6) AS cytoplasm_mean,
  round(avg(membrane) - avg(cytoplasm), 6) AS gap, round(avg(completeness), 6) AS completeness, {H}, {P2} AS pct_positive FROM g GROUP BY stratum""")
def _(t):
    return rounded(C.strata_report(measured(t)))


@query("membrane_gap", """
WITH m AS (SELECT 'ring' AS method, membrane_ring_dab AS membrane, raw_membrane_dab AS cytoplasm FROM cells
  UNION ALL SELECT 'reversed', raw_membrane_dab, membrane_ring_dab FROM cells)
SELECT method, count(membrane) AS n_cells, round(avg(membrane), 6) AS membrane_mean, round(avg(cytoplasm), 6) AS cytoplasm_mean,
  round(avg(membrane) - avg(cytoplasm), 6) AS gap, CASE WHEN avg(membrane) - avg(cytoplasm) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM m GROUP BY method""")
def _(t):
    both = F.explode(F.array(
        F.struct(F.lit("ring").alias("method"), F.col("membrane_ring_dab").alias("membrane"), F.col("raw_membrane_dab").alias("cytoplasm")),
        F.struct(F.lit("reversed").alias("method"), F.col("raw_membrane_dab").alias("membrane"), F.col("membrane_ring_dab").alias("cytoplasm"))))
    return rounded(C.membrane_gap(t.cells.select(both.alias("m")).select("m.*")))


@query("bias_corrected_gap", f"""WITH {MEASURED}, g AS (SELECT avg(membrane) FILTER (WHERE stratum = 'strong') - avg(cytoplasm) FILTER (WHERE stratum = 'strong') AS p,
  avg(membrane) FILTER (WHERE stratum = 'neg') - avg(cytoplasm) FILTER (WHERE stratum = 'neg') AS n FROM mc)
SELECT round(p, 6) AS positive_gap, round(n, 6) AS negative_gap, round(p - n, 6) AS bias_corrected_gap FROM g""")
def _(t):
    return rounded(C.bias_corrected_gap(measured(t)))


WAY = "CASE WHEN mean_grade >= 2 THEN 'default' WHEN mean_grade >= 1 THEN 'fallback' ELSE 'failed' END"


@query("skip_rate", f"SELECT {WAY} AS method, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share "
       f"FROM tile_grades GROUP BY {WAY}")
def _(t):
    way = F.when(F.col("mean_grade") >= 2, "default").when(F.col("mean_grade") >= 1, "fallback").otherwise("failed")
    return rounded(C.skip_rate(t.tile_grades.select(way.alias("method"))))


DRIFT = ("n_cells", "mean_grade")


@query("drift_check", """
WITH s AS (SELECT slide_id, count(*) AS n, """ + ", ".join(
    f"sum(CAST({m} AS DOUBLE)) AS {m}_s, sum(CAST({m} AS DOUBLE) * {m}) AS {m}_q" for m in DRIFT) + """ FROM tile_grades GROUP BY slide_id),
r AS (SELECT *, sum(n) OVER w AS bn, """ + ", ".join(
    f"sum({m}_s) OVER w AS b_{m}_s, sum({m}_q) OVER w AS b_{m}_q" for m in DRIFT) + """ FROM s
  WINDOW w AS (ORDER BY slide_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (""" + " UNION ALL ".join(
    f"SELECT slide_id, '{m}' AS metric, n, bn, {m}_s / n AS slide_mean, b_{m}_s / bn AS earlier_mean, "
    f"sqrt(greatest(0, b_{m}_q / bn - pow(b_{m}_s / bn, 2))) AS earlier_sd FROM r" for m in DRIFT) + """)
SELECT slide_id, metric, round(slide_mean, 6) AS slide_mean, round(earlier_mean, 6) AS earlier_mean, 
  CASE WHEN bn IS NOT NULL THEN round(earlier_sd, 6) END AS earlier_sd,
  coalesce(n >= 5 AND bn >= 10 AND earlier_sd > 1e-9 AND abs(slide_mean - earlier_mean) > 2 * earlier_sd, FALSE) AS drift FROM l""")
def _(t):
    out = rounded(C.drift_check(t.tile_grades, DRIFT))
    return out.withColumn("earlier_sd", F.when(F.col("earlier_mean").isNotNull(), F.col("earlier_sd")))
