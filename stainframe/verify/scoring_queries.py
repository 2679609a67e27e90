"""Queries over graded cells and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stainframe.constants import MORPHOMETRIC_FILTERS
from stainframe.functions import grading as G
from stainframe.operators import scoring as S
from stainframe.verify.registry import query, rounded

GRADE = """CASE WHEN membrane_ring_dab IS NULL OR membrane_ring_dab < 0.10 THEN 0 WHEN membrane_ring_dab < 0.20 THEN 1
 WHEN membrane_ring_dab < 0.35 THEN 2 ELSE 3 END"""
COUNTS = ("count(*) FILTER (WHERE grade = 0) AS negative, count(*) FILTER (WHERE grade = 1) AS weak_1plus, "
          "count(*) FILTER (WHERE grade = 2) AS moderate_2plus, count(*) FILTER (WHERE grade = 3) AS strong_3plus")
H = "round(coalesce(100 * avg(CAST(grade AS DOUBLE)), 0), 6) AS h_score"
P2 = "round(coalesce(100 * avg(CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END), 0), 6)"
P3 = "round(coalesce(100 * avg(CASE WHEN grade >= 3 THEN 1.0 ELSE 0.0 END), 0), 6)"


@query("grade_dab", f"SELECT slide_id, cell_id, {GRADE} AS grade FROM cells")
def _(t):
    return t.cells.select("slide_id", "cell_id", G.grade_dab("membrane_ring_dab").alias("grade"))


@query("grade_label", "SELECT slide_id, cell_id, CASE grade WHEN 0 THEN 'Negative' WHEN 1 THEN '1+' WHEN 2 THEN '2+' "
       "ELSE '3+' END AS label FROM graded")
def _(t):
    return t.graded.select("slide_id", "cell_id", G.grade_label("grade").alias("label"))


@query("grade_composite", """
SELECT cell_id, CASE
  WHEN membrane_thickness_px IS NULL OR membrane_completeness IS NULL OR raw_membrane_dab IS NULL THEN 0
  WHEN raw_membrane_dab < 0.05 THEN 0
  WHEN raw_membrane_dab < 0.15 THEN 1
  WHEN membrane_thickness_px >= 8 THEN 3
  WHEN membrane_completeness >= 0.5 AND raw_membrane_dab >= 0.30 THEN 3
  WHEN membrane_completeness >= 0.5 THEN 2
  WHEN raw_membrane_dab >= 0.30 THEN 2 ELSE 1 END AS grade FROM cells""")
def _(t):
    return t.cells.select("cell_id", G.grade_composite(
        "membrane_thickness_px", "membrane_completeness", "raw_membrane_dab").alias("grade"))


@query("h_score", f"SELECT slide_id, count(*) AS n_cells, {H} FROM graded GROUP BY slide_id")
def _(t):
    return rounded(S.score_by(t.cells, ["slide_id"]).select("slide_id", "n_cells", "h_score"))


@query("h_score_measured", f"""SELECT slide_id, count(*) AS n_cells, {H} FROM graded
 WHERE membrane_ring_dab IS NOT NULL GROUP BY slide_id""")
def _(t):
    return rounded(S.score_by(t.cells, ["slide_id"], "measured").select("slide_id", "n_cells", "h_score"))


@query("pct_positive", f"SELECT slide_id, {P2} AS pct_positive FROM graded GROUP BY slide_id")
def _(t):
    return rounded(S.score_by(t.cells, ["slide_id"]).select("slide_id", "pct_positive"))


@query("pct_3plus", f"SELECT slide_id, {P3} AS pct_3plus FROM graded GROUP BY slide_id")
def _(t):
    return rounded(S.score_by(t.cells, ["slide_id"]).select("slide_id", "pct_3plus"))


@query("grade_distribution", f"SELECT slide_id, {COUNTS} FROM graded GROUP BY slide_id")
def _(t):
    return t.graded.groupBy("slide_id").agg(*G.grade_counts("grade"))


@query("eligibility", f"SELECT slide_id, region, {P2} AS pct_positive, {P2} >= 75 AS eligible FROM graded "
       "GROUP BY slide_id, region")
def _(t):
    return rounded(S.score_by(t.cells, ["slide_id", "region"]).select(
        "slide_id", "region", "pct_positive", "eligible"))


@query("calibrate_thresholds", """
SELECT region, count(membrane_ring_dab) AS n_values,
  round(CASE WHEN count(membrane_ring_dab) < 50 THEN 0.10 ELSE greatest(0.05, least(quantile_cont(membrane_ring_dab, 0.25), 0.15)) END, 6) AS t1,
  round(CASE WHEN count(membrane_ring_dab) < 50 THEN 0.20 ELSE greatest(0.10, least(quantile_cont(membrane_ring_dab, 0.5), 0.25)) END, 6) AS t2,
  round(CASE WHEN count(membrane_ring_dab) < 50 THEN 0.35 ELSE greatest(0.20, least(quantile_cont(membrane_ring_dab, 0.75), 0.40)) END, 6) AS t3
FROM cells GROUP BY region""")
def _(t):
    return rounded(S.calibrate_thresholds(t.cells, ["region"]))


@query("thickness_um", "SELECT cell_id, round(membrane_thickness_px * 0.5, 6) AS thickness_um FROM cells")
def _(t):
    return rounded(t.cells.select("cell_id", (F.col("membrane_thickness_px") * 0.5).alias("thickness_um")))


@query("region_stats", f"""
SELECT slide_id, region, count(*) AS n_cells, {H}, {P2} AS pct_positive, {P3} AS pct_3plus,
  round(avg(membrane_ring_dab), 6) AS mean_membrane_dab, round(avg(membrane_completeness), 6) AS mean_completeness,
  round(avg(membrane_thickness_px), 6) AS mean_thickness_px FROM graded GROUP BY slide_id, region""")
def _(t):
    return rounded(S.region_stats(t.cells))


SLIDE_SUMMARY = f"""
summary AS (
  SELECT slide_id, count(*) AS total_cells, {COUNTS}, {P2} AS pct_2plus, {H},
    round(coalesce(avg(membrane_ring_dab), 0), 6) AS mean_membrane_dab, count(membrane_ring_dab) AS n_measured,
    round(coalesce(avg(membrane_completeness), 0), 6) AS mean_completeness,
    round(coalesce(avg(membrane_thickness_px * 0.5), 0), 6) AS mean_thickness_um,
    round(coalesce(avg(raw_membrane_dab), 0), 6) AS mean_raw_dab,
    round(coalesce(quantile_cont(membrane_ring_dab, 0.5), 0), 6) AS median_membrane_dab,
    round(100 * count(membrane_ring_dab) / CAST(count(*) AS DOUBLE), 6) AS pct_measured,
    count(membrane_ring_dab) > 0 AS has_membrane, {P2} >= 75 AS eligible
  FROM (SELECT *, count(*) FILTER (WHERE region = 'Patient_Tissue') OVER (PARTITION BY slide_id) AS hits FROM graded) z
  WHERE region = 'Patient_Tissue' OR hits = 0 GROUP BY slide_id)"""


@query("slide_summary", f"WITH {SLIDE_SUMMARY} SELECT * FROM summary")
def _(t):
    return rounded(S.slide_summary(t.cells))


@query("thickness_summary", f"""
SELECT slide_id, region, CASE WHEN grouping(region) = 1 THEN 'slide' ELSE 'region' END AS level, count(*) AS n_cells, count(membrane_thickness_px) AS thickness_valid,
  round(avg(membrane_thickness_px), 6) AS mean_px, round(stddev_pop(membrane_thickness_px), 6) AS std_px,
  round(avg(membrane_thickness_px) * 0.5, 6) AS mean_um, {COUNTS}, {H}, {P2} AS pct_positive,
  round(quantile_cont(membrane_thickness_px, 0.05), 6) AS p5, round(quantile_cont(membrane_thickness_px, 0.25), 6) AS p25,
  round(quantile_cont(membrane_thickness_px, 0.5), 6) AS median_px, round(quantile_cont(membrane_thickness_px, 0.75), 6) AS p75,
  round(quantile_cont(membrane_thickness_px, 0.95), 6) AS p95,
  round(100 * count(membrane_thickness_px) / CAST(count(*) AS DOUBLE), 6) AS coverage_pct
FROM graded GROUP BY GROUPING SETS ((slide_id), (slide_id, region))""")
def _(t):
    return rounded(S.thickness_summary(t.cells))


PASS = ("area_um2 >= 25 AND least(solidity, 1.0) >= 0.9 AND max_diameter_um / greatest(min_diameter_um, 0.01) <= 2.5")


@query("morphometric_filter", f"SELECT slide_id, cell_id FROM cells WHERE {PASS}")
def _(t):
    return S.morphometric_filter(t.cells).select("slide_id", "cell_id")


def _filter_sql() -> str:
    parts = []
    for name, area, sol, aspect in MORPHOMETRIC_FILTERS:
        test = ["TRUE"]
        if area:
            test.append(f"area_um2 >= {area}")
        if sol:
            test.append(f"least(solidity, 1.0) >= {sol}")
        if aspect:
            test.append(f"max_diameter_um / greatest(min_diameter_um, 0.01) <= {aspect}")
        parts.append(f"SELECT slide_id, '{name}' AS filter, grade, {' AND '.join(test)} AS ok FROM graded")
    return " UNION ALL ".join(parts)


@query("morphometric_sensitivity", f"""
SELECT slide_id, filter, count(*) AS total_before, count(*) FILTER (WHERE ok) AS total_after,
  round(coalesce(100 * avg(CAST(grade AS DOUBLE)) FILTER (WHERE ok), 0), 6) AS h_score,
  round(coalesce(100 * avg(CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 0), 6) AS pct_positive,
  count(*) FILTER (WHERE ok AND grade = 0) AS negative, count(*) FILTER (WHERE ok AND grade = 1) AS weak_1plus,
  count(*) FILTER (WHERE ok AND grade = 2) AS moderate_2plus, count(*) FILTER (WHERE ok AND grade = 3) AS strong_3plus,
  round(100 * count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 6) AS pct_retained
FROM ({_filter_sql()}) f GROUP BY slide_id, filter""")
def _(t):
    return rounded(S.morphometric_sensitivity(t.cells))


@query("morphometric_summary", """
SELECT slide_id, count(*) AS n_cells, round(avg(area_um2), 6) AS area_mean, round(avg(sol), 6) AS solidity_mean,
  round(100 * avg(CASE WHEN sol < 0.9 THEN 1.0 ELSE 0.0 END), 6) AS solidity_below_09_pct,
  round(100 * avg(CASE WHEN solidity > 1.0 THEN 1.0 ELSE 0.0 END), 6) AS solidity_above_1_pct,
  round(avg(asp), 6) AS aspect_mean, round(100 * avg(CASE WHEN asp > 2.0 THEN 1.0 ELSE 0.0 END), 6) AS aspect_above_2_pct,
  round(100 * avg(CASE WHEN asp > 2.5 THEN 1.0 ELSE 0.0 END), 6) AS aspect_above_25_pct,
  round(quantile_cont(area_um2, 0.05), 6) AS area_p5, round(quantile_cont(area_um2, 0.25), 6) AS area_p25,
  round(quantile_cont(area_um2, 0.5), 6) AS area_median, round(quantile_cont(area_um2, 0.75), 6) AS area_p75,
  round(quantile_cont(area_um2, 0.95), 6) AS area_p95, round(quantile_cont(sol, 0.5), 6) AS solidity_median,
  round(quantile_cont(asp, 0.5), 6) AS aspect_median, round(quantile_cont(asp, 0.95), 6) AS aspect_p95
FROM (SELECT *, least(solidity, 1.0) AS sol, max_diameter_um / greatest(min_diameter_um, 0.01) AS asp FROM cells) c
GROUP BY slide_id""")
def _(t):
    return rounded(S.morphometric_summary(t.cells))


@query("feature_histogram", """
WITH long AS (
  SELECT slide_id, 'area_um2' AS feature, area_um2 AS v FROM cells
  UNION ALL SELECT slide_id, 'solidity', least(solidity, 1.0) FROM cells
  UNION ALL SELECT slide_id, 'aspect_ratio', least(max_diameter_um / greatest(min_diameter_um, 0.01), 6.0) FROM cells),
b AS (SELECT slide_id, feature, min(v) AS lo, max(v) AS hi, count(*) AS total FROM long GROUP BY ALL),
w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE CAST(1.0 AS DOUBLE) / 50 END AS width FROM b)
SELECT slide_id, feature, CAST(least(floor((v - lo) / width + 1e-9), 49) AS INT) AS bin, count(*) AS n,
  round(count(*) / CAST(any_value(total) AS DOUBLE) / any_value(width), 6) AS density
FROM long JOIN w USING (slide_id, feature) GROUP BY ALL""")
def _(t):
    return rounded(S.feature_histogram(t.cells))
