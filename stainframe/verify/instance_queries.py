"""Instance, matching, growth and tile-filter queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stainframe.constants import DAB_POSITIVE
from stainframe.functions import grading as G
from stainframe.operators import growth as W
from stainframe.operators import instances as I
from stainframe.operators import matching as M
from stainframe.operators import pixels as P
from stainframe.operators import profiles as R
from stainframe.operators import tile_filters as TF
from stainframe.operators.rasters import gaussian_smooth, gaussian_weights
from stainframe.verify.pixel_queries import COLS, EXTENT, GRAY8, SAT, TEXTURE, symmetric
from stainframe.verify.registry import query, rounded
from stainframe.verify.sqltext import KEY, box, ellipse, gather, near
from stainframe.verify.views import SPARK

AREAS = """areas AS (SELECT slide_id, tile_id, id, count(*) FILTER (WHERE k = 'n') AS nuc_area, count(*) FILTER (WHERE k = 'c') AS cell_area FROM
 (SELECT slide_id, tile_id, nuc_id AS id, 'n' AS k FROM pixels UNION ALL SELECT slide_id, tile_id, cell_id, 'c' FROM pixels) u WHERE id > 0 GROUP BY ALL)"""


@query("instance_areas", f"WITH {AREAS} SELECT * FROM areas")
def _(t):
    return I.instance_areas(t.pixels)


@query("instance_centroids", "SELECT slide_id, tile_id, nuc_id AS id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM pixels WHERE nuc_id > 0 GROUP BY ALL")
def _(t):
    return rounded(I.instance_centroids(t.pixels, "nuc_id"))


@query("relabel_contiguous", f"WITH {AREAS} SELECT slide_id, tile_id, id, row_number() OVER (PARTITION BY slide_id, tile_id ORDER BY id) AS new_id FROM areas WHERE cell_area > 400 OR id > 1")
def _(t):
    a = I.instance_areas(t.pixels).filter("cell_area > 400 OR id > 1")
    return I.relabel_contiguous(a).select("slide_id", "tile_id", "id", F.col("new_id").cast("bigint").alias("new_id"))


def eroded(label: str, half: int, name: str, table: str = "stained") -> str:
    """`table` with `name` = does the pixel survive erosion of its own label?"""
    lo = box(table, label, "min", half, f"lo_{name}")
    hi = box(f"({lo}) a_{name}", label, "max", half, f"hi_{name}")
    return f"SELECT *, {label} > 0 AND lo_{name} = {label} AND hi_{name} = {label} AS {name} FROM ({hi}) b_{name}"


EDGE = f"e3 AS ({eroded('cell_id', 1, 'in3')})"
COVER = f"{EDGE}, cover AS (SELECT slide_id, tile_id, cell_id AS id, avg(CASE WHEN dab > 0.05 THEN 1.0 ELSE 0.0 END) AS coverage FROM e3 WHERE cell_id > 0 AND NOT in3 GROUP BY ALL)"


@query("perimeter_coverage", f"WITH {COVER} SELECT slide_id, tile_id, id, round(coverage, 6) AS coverage FROM cover")
def _(t):
    return rounded(I.perimeter_coverage(t.stained))


FILTERED = f"""{AREAS}, {COVER}, filtered AS (SELECT a.slide_id, a.tile_id, id, nuc_area, cell_area, CASE WHEN nuc_area < 20 THEN 'small_nucleus' WHEN nuc_area > 5000 THEN 'large_nucleus'
  WHEN cell_area < 50 THEN 'small_cell' WHEN cell_area / CAST(nuc_area AS DOUBLE) > 3.95 THEN 'high_ratio' WHEN coalesce(coverage, 0) < 0.3 THEN 'low_membrane' ELSE 'kept' END AS reason
  FROM areas a LEFT JOIN cover USING (slide_id, tile_id, id) WHERE nuc_area > 0)"""


@query("filter_cells", f"WITH {FILTERED} SELECT slide_id, tile_id, id, reason FROM filtered")
def _(t):
    return I.filter_cells(t.stained, max_ratio=3.95).select("slide_id", "tile_id", "id", "reason")


REASONS = ("kept", "small_nucleus", "large_nucleus", "small_cell", "high_ratio", "low_membrane")


@query("filter_reason_counts", f"WITH {FILTERED} SELECT slide_id, tile_id, " + ", ".join(
    f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in REASONS) + ", count(*) AS total FROM filtered GROUP BY ALL")
def _(t):
    return I.filter_reason_counts(I.filter_cells(t.stained, max_ratio=3.95))


@query("drop_small_instances", f"SELECT {KEY}, CASE WHEN count(*) OVER (PARTITION BY tile_id, cell_id) >= 441 THEN cell_id ELSE 0 END AS cell_id FROM pixels")
def _(t):
    return I.drop_small_instances(t.pixels, 441).select(*COLS, "cell_id")


@query("tile_stats", f"""WITH {AREAS}, c AS (SELECT slide_id, tile_id, avg(CASE WHEN cell_id > 0 THEN 1.0 ELSE 0.0 END) AS cv FROM pixels GROUP BY ALL)
SELECT c.slide_id, c.tile_id, round(any_value(cv), 6) AS tile_coverage, count(*) FILTER (WHERE nuc_area > 0) AS num_nuclei, count(*) FILTER (WHERE cell_area > 0) AS num_cells,
  round(coalesce(avg(nuc_area) FILTER (WHERE nuc_area > 0), 0), 6) AS mean_nucleus_area, round(coalesce(avg(cell_area) FILTER (WHERE cell_area > 0), 0), 6) AS mean_cell_area,
  round(coalesce(avg(cell_area / CAST(nuc_area AS DOUBLE)) FILTER (WHERE nuc_area > 0 AND cell_area > 0), 0), 6) AS mean_cell_nucleus_ratio,
  round(coalesce(stddev_pop(cell_area / CAST(nuc_area AS DOUBLE)) FILTER (WHERE nuc_area > 0 AND cell_area > 0), 0), 6) AS std_cell_nucleus_ratio
FROM c LEFT JOIN areas USING (slide_id, tile_id) GROUP BY ALL""")
def _(t):
    return rounded(I.tile_stats(t.pixels))


@query("area_ratio_stats", f"""WITH {AREAS}, r AS (SELECT slide_id, tile_id, cell_area / CAST(nuc_area AS DOUBLE) AS r FROM areas WHERE nuc_area > 0 AND cell_area > 0)
SELECT slide_id, tile_id, count(*) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(stddev_pop(r), 6) AS std, round(min(r), 6) AS min, round(max(r), 6) AS max FROM r GROUP BY ALL""")
def _(t):
    return rounded(I.area_ratio_stats(t.pixels))


@query("center_zone_filter", """SELECT slide_id, tile_id, nuc_id AS id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM pixels WHERE nuc_id > 0 GROUP BY ALL
HAVING avg(x) >= 20 AND avg(x) < 44 AND avg(y) >= 20 AND avg(y) < 44""")
def _(t):
    return rounded(I.center_zone_filter(t.pixels, 64, 20))


IN3 = eroded("cell_id", 1, "in3")
COMP = f"cp AS ({eroded('cell_id', 4, 'in5', f'({IN3}) z3')})"
RING, NUC = "(NOT in5)", "(nuc_id = cell_id)"


@query("ring_fixed", f"""WITH {COMP} SELECT slide_id, tile_id, cell_id, count(*) AS n_px, count(*) FILTER (WHERE {NUC}) AS n_nucleus, count(*) FILTER (WHERE {RING}) AS n_ring,
  count(*) FILTER (WHERE NOT {RING} AND NOT {NUC}) AS n_cytoplasm, round(avg(dab) FILTER (WHERE {RING}), 6) AS membrane,
  CASE WHEN count(*) FILTER (WHERE NOT {RING} AND NOT {NUC}) >= 4 THEN round(avg(dab) FILTER (WHERE NOT {RING} AND NOT {NUC}), 6) END AS cytoplasm, round(avg(dab) FILTER (WHERE {NUC}), 6) AS nucleus
FROM cp WHERE cell_id > 0 GROUP BY ALL HAVING count(*) >= 20 AND count(*) FILTER (WHERE {NUC}) > 0 AND count(*) FILTER (WHERE {RING}) >= 5""")
def _(t):
    return rounded(I.ring_fixed(t.stained))


WEIGHT = "greatest(bar, 0.0)"


@query("ring_bar_weighted", f"""WITH {COMP} SELECT slide_id, tile_id, cell_id, count(*) AS n_ring, round(avg(dab), 6) AS raw_membrane_dab,
  round(CASE WHEN sum({WEIGHT}) > 0 THEN sum(dab * {WEIGHT}) / sum({WEIGHT}) ELSE avg(dab) END, 6) AS membrane_ring_dab FROM cp WHERE cell_id > 0 AND {RING} GROUP BY ALL""")
def _(t):
    return rounded(I.ring_bar_weighted(t.stained))


@query("cell_bar_weighted", f"""WITH {EDGE} SELECT slide_id, tile_id, cell_id, count(*) AS n_px, count(*) FILTER (WHERE {NUC}) AS n_nucleus, count(*) FILTER (WHERE bar > 0) AS n_membrane,
  count(*) FILTER (WHERE NOT bar > 0 AND NOT {NUC}) AS n_cytoplasm,
  round(CASE WHEN sum({WEIGHT}) > 0 THEN sum(dab * {WEIGHT}) / sum({WEIGHT}) ELSE avg(dab) END, 6) AS membrane,
  CASE WHEN count(*) FILTER (WHERE NOT bar > 0 AND NOT {NUC}) >= 4 THEN round(avg(dab) FILTER (WHERE NOT bar > 0 AND NOT {NUC}), 6) END AS cytoplasm,
  round(avg(dab) FILTER (WHERE {NUC}), 6) AS nucleus, round(avg(CASE WHEN bar > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT in3), 6) AS completeness
FROM e3 WHERE cell_id > 0 GROUP BY ALL HAVING count(*) >= 20 AND count(*) FILTER (WHERE {NUC}) > 0 AND count(*) FILTER (WHERE bar > 0) >= 3""")
def _(t):
    return rounded(I.cell_bar_weighted(t.stained))


@query("cell_soft_weighted", """SELECT slide_id, tile_id, cell_id, round(sum(dab * prob) / sum(prob), 6) AS membrane, round(sum(dab * (1 - prob)) / sum(1 - prob), 6) AS cytoplasm
FROM stained WHERE cell_id > 0 GROUP BY ALL HAVING sum(prob) > 0.1 AND sum(1 - prob) > 0.1""")
def _(t):
    return rounded(I.cell_soft_weighted(t.stained.withColumn("cyto", 1.0 - F.col("prob")), "prob", "cyto"))


@query("cell_class_compartments", """WITH l AS (SELECT *, CASE WHEN nuc_id > 0 THEN 1 WHEN cell_id > 0 AND bar > 0 THEN 3 WHEN cell_id > 0 THEN 2 ELSE 0 END AS label FROM stained)
SELECT slide_id, tile_id, cell_id, count(*) AS n_px, count(*) FILTER (WHERE label = 3) AS n_membrane, count(*) FILTER (WHERE label = 2) AS n_cytoplasm,
  round(avg(dab) FILTER (WHERE label = 3), 6) AS membrane, round(avg(dab) FILTER (WHERE label = 2), 6) AS cytoplasm
FROM l WHERE cell_id > 0 GROUP BY ALL HAVING count(*) >= 20 AND count(*) FILTER (WHERE label = 3) >= 3 AND count(*) FILTER (WHERE label = 2) >= 3""")
def _(t):
    return rounded(I.cell_class_compartments(P.compartment_label(t.stained)))


@query("membrane_completeness", f"""WITH {EDGE} SELECT slide_id, tile_id, cell_id, count(*) AS n_edge, round(avg(CASE WHEN bar > 0 AND dab > 0.10 THEN 1.0 ELSE 0.0 END), 6) AS membrane_completeness
FROM e3 WHERE cell_id > 0 AND NOT in3 GROUP BY ALL""")
def _(t):
    return rounded(I.membrane_completeness(t.stained))


@query("measure_cells", f"""WITH {COMP}, s AS (SELECT slide_id, tile_id, cell_id, count(*) AS n_px, count(*) FILTER (WHERE {RING}) AS n_ring, avg(dab) AS dm, avg(x) AS cx, avg(y) AS cy,
  CASE WHEN sum({WEIGHT}) FILTER (WHERE {RING}) > 0 THEN sum(dab * {WEIGHT}) FILTER (WHERE {RING}) / sum({WEIGHT}) FILTER (WHERE {RING}) ELSE avg(dab) FILTER (WHERE {RING}) END AS w,
  avg(dab) FILTER (WHERE {RING}) AS raw, avg(CASE WHEN bar > 0 AND dab > 0.10 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT in3) AS comp,
  CASE WHEN count(*) FILTER (WHERE NOT in3) > 3 THEN count(*) FILTER (WHERE {RING}) / CAST(count(*) FILTER (WHERE NOT in3) AS DOUBLE) END AS th FROM cp WHERE cell_id > 0 GROUP BY ALL)
SELECT slide_id, tile_id, cell_id, n_px, n_ring, round(dm, 6) AS dab_mean, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(w, 6) AS membrane_ring_dab, round(raw, 6) AS raw_membrane_dab,
  round(comp, 6) AS membrane_completeness, round(th, 6) AS membrane_thickness_px, round(th * 0.5, 6) AS membrane_thickness_um,
  CAST(CASE WHEN w IS NULL OR w < 0.10 THEN 0 WHEN w < 0.20 THEN 1 WHEN w < 0.35 THEN 2 ELSE 3 END AS TINYINT) AS grade_dab,
  CAST(CASE WHEN th IS NULL OR comp IS NULL OR raw IS NULL OR raw < 0.05 THEN 0 WHEN raw < 0.15 THEN 1 WHEN th >= 8 OR (comp >= 0.5 AND raw >= 0.30) THEN 3 WHEN comp >= 0.5 OR raw >= 0.30 THEN 2 ELSE 1 END AS TINYINT) AS grade_composite,
  FALSE AS thresholds_calibrated FROM s""")
def _(t):
    return rounded(I.measure_cells(t.stained, 0.5))


UNION = f"un AS ({box('pixels', 'cell_id', 'min', 4, 'u5')}), un2 AS ({box('un', 'cell_id', 'min', 1, 'u3')})"
THICK = f"""WITH {UNION}, s AS (SELECT slide_id, tile_id, cell_id, count(*) FILTER (WHERE u5 = 0) AS n_ring, count(*) FILTER (WHERE u3 = 0) AS n_edge FROM un2 WHERE cell_id > 0 GROUP BY ALL)"""


@query("thickness_ratio", THICK + " SELECT slide_id, tile_id, cell_id, n_ring, n_edge, CASE WHEN n_edge > 3 THEN round(n_ring / CAST(n_edge AS DOUBLE), 6) END AS thickness_ratio FROM s")
def _(t):
    return rounded(I.thickness_ratio(t.pixels))


CROSS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)"
DIAMOND = ", ".join(f"({dx}, {dy})" for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) <= 2)
REPEAT = f"""WITH b AS (SELECT DISTINCT s.slide_id, s.tile_id, s.cell_id AS id, s.x, s.y FROM (SELECT slide_id, tile_id, cell_id, x, y, x + dx AS nx, y + dy AS ny FROM stained, {CROSS} WHERE cell_id > 0) s
  JOIN stained q ON q.tile_id = s.tile_id AND q.x = s.nx AND q.y = s.ny WHERE q.cell_id <> s.cell_id),
r AS (SELECT DISTINCT slide_id, tile_id, id, x + dx AS x, y + dy AS y FROM b, (VALUES {DIAMOND}) o(dx, dy)),
rr AS (SELECT r.slide_id, r.tile_id, r.id, q.dab, q.bar FROM r JOIN stained q ON q.tile_id = r.tile_id AND q.x = r.x AND q.y = r.y
  LEFT JOIN b ON b.tile_id = r.tile_id AND b.id = r.id AND b.x = r.x AND b.y = r.y WHERE q.cell_id <> r.id OR b.id IS NOT NULL),
s AS (SELECT slide_id, tile_id, id AS cell_id, count(*) AS n, avg(bar) * avg(CASE WHEN dab > 0.1 THEN 1.0 ELSE 0.0 END) AS v FROM rr GROUP BY ALL
  HAVING count(*) >= 3), z AS (SELECT tile_id, cell_id, count(*) AS px FROM stained WHERE cell_id > 0 GROUP BY ALL HAVING count(*) >= 5)"""


@query("thickness_disc", REPEAT + " SELECT slide_id, tile_id, cell_id, round(2 * sqrt(n / (pi() + 1e-8)), 6) AS thickness_disc FROM s JOIN z USING (tile_id, cell_id)")
def _(t):
    return rounded(I.repeat_run_cells(t.stained).select("slide_id", "tile_id", "cell_id", "thickness_disc"))


@query("grade_bar_completeness", REPEAT + """ SELECT slide_id, tile_id, cell_id, CASE WHEN v < 0.10 THEN 0 WHEN v < 0.20 THEN 1 WHEN v < 0.35 THEN 2 ELSE 3 END AS grade FROM s JOIN z USING (tile_id, cell_id)""")
def _(t):
    return I.repeat_run_cells(t.stained).select("slide_id", "tile_id", "cell_id", "grade")


def rings(k: int) -> str:
    rows = ", ".join(f"({dx}, {dy})" for dx, dy in ellipse(k))
    return f"""nr AS (SELECT s.slide_id, s.tile_id, s.id, q.dab FROM (SELECT DISTINCT slide_id, tile_id, nuc_id AS id, x + dx AS nx, y + dy AS ny FROM stained, (VALUES {rows}) o(dx, dy) WHERE nuc_id > 0) s
  JOIN stained q ON q.tile_id = s.tile_id AND q.x = s.nx AND q.y = s.ny WHERE q.nuc_id <> s.id)"""


EXPANSION = f"""{COMP}, {rings(21)}, m AS (SELECT slide_id, tile_id, cell_id, avg(dab) FILTER (WHERE {RING}) AS md FROM cp WHERE cell_id > 0 GROUP BY ALL
  HAVING count(*) >= 20 AND count(*) FILTER (WHERE {NUC}) > 0 AND count(*) FILTER (WHERE {RING}) >= 3),
e AS (SELECT slide_id, tile_id, id AS cell_id, count(*) AS n, avg(dab) AS ed FROM nr GROUP BY ALL),
ex AS (SELECT slide_id, tile_id, cell_id, md, coalesce(n, 0) AS n, CASE WHEN n >= 3 THEN ed ELSE md END AS ed FROM m LEFT JOIN e USING (slide_id, tile_id, cell_id))"""


@query("expansion_ring_dab", f"WITH {EXPANSION} SELECT slide_id, tile_id, cell_id, round(md, 6) AS model_dab, n AS n_expansion, round(ed, 6) AS expansion_dab FROM ex")
def _(t):
    return rounded(I.expansion_ring_dab(t.stained))


def _g(v: str) -> str:
    return f"(CASE WHEN {v} < 0.10 THEN 0 WHEN {v} < 0.20 THEN 1 WHEN {v} < 0.35 THEN 2 ELSE 3 END)"


@query("hscore_by_boundary", f"""WITH {EXPANSION} SELECT slide_id, tile_id, count(*) AS n_cells, round(100 * avg({_g('md')}), 6) AS model_h_score,
  round(100 * avg(CASE WHEN {_g('md')} >= 2 THEN 1.0 ELSE 0.0 END), 6) AS model_pct_positive, round(100 * avg({_g('ed')}), 6) AS expansion_h_score,
  round(100 * avg(CASE WHEN {_g('ed')} >= 2 THEN 1.0 ELSE 0.0 END), 6) AS expansion_pct_positive FROM ex GROUP BY ALL""")
def _(t):
    return rounded(I.hscore_by_boundary(t.stained))


@query("nucleus_interior_dab", f"""WITH n AS ({eroded('nuc_id', 2, 'inn')}) SELECT slide_id, tile_id, nuc_id AS id, round(avg(dab), 6) AS nucleus_dab, count(*) FILTER (WHERE inn) AS n_interior,
  CASE WHEN count(*) FILTER (WHERE inn) > 10 THEN round(avg(dab) FILTER (WHERE inn), 6) END AS interior_dab FROM n WHERE nuc_id > 0 GROUP BY ALL""")
def _(t):
    return rounded(I.nucleus_interior_dab(t.stained))


RSCORE = f"""{rings(11)}, rr AS (SELECT slide_id, tile_id, id, count(*) AS n, avg(dab) AS r FROM nr GROUP BY ALL),
nn AS (SELECT slide_id, tile_id, nuc_id AS id, count(*) AS nn, avg(dab) AS d FROM stained WHERE nuc_id > 0 GROUP BY ALL),
q AS (SELECT slide_id, tile_id, avg(r / (r + d)) AS v FROM rr JOIN nn USING (slide_id, tile_id, id) WHERE n >= 10 AND nn >= 10 AND r + d > 0.01 GROUP BY ALL),
td AS (SELECT slide_id, tile_id, avg(dab) AS td FROM stained GROUP BY ALL), rscore AS (SELECT slide_id, tile_id, td, coalesce(v * least(td / 0.15, 1.0), 0) AS ring_score FROM td LEFT JOIN q USING (slide_id, tile_id))"""


@query("nucleus_ring_score", f"WITH {RSCORE} SELECT slide_id, tile_id, round(ring_score, 6) AS ring_score FROM rscore")
def _(t):
    return rounded(I.nucleus_ring_score(t.stained))


@query("cell_density_px", "SELECT slide_id, tile_id, count(DISTINCT nuc_id) FILTER (WHERE nuc_id > 0) AS n_instances, round(count(DISTINCT nuc_id) FILTER (WHERE nuc_id > 0) / CAST(count(*) AS DOUBLE) * 10000, 6) AS per_10k_px FROM pixels GROUP BY ALL")
def _(t):
    return rounded(I.cell_density(t.pixels).drop("per_mm2"))


@query("cell_density_mm2", "SELECT slide_id, tile_id, round(count(DISTINCT cell_id) FILTER (WHERE cell_id > 0) / (count(*) * pow(CAST(0.5 AS DOUBLE) / 1000, 2)), 6) AS per_mm2 FROM pixels GROUP BY ALL")
def _(t):
    return rounded(I.cell_density(t.pixels, "cell_id").select("slide_id", "tile_id", "per_mm2"))


G2_ROWS = ", ".join(f"({i - 8}, CAST('{float(w)!r}' AS DOUBLE))" for i, w in enumerate(gaussian_weights(2.0)))
#: Mean DAB of a cell's box by signed distance in 20 bins, gaps bridged by straight lines, width at half of the peak.
RADIAL = f"""g1 AS ({gather('stained', f'(VALUES {G2_ROWS}) o(d, w)', symmetric('p.x + d'), 'p.y', 'sum(q.dab * w) AS v')}),
g2 AS ({gather('g1', f'(VALUES {G2_ROWS}) o(d, w)', 'p.x', symmetric('p.y + d'), 'sum(q.v * w) AS dab')}),
boxes AS (SELECT slide_id, tile_id, cell_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM stained WHERE cell_id > 0 GROUP BY ALL HAVING count(*) >= 20),
px AS (SELECT c.slide_id, c.tile_id, c.cell_id, s.x, s.y, g2.dab, s.cell_id = c.cell_id AS inn FROM boxes c
  JOIN stained s ON s.tile_id = c.tile_id AND s.x BETWEEN x0 AND x1 AND s.y BETWEEN y0 AND y1 JOIN g2 ON g2.tile_id = s.tile_id AND g2.x = s.x AND g2.y = s.y),
gap AS (SELECT p.slide_id, p.tile_id, p.cell_id, p.x, p.y, p.dab, p.inn, min(abs(p.y - q.y)) FILTER (WHERE NOT q.inn) AS go, min(abs(p.y - q.y)) FILTER (WHERE q.inn) AS gi
  FROM px p JOIN px q ON q.tile_id = p.tile_id AND q.cell_id = p.cell_id AND q.x = p.x GROUP BY ALL),
away AS (SELECT p.slide_id, p.tile_id, p.cell_id, p.x, p.y, p.dab, CASE WHEN p.inn THEN sqrt(CAST(min((p.x - q.x) * (p.x - q.x) + q.go * q.go) AS DOUBLE))
  ELSE -sqrt(CAST(min((p.x - q.x) * (p.x - q.x) + q.gi * q.gi) AS DOUBLE)) END AS s
  FROM gap p JOIN gap q ON q.tile_id = p.tile_id AND q.cell_id = p.cell_id AND q.y = p.y GROUP BY p.slide_id, p.tile_id, p.cell_id, p.x, p.y, p.dab, p.inn),
sbins AS (SELECT slide_id, tile_id, cell_id, CAST(floor((s + 15) / CAST(1.5 AS DOUBLE)) AS INT) AS b, avg(dab) AS v FROM away WHERE s >= -15 AND s < 15 GROUP BY ALL HAVING count(*) >= 2),
known AS (SELECT slide_id, tile_id, cell_id, list({{'b': b, 'v': v}} ORDER BY b) AS k FROM sbins GROUP BY ALL HAVING count(*) >= 3),
ends AS (SELECT slide_id, tile_id, cell_id, i, list_last(list_filter(k, lambda e: e.b <= i)) AS lo, list_filter(k, lambda e: e.b >= i)[1] AS hi FROM known, range(0, 20) r(i)),
prof AS (SELECT slide_id, tile_id, cell_id, i, CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL OR lo.b = hi.b THEN lo.v ELSE lo.v + (hi.v - lo.v) * (i - lo.b) / (hi.b - lo.b) END AS v FROM ends),
up AS (SELECT *, v >= max(v) OVER w / 2 AS a, max(v) OVER w AS peak FROM prof WINDOW w AS (PARTITION BY tile_id, cell_id)),
turn AS (SELECT *, lead(a) OVER (PARTITION BY tile_id, cell_id ORDER BY i) AS nxt FROM up),
widths AS (SELECT slide_id, tile_id, cell_id, max(peak) AS peak, abs(coalesce(max(i) FILTER (WHERE a AND NOT nxt), 19) - coalesce(min(i) FILTER (WHERE NOT a AND nxt) + 1, 0)) * CAST(1.5 AS DOUBLE) AS wide FROM turn GROUP BY ALL)"""


@query("thickness_radial_fwhm", f"""WITH {RADIAL} SELECT c.slide_id, c.tile_id, c.cell_id, round(CASE WHEN peak >= CAST('{DAB_POSITIVE!r}' AS DOUBLE) AND wide > 0 THEN wide END, 6) AS thickness_px
FROM boxes c LEFT JOIN widths f ON f.tile_id = c.tile_id AND f.cell_id = c.cell_id""")
def _(t):
    soft = gaussian_smooth(t.stained, "dab", 2.0, "dab_soft", EXTENT, carry=["cell_id"])
    return rounded(R.thickness_radial_fwhm(soft.withColumnRenamed("dab_soft", "dab")))


def octagons(t):
    """An eight-cornered outline of every cell of the tiles, from the cell's own extent."""
    c = t.pixels.filter("cell_id > 0").groupBy("slide_id", "tile_id", "cell_id").agg(F.expr("avg(x) + 0.25D").alias("cx"), F.expr("avg(y) + 0.25D").alias("cy"))
    pts = [("11.5", "4.5"), ("4.5", "11.5"), ("-4.5", "11.5"), ("-11.5", "4.5"), ("-11.5", "-4.5"), ("-4.5", "-11.5"), ("4.5", "-11.5"), ("11.5", "-4.5")]
    return c.selectExpr("slide_id", "tile_id", "cell_id", SPARK.ring([(f"cx + {a}D", f"cy + {b}D") for a, b in pts]) + " AS ring")


@query("thickness_ray_fwhm")
def _(t):
    return rounded(R.thickness_ray_fwhm(octagons(t), t.stained))


@query("ring_adaptive")
def _(t):
    return rounded(R.ring_adaptive(t.stained, EXTENT))


@query("ring_adaptive_relaxed")
def _(t):
    return rounded(R.ring_adaptive(t.stained, EXTENT, rays=8, outer=(2, 3), band=5, min_reach=3, min_rays=2))


IOU = """it AS (SELECT slide_id, tile_id, pred_id AS p, cell_id AS g, count(*) AS inter FROM pixels WHERE pred_id > 0 AND cell_id > 0 GROUP BY ALL),
ap AS (SELECT tile_id, pred_id AS p, count(*) AS area_p FROM pixels WHERE pred_id > 0 GROUP BY ALL), ag AS (SELECT tile_id, cell_id AS g, count(*) AS area_g FROM pixels WHERE cell_id > 0 GROUP BY ALL),
iou AS (SELECT *, inter / CAST(area_p + area_g - inter AS DOUBLE) AS iou FROM it JOIN ap USING (tile_id, p) JOIN ag USING (tile_id, g))"""
MATCH = f"{IOU}, th(threshold) AS (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE))), mt AS (SELECT * FROM iou, th WHERE iou >= threshold)"
COUNTS_SQL = f"""{MATCH}, ti AS (SELECT slide_id, tile_id, count(DISTINCT pred_id) FILTER (WHERE pred_id > 0) AS n_pred, count(DISTINCT cell_id) FILTER (WHERE cell_id > 0) AS n_gt FROM pixels GROUP BY ALL),
mc AS (SELECT ti.slide_id, ti.tile_id, th.threshold, n_pred, n_gt, count(mt.p) AS tp FROM ti CROSS JOIN th LEFT JOIN mt ON mt.tile_id = ti.tile_id AND mt.threshold = th.threshold GROUP BY ALL)"""


@query("instance_iou", f"WITH {IOU} SELECT slide_id, tile_id, p, g, inter, area_p, area_g, round(iou, 6) AS iou FROM iou")
def _(t):
    return rounded(M.instance_iou(t.pixels, "pred_id", "cell_id"))


@query("match_instances", f"WITH {COUNTS_SQL} SELECT slide_id, tile_id, threshold, n_pred, n_gt, tp, n_pred - tp AS fp, n_gt - tp AS fn FROM mc")
def _(t):
    return rounded(M.match_counts(t.pixels, "pred_id", "cell_id"))


@query("match_instances_low", f"WITH {IOU}, b AS (SELECT *, row_number() OVER (PARTITION BY tile_id, g ORDER BY iou DESC, p) AS r FROM iou WHERE iou >= 0.3) SELECT slide_id, tile_id, p, g, round(iou, 6) AS iou FROM b WHERE r = 1")
def _(t):
    return rounded(M.match_instances(M.instance_iou(t.pixels, "pred_id", "cell_id"), 0.3).select("slide_id", "tile_id", "p", "g", "iou"))


@query("detection_metrics", f"""WITH {COUNTS_SQL}, s AS (SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred - tp) AS BIGINT) AS fp, CAST(sum(n_gt - tp) AS BIGINT) AS fn FROM mc GROUP BY threshold),
v AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS pr, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS re FROM s)
SELECT threshold, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(pr * re, 6) AS ap FROM v""")
def _(t):
    return rounded(M.detection_metrics(M.match_counts(t.pixels, "pred_id", "cell_id")))


@query("dice_matched", f"""WITH {MATCH} SELECT ti.slide_id, ti.tile_id, round(coalesce(avg(2 * inter / CAST(area_p + area_g AS DOUBLE)), 0), 6) AS dice
FROM (SELECT DISTINCT slide_id, tile_id FROM pixels) ti LEFT JOIN (SELECT * FROM mt WHERE threshold = 0.5) m USING (tile_id) GROUP BY ALL""")
def _(t):
    return rounded(M.dice_matched(t.pixels, "pred_id", "cell_id"))


@query("macro_average", f"""WITH {COUNTS_SQL} SELECT threshold, count(*) AS tiles, round(avg(coalesce(tp / CAST(nullif(n_pred, 0) AS DOUBLE), 0)), 6) AS precision, round(avg(coalesce(tp / CAST(nullif(n_gt, 0) AS DOUBLE), 0)), 6) AS recall FROM mc GROUP BY threshold""")
def _(t):
    per_tile = M.detection_metrics(M.match_counts(t.pixels, "pred_id", "cell_id"), ["slide_id", "tile_id", "threshold"])
    return rounded(M.macro_average(per_tile, ["precision", "recall"], ["threshold"]))


@query("iou_vs_expansion", f"""WITH n AS (SELECT {KEY}, nuc_id FROM pixels), e AS ({near('n', 'nuc_id', ellipse(21), 'max', 'expanded')}), j AS (SELECT slide_id, tile_id, cell_id, expanded FROM pixels JOIN e USING (slide_id, tile_id, x, y)),
c AS (SELECT slide_id, tile_id, cell_id AS i, count(*) FILTER (WHERE expanded = cell_id) AS inter, count(*) AS a FROM j WHERE cell_id > 0 GROUP BY ALL),
x AS (SELECT slide_id, tile_id, expanded AS i, count(*) AS b FROM j WHERE expanded > 0 GROUP BY ALL), v AS (SELECT c.slide_id, inter / CAST(a + b - inter AS DOUBLE) AS iou FROM c JOIN x USING (slide_id, tile_id, i) WHERE inter > 0)
SELECT slide_id, count(*) AS n_cells, round(avg(iou), 6) AS mean_iou, round(100 * avg(CASE WHEN iou < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS pct_differ, round(quantile_cont(iou, 0.5), 6) AS median_iou FROM v GROUP BY slide_id""")
def _(t):
    return rounded(M.iou_vs_expansion(t.pixels))


@query("cells_per_model", "SELECT model, CAST(sum(n) AS BIGINT) AS n_cells, count(*) FILTER (WHERE n > 0) AS n_tiles FROM (SELECT tile_id, model, max(inst_id) AS n FROM labels_long GROUP BY ALL) a GROUP BY model")
def _(t):
    return M.cells_per_model(t.labels_long)


@query("consensus_pixels", """WITH m AS (SELECT tile_id, model, max(inst_id) AS top FROM labels_long GROUP BY ALL HAVING max(inst_id) > 0),
b AS (SELECT tile_id, count(*) AS k, (list(model ORDER BY top DESC, model))[1] AS best FROM m GROUP BY tile_id)
SELECT slide_id, tile_id, x, y, max(inst_id) FILTER (WHERE model = best) AS consensus_id FROM labels_long JOIN b USING (tile_id) WHERE k >= 2 GROUP BY ALL
HAVING count(*) FILTER (WHERE inst_id > 0) >= 2 AND max(inst_id) FILTER (WHERE model = best) > 0""")
def _(t):
    return M.consensus_pixels(t.labels_long, ["A", "B", "C"])


@query("consensus_instances")
def _(t):
    return M.consensus_instances(t.labels_long)


def walls(t):
    return t.stained.withColumn("wall", (F.col("dab") > 1.2) & (F.col("nuc_id") == 0))


@query("grow_regions")
def _(t):
    return W.grow_regions(walls(t), "wall", 20, extent=EXTENT)


@query("regrow_from_probability")
def _(t):
    return W.regrow_from_probability(t.pixels, cap=20, extent=EXTENT)


def _shrink_sql(rounds: int = 4) -> str:
    ctes = ["ns AS (SELECT tile_id, nuc_id AS i, count(*) AS sz FROM pixels WHERE nuc_id > 0 GROUP BY ALL)",
            "s0 AS (SELECT s.*, s.cell_id AS rid, TRUE AS live, sz FROM stained s LEFT JOIN ns ON ns.tile_id = s.tile_id AND ns.i = s.cell_id)"]
    for k in range(rounds):
        ctes += [f"a{k} AS ({box(f's{k}', 'rid', 'min', 1, f'lo{k}')})",
                 f"b{k} AS (SELECT *, live AND rid > 0 AND lo{k} <> rid AND (dab < {0.10 * (1 + 0.5 * k)} OR bar <= 0) AND nuc_id = 0 AS p{k} FROM a{k})",
                 f"c{k} AS (SELECT *, p{k} AND NOT coalesce(count(*) OVER w - count(*) FILTER (WHERE p{k}) OVER w < sz * 1.2, FALSE) AS e{k} FROM b{k} WINDOW w AS (PARTITION BY tile_id, rid))",
                 f"s{k + 1} AS (SELECT * REPLACE (CASE WHEN e{k} THEN 0 ELSE rid END AS rid, bool_or(e{k}) OVER (PARTITION BY tile_id) AS live) FROM c{k})"]
    return "WITH " + ", ".join(ctes) + f" SELECT {KEY}, rid AS refined_id FROM s{rounds}"


@query("shrink_to_membrane", _shrink_sql())
def _(t):
    return W.shrink_to_membrane(t.stained).select(*COLS, "refined_id")


PROXY = f"""{TEXTURE}, px AS (SELECT slide_id, tile_id, 1 - avg({GRAY8}) / 255 AS darkness, avg({SAT}) / 255 AS saturation FROM pixels GROUP BY ALL),
proxy AS (SELECT slide_id, tile_id, darkness, texture, saturation, 0.3 * darkness + 0.4 * texture + 0.3 * saturation AS score FROM px JOIN texture USING (slide_id, tile_id))"""


@query("tile_epithelial_proxy", f"WITH {PROXY} SELECT slide_id, tile_id, round(darkness, 6) AS darkness, round(texture, 6) AS texture, round(saturation, 6) AS saturation, round(score, 6) AS score FROM proxy")
def _(t):
    return rounded(TF.tile_epithelial_proxy(t.pixels))


VISION = f"""{RSCORE}, pv AS (SELECT slide_id, tile_id, avg({SAT}) / 255 AS sat, least(count(DISTINCT nuc_id) FILTER (WHERE nuc_id > 0) / CAST(count(*) AS DOUBLE) * 10000 / 15, 1.0) AS den FROM pixels GROUP BY ALL),
vision AS (SELECT slide_id, tile_id, greatest(0, least(1.0, 0.35 * least(td / 0.30, 1.0) + 0.30 * ring_score + 0.20 * den + 0.15 * sat)) AS score FROM rscore JOIN pv USING (slide_id, tile_id))"""


@query("tile_vision_score", f"WITH {VISION} SELECT slide_id, tile_id, round(score, 6) AS score FROM vision")
def _(t):
    return rounded(TF.tile_vision_score(t.stained))


def dropped(scores: str, least: float) -> str:
    return f"""tn AS (SELECT slide_id, tile_id, max(nuc_id) AS top FROM pixels GROUP BY ALL), kc AS (SELECT slide_id, tile_id, cell_id, avg(dab) AS dm FROM stained WHERE cell_id > 0 GROUP BY ALL HAVING avg(dab) >= 0.10),
kt AS (SELECT slide_id, tile_id, count(*) AS nk FROM kc GROUP BY ALL),
reasons AS (SELECT slide_id, tile_id, CASE WHEN top = 0 THEN 'no_cells' WHEN coalesce(score, 0) < {least} THEN 'stromal' WHEN nk IS NULL THEN 'negative_dab' ELSE 'kept' END AS reason
  FROM tn LEFT JOIN {scores} sc USING (slide_id, tile_id) LEFT JOIN kt USING (slide_id, tile_id)),
kept AS (SELECT slide_id, tile_id, cell_id, round(dm, 6) AS dab_mean FROM kc SEMI JOIN (SELECT * FROM reasons WHERE reason = 'kept') r USING (slide_id, tile_id))"""


@query("filter_epithelial_proxy", f"WITH {PROXY}, {dropped('proxy', 0.25)} SELECT * FROM kept")
def _(t):
    return rounded(TF.filter_epithelial_proxy(t.stained, 0.25)[1])


@query("filter_epithelial_proxy_reasons", f"WITH {PROXY}, {dropped('proxy', 0.25)} SELECT r.reason, count(tile_id) AS n_tiles FROM (VALUES ('kept'), ('no_cells'), ('stromal'), ('negative_dab')) r(reason) LEFT JOIN reasons USING (reason) GROUP BY ALL")
def _(t):
    return TF.reason_counts(TF.filter_epithelial_proxy(t.stained, 0.25)[0])


@query("filter_ring_pattern", f"WITH {RSCORE}, {dropped('(SELECT *, ring_score AS score FROM rscore)', 0.25)} SELECT * FROM kept")
def _(t):
    return rounded(TF.filter_ring_pattern(t.stained, 0.25)[1])


@query("filter_tile_score", f"WITH {VISION}, {dropped('vision', 0.5)} SELECT * FROM kept")
def _(t):
    return rounded(TF.filter_tile_score(t.stained, 0.5)[1])
