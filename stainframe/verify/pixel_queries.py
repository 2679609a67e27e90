"""Pixel and raster queries and their SQL twins. Tiles are 64 x 64."""

from __future__ import annotations

from pyspark.sql import functions as F

from stainframe.constants import VECTOR_SETS
from stainframe.functions import stain
from stainframe.operators import pixels as P
from stainframe.operators import rasters as R
from stainframe.verify.registry import query, rounded
from stainframe.verify.sqltext import KEY, box, ellipse, gather, near, otsu, uint8

EXTENT = (64, 64)
COLS = ("slide_id", "tile_id", "x", "y")
BRIGHT = "(r + g + b) / CAST(3 AS DOUBLE)"


def od(c: str, fn: str = "ln") -> str:
    return f"(-{fn}(greatest(1, least(255, {c})) / CAST(255 AS DOUBLE)))"


def amount(k: int, vectors=stain.CALIBRATED_ROWS) -> str:
    inv = stain.inverse(vectors)
    return "greatest(CAST(0 AS DOUBLE), " + " + ".join(
        f"{od(c)} * CAST('{float(inv[i, k])!r}' AS DOUBLE)" for i, c in enumerate("rgb")) + ")"


def _vectors():
    """A vector set per supplier: the calibrated one, shifted a little by the key."""
    return ", ".join(f"CAST({v} AS DOUBLE) + (s_suppkey % {5 + j}) * 0.01 AS {s}{j + 1}"
                     for s, row in zip("hdr", stain.CALIBRATED_ROWS) for j, v in enumerate(row))


def _cof(i: int, j: int) -> str:
    a, b, c, d = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
    n = lambda p, q: f"n{'hdr'[p]}{q + 1}"
    return f"({n(a, c)} * {n(b, d)} - {n(a, d)} * {n(b, c)})"


@query("stain_matrix", f"""
WITH v AS (SELECT s_suppkey, {_vectors()} FROM supplier),
u AS (SELECT s_suppkey, """ + ", ".join(f"{s}{i} / sqrt({s}1 * {s}1 + {s}2 * {s}2 + {s}3 * {s}3) AS n{s}{i}" for s in "hdr" for i in (1, 2, 3)) + f""" FROM v),
d AS (SELECT *, nh1 * {_cof(0, 0)} + nh2 * {_cof(0, 1)} + nh3 * {_cof(0, 2)} AS det FROM u)
SELECT s_suppkey, """ + ", ".join(f"round({_cof(j, i)} / det, 6) AS i{i + 1}{j + 1}" for i in range(3) for j in range(3)) + " FROM d")
def _(t):
    v = t.supplier.selectExpr("s_suppkey", *[
        f"{v}D + (s_suppkey % {5 + j}) * 0.01D AS {s}{j + 1}" for s, row in zip("hdr", stain.CALIBRATED_ROWS) for j, v in enumerate(row)])
    return rounded(stain.stain_matrix(v).select("s_suppkey", *[f"i{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]))


@query("deconvolve", f"""SELECT {KEY}, round({amount(0)}, 6) AS hematoxylin, round({amount(1)}, 6) AS dab, round({amount(2)}, 6) AS residual FROM pixels""")
def _(t):
    return rounded(stain.deconvolve(t.pixels).select(*COLS, "hematoxylin", "dab", "residual"))


def _log10(k: int) -> str:
    inv = stain.inverse()
    return " + ".join(f"(-log10(greatest(1e-6, least(1.0, {c} / CAST(255 AS DOUBLE))))) * CAST('{float(inv[k, i])!r}' AS DOUBLE)"
                      for i, c in enumerate("rgb"))


@query("deconvolve_log10", f"SELECT {KEY}, round({_log10(0)}, 6) AS hematoxylin, round({_log10(1)}, 6) AS dab, round({_log10(2)}, 6) AS residual FROM pixels")
def _(t):
    return rounded(stain.deconvolve_log10(t.pixels).select(*COLS, "hematoxylin", "dab", "residual"))


MULTI = " UNION ALL ".join(f"SELECT *, '{n}' AS vector_set, {amount(1, v)} AS dab FROM pixels" for n, v in VECTOR_SETS.items())


@query("deconvolve_multi", f"""WITH m AS ({MULTI}) SELECT slide_id, tile_id, vector_set, round(avg(dab), 6) AS mean_dab, round(max(dab), 6) AS max_dab,
  count(*) FILTER (WHERE dab > 0.5) AS n_high FROM m GROUP BY ALL""")
def _(t):
    m = stain.deconvolve_multi(t.pixels)
    return rounded(m.groupBy("slide_id", "tile_id", "vector_set").agg(
        F.avg("dab").alias("mean_dab"), F.max("dab").alias("max_dab"), F.count_if(F.col("dab") > 0.5).alias("n_high")))


@query("tile_mean_brightness_filter", f"SELECT slide_id, tile_id, round(avg({BRIGHT}), 6) AS mean_brightness FROM pixels GROUP BY ALL HAVING avg({BRIGHT}) < 190")
def _(t):
    return rounded(P.tile_mean_brightness_filter(t.pixels, 190.0))


@query("tile_tissue_fraction", f"SELECT slide_id, tile_id, round(avg(CASE WHEN {BRIGHT} < 199 THEN 1.0 ELSE 0.0 END), 6) AS tissue_fraction FROM pixels WHERE x % 8 = 0 AND y % 8 = 0 GROUP BY ALL")
def _(t):
    return rounded(P.tile_tissue_fraction(t.pixels, 199.0))


@query("tile_accept", f"""SELECT slide_id, tile_id, round(avg({BRIGHT}), 6) AS mean_brightness, round(avg(CASE WHEN {BRIGHT} < 199 THEN 1.0 ELSE 0.0 END), 6) AS dark_share
FROM pixels GROUP BY ALL HAVING avg({BRIGHT}) <= 199 AND avg(CASE WHEN {BRIGHT} < 199 THEN 1.0 ELSE 0.0 END) >= 0.05""")
def _(t):
    return rounded(P.tile_accept(t.pixels, 199.0, 0.05))


@query("tissue_mask_gray", f"SELECT {KEY}, {BRIGHT} < 210 AS tissue FROM pixels")
def _(t):
    return P.tissue_mask_gray(t.pixels, 210.0).select(*COLS, "tissue")


def clamped(table: str, value: str, half: int, out: str) -> str:
    rows = ", ".join(f"({dx}, {dy})" for dx in range(-half, half + 1) for dy in range(-half, half + 1))
    return gather(table, f"(VALUES {rows}) o(dx, dy)", "greatest(0, least(63, p.x + dx))", "greatest(0, least(63, p.y + dy))", f"{value} AS {out}")


def shaped(mask: str, first: str) -> str:
    """Close and two dilations with the 5 x 5 ellipse of mask table `first`."""
    e = ellipse(5)
    return (f"m1 AS ({near(first, mask, e, 'bool_or', 'm')}), m2 AS ({near('m1', 'm', e, 'bool_and', 'm')}), "
            f"m3 AS ({near('m2', 'm', e, 'bool_or', 'm')}), m4 AS ({near('m3', 'm', e, 'bool_or', 'm')})")


@query("tissue_mask_ihc", f"""WITH v AS (SELECT {KEY}, greatest(r, g, b) < 199 AS low FROM pixels), q AS ({clamped('v', 'count(*) FILTER (WHERE q.low) > 24', 3, 'm')}),
{shaped('m', 'q')} SELECT {KEY}, m AS tissue FROM m4""")
def _(t):
    return R.tissue_mask_ihc(t.pixels.select(*COLS, "r", "g", "b"), 199).select(*COLS, "tissue")


SAT = "CAST(floor((greatest(r, g, b) - least(r, g, b)) * CAST(255 AS DOUBLE) / greatest(r, g, b) + 0.5) AS BIGINT)"


@query("tissue_mask_he", f"""WITH v AS (SELECT {KEY}, {SAT} AS s, greatest(r, g, b) < 199 AS low FROM pixels),
q AS ({clamped('v', 'quantile_disc(q.s, 0.5) AS bin, count(*) FILTER (WHERE q.low) > 24', 3, 'low')}),
h AS (SELECT slide_id, tile_id, bin, count(*) AS n FROM q GROUP BY ALL), o AS ({otsu('h', 'slide_id, tile_id')}),
f AS (SELECT q.slide_id, q.tile_id, x, y, q.bin > coalesce(o.bin, 0) OR low AS m FROM q JOIN o USING (slide_id, tile_id)),
{shaped('m', 'f')} SELECT {KEY}, m AS tissue FROM m4""")
def _(t):
    return R.tissue_mask_he(t.pixels, 199, EXTENT).select(*COLS, "tissue")


OTSU = f"""t AS (SELECT slide_id, tile_id, max(dab) AS top FROM stained GROUP BY ALL),
h AS (SELECT slide_id, tile_id, {uint8('dab', 'top')} AS bin, count(*) AS n FROM stained JOIN t USING (slide_id, tile_id) GROUP BY ALL),
o AS ({otsu('h', 'slide_id, tile_id')}),
th AS (SELECT slide_id, tile_id, coalesce(bin, 0) AS bin, coalesce(bin, 0) / CAST(255 AS DOUBLE) * greatest(top, 1e-6) AS threshold FROM o JOIN t USING (slide_id, tile_id))"""


@query("otsu_uint8", f"WITH {OTSU} SELECT slide_id, tile_id, bin, round(threshold, 6) AS threshold FROM th")
def _(t):
    return rounded(P.otsu_uint8(t.stained))


@query("otsu_uint8_mask", f"WITH {OTSU} SELECT {KEY}, dab > threshold AS mask FROM stained JOIN th USING (slide_id, tile_id)")
def _(t):
    return P.threshold_mask(t.stained, P.otsu_uint8(t.stained)).select(*COLS, "mask")


GRAY = f"""gh AS (SELECT slide_id, tile_id, CAST(floor({BRIGHT}) AS BIGINT) AS bin, count(*) AS n FROM pixels GROUP BY ALL), go AS ({otsu('gh', 'slide_id, tile_id')}),
gt AS (SELECT slide_id, tile_id, coalesce(bin + CAST(0.5 AS DOUBLE), 128) AS threshold FROM go)"""


@query("otsu_gray", f"WITH {GRAY} SELECT slide_id, tile_id, round(threshold, 6) AS threshold FROM gt")
def _(t):
    return rounded(P.otsu_gray(t.pixels))


@query("otsu_per_slide", f"""
WITH t AS (SELECT slide_id, max(dab) AS top FROM stained GROUP BY ALL),
h AS (SELECT slide_id, {uint8('dab', 'top')} AS bin, count(*) AS n FROM stained JOIN t USING (slide_id) GROUP BY ALL), o AS ({otsu('h', 'slide_id')})
SELECT slide_id, round(coalesce(bin, 0) / CAST(255 AS DOUBLE) * greatest(top, 1e-6), 6) AS threshold FROM o JOIN t USING (slide_id)""")
def _(t):
    return rounded(P.otsu_per_slide(t.stained))


@query("mask_fixed", f"SELECT {KEY}, dab > 0.15 AS mask FROM stained")
def _(t):
    return P.mask_fixed(t.stained).select(*COLS, "mask")


@query("morph_rect", f"WITH e AS ({box('stained', 'dab', 'min', 4, 'eroded')}), d AS ({box('e', 'dab', 'max', 1, 'dilated')}) "
       f"SELECT {KEY}, round(eroded, 6) AS eroded, round(dilated, 6) AS dilated FROM d")
def _(t):
    e = R.morph_rect(t.stained, "dab", "erode", 5, 2, "eroded")
    return rounded(R.morph_rect(e, "dab", "dilate", 3, 1, "dilated").select(*COLS, "eroded", "dilated"))


@query("morph_ellipse", f"WITH m0 AS (SELECT {KEY}, dab > 0.5 AS m FROM stained), m1 AS ({near('m0', 'm', ellipse(5), 'bool_or', 'm')}), "
       f"m2 AS ({near('m1', 'm', ellipse(5), 'bool_and', 'closed')}), m3 AS ({near('m0', 'm', ellipse(11), 'bool_or', 'grown')}) "
       "SELECT slide_id, tile_id, x, y, closed, grown FROM m2 JOIN m3 USING (slide_id, tile_id, x, y)")
def _(t):
    m = P.mask_fixed(t.stained, 0.5).select(*COLS, "mask")
    m = R.morph_ellipse(m, "mask", "close", 5, 1, "closed")
    return R.morph_ellipse(m, "mask", "dilate", 11, 1, "grown").select(*COLS, "closed", "grown")


KERNEL = ((0.5, -1.0, 0.25), (2.0, 3.0, -0.5), (1.0, 0.0, -2.0))
K_ROWS = ", ".join(f"({i - 1}, {j - 1}, CAST({KERNEL[j][i]} AS DOUBLE))" for j in range(3) for i in range(3))


@query("convolve_kernel", gather("stained", f"(VALUES {K_ROWS}) o(dx, dy, w)", "p.x + dx", "p.y + dy",
                                "round(sum(coalesce(q.dab, 0) * w), 6) AS response", "LEFT JOIN"))
def _(t):
    return rounded(R.convolve_kernel(t.stained, "dab", KERNEL, "response").select(*COLS, "response"))


# The bars from their formula, a column for each orientation, then all products of a pixel's window.
BARS = f"""WITH g AS (SELECT o, dx, dy, exp(-0.5 * (pow((dx * cos(o * pi() / {R.BAR_ORIENTATIONS}) + dy * sin(o * pi() / {R.BAR_ORIENTATIONS})) / {R.BAR_SIGMA_LONG}, 2)
  + pow((dy * cos(o * pi() / {R.BAR_ORIENTATIONS}) - dx * sin(o * pi() / {R.BAR_ORIENTATIONS})) / {R.BAR_SIGMA_SHORT}, 2))) AS w
  FROM range({R.BAR_ORIENTATIONS}) a(o), range(-{R.BAR_SIZE // 2}, {R.BAR_SIZE // 2 + 1}) b(dx), range(-{R.BAR_SIZE // 2}, {R.BAR_SIZE // 2 + 1}) c(dy)),
z AS (SELECT o, dx, dy, w - avg(w) OVER (PARTITION BY o) AS w FROM g),
k AS (SELECT o, dx, dy, w / (sum(abs(w)) OVER (PARTITION BY o) + 1e-10) AS w FROM z),
bars AS (SELECT dx, dy, {", ".join(f"max(w) FILTER (o = {i}) AS w{i}" for i in range(R.BAR_ORIENTATIONS))} FROM k GROUP BY dx, dy)
"""
LARGEST = "greatest(" + ", ".join(f"sum(q.dab * p.w{i})" for i in range(R.BAR_ORIENTATIONS)) + ")"


@query("bar_filter_max", BARS + gather("stained", "bars o", "p.x + dx", "p.y + dy", f"round({LARGEST}, 6) AS response"))
def _(t):
    return rounded(R.bar_filter_max(t.stained, "dab", "response", extent=EXTENT))


def mirror(c: str) -> str:
    """Edges mirrored without repeating the edge pixel."""
    return f"(CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 63 THEN 126 - ({c}) ELSE {c} END)"


GRID3 = "(SELECT a.i - 1 AS dx, b.i - 1 AS dy FROM range(3) a(i), range(3) b(i)) o"
SOBEL = f"""sb AS ({gather('stained', GRID3, mirror('p.x + dx'), mirror('p.y + dy'), 'sum(q.dab * dx * (2 - abs(dy))) AS gx, sum(q.dab * dy * (2 - abs(dx))) AS gy')}),
sm AS (SELECT *, sqrt(gx * gx + gy * gy) AS mag, max(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY tile_id) AS top FROM sb),
sobel AS (SELECT {KEY}, CASE WHEN top > 1e-6 THEN mag / top ELSE mag END AS sobel FROM sm)"""


@query("sobel_energy", f"WITH {SOBEL} SELECT {KEY}, round(sobel, 6) AS sobel FROM sobel")
def _(t):
    return rounded(R.sobel_energy(t.stained).select(*COLS, "sobel"))


GRAY8 = "floor(r * CAST(0.299 AS DOUBLE) + g * CAST(0.587 AS DOUBLE) + b * CAST(0.114 AS DOUBLE) + 0.5)"
TEXTURE = f"""g AS (SELECT {KEY}, {GRAY8} AS v FROM pixels),
l AS ({gather('g', '(VALUES (0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)) o(dx, dy, w)', mirror('p.x + dx'), mirror('p.y + dy'), 'sum(q.v * w) AS l')}),
texture AS (SELECT slide_id, tile_id, least(var_pop(l) / 2000, 1.0) AS texture FROM l GROUP BY ALL)"""


@query("laplacian_variance", f"WITH {TEXTURE} SELECT slide_id, tile_id, round(texture, 6) AS texture FROM texture")
def _(t):
    return rounded(R.laplacian_variance(t.pixels))


def symmetric(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 63 THEN 127 - ({c}) ELSE {c} END)"


G_ROWS = ", ".join(f"({i - 4}, CAST('{float(w)!r}' AS DOUBLE))" for i, w in enumerate(R.gaussian_weights(1.0)))


@query("gaussian_smooth", f"""WITH a AS ({gather('stained', f'(VALUES {G_ROWS}) o(d, w)', symmetric('p.x + d'), 'p.y', 'sum(q.dab * w) AS v')})
{gather('a', f'(VALUES {G_ROWS}) o(d, w)', 'p.x', symmetric('p.y + d'), 'round(sum(q.v * w), 6) AS smooth')}""")
def _(t):
    return rounded(R.gaussian_smooth(t.stained, "dab", 1.0, "smooth", EXTENT))


@query("max_filter", f"""SELECT {KEY}, round(max(m) OVER (PARTITION BY tile_id, x ORDER BY y RANGE BETWEEN 6 PRECEDING AND 5 FOLLOWING), 6) AS local_max
FROM (SELECT *, max(dab) OVER (PARTITION BY tile_id, y ORDER BY x RANGE BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS m FROM stained) a""")
def _(t):
    return rounded(R.max_filter(t.stained, "dab", 12, "local_max").select(*COLS, "local_max"))


@query("hsv_saturation_mean", f"SELECT slide_id, tile_id, round(avg({SAT}) / 255, 6) AS saturation FROM pixels GROUP BY ALL")
def _(t):
    return rounded(P.hsv_saturation_mean(t.pixels))


DIST = """dist AS (SELECT p.slide_id, p.tile_id, p.x, p.y, sqrt(least(144, coalesce(min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 144))) AS distance
  FROM stained p LEFT JOIN (SELECT tile_id, x, y FROM stained WHERE dab > 1.2) q
    ON q.tile_id = p.tile_id AND q.x BETWEEN p.x - 12 AND p.x + 12 AND q.y BETWEEN p.y - 12 AND p.y + 12 GROUP BY ALL)"""


@query("distance_to_mask", f"WITH {DIST} SELECT {KEY}, round(distance, 6) AS distance FROM dist")
def _(t):
    return rounded(R.distance_to_mask(P.mask_fixed(t.stained, 1.2), "mask", 12, extent=EXTENT))


@query("distance_to_mask_any", f"""WITH m AS (SELECT tile_id, x, y FROM stained WHERE dab > 1.2), g AS (SELECT p.slide_id, p.tile_id, p.x, p.y, min(abs(p.y - m.y)) AS gap
  FROM stained p LEFT JOIN m ON m.tile_id = p.tile_id AND m.x = p.x GROUP BY ALL)
SELECT {KEY}, round(sqrt(CAST(d AS DOUBLE)), 6) AS distance FROM (SELECT p.slide_id, p.tile_id, p.x, p.y, min((p.x - q.x) * (p.x - q.x) + q.gap * q.gap) AS d
  FROM g p JOIN g q ON q.tile_id = p.tile_id AND q.y = p.y GROUP BY ALL) s""")
def _(t):
    return rounded(R.distance_to_mask(P.mask_fixed(t.stained, 1.2), "mask", None))


@query("weak_signal_flag", "SELECT slide_id, tile_id, round(max(dab), 6) AS max_dab, max(dab) < 1e-4 AS weak FROM stained GROUP BY ALL")
def _(t):
    return rounded(P.weak_signal_flag(t.stained))


def mirrored(axis: str) -> str:
    """A coordinate beyond the 64 pixels of a side, mirrored with the edge pixel repeated."""
    return f"CASE WHEN {axis} + i < 0 THEN -({axis} + i) - 1 WHEN {axis} + i > 63 THEN 127 - ({axis} + i) ELSE {axis} + i END"


WEIGHTS = ", ".join(f"({i - 4}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(R.gaussian_weights(1.0).tolist()))
SMOOTH = f"""gx AS (SELECT p.tile_id, p.x, p.y, sum(p.w * q.distance) AS d FROM (SELECT tile_id, x, y, w, {mirrored('x')} AS nx FROM dist, (VALUES {WEIGHTS}) k(i, w)) p
  JOIN dist q ON q.tile_id = p.tile_id AND q.x = p.nx AND q.y = p.y GROUP BY ALL),
soft AS (SELECT p.tile_id, p.x, p.y, sum(p.w * q.d) AS distance FROM (SELECT tile_id, x, y, w, {mirrored('y')} AS ny FROM dist, (VALUES {WEIGHTS}) k(i, w)) p
  JOIN gx q ON q.tile_id = p.tile_id AND q.x = p.x AND q.y = p.ny GROUP BY ALL),
reach AS (SELECT DISTINCT tile_id, x + dx AS x, y + dy AS y FROM stained, range(-10, 11) a(dx), range(-10, 11) b(dy) WHERE nuc_id > 0 AND dx * dx + dy * dy <= 100)"""


@query("energy_blend", f"""WITH {SOBEL}, {DIST}, {SMOOTH},
j AS (SELECT s.slide_id, s.tile_id, s.x, s.y, dab, nuc_id, sobel, distance, n.x IS NOT NULL AS near FROM stained s JOIN sobel USING (slide_id, tile_id, x, y) JOIN soft USING (tile_id, x, y)
  LEFT JOIN reach n ON n.tile_id = s.tile_id AND n.x = s.x AND n.y = s.y),
t AS (SELECT tile_id, max(dab) < 1e-4 AS weak, max(distance) AS dmax, count(*) FILTER (WHERE dab > 1.2) / CAST(greatest(count(*) FILTER (WHERE nuc_id = 0), 1) AS DOUBLE) AS share FROM j GROUP BY tile_id),
w AS (SELECT *, CASE WHEN share >= 0.005 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS w FROM t)
SELECT {KEY}, round(CASE WHEN NOT near THEN 0 WHEN weak THEN sobel ELSE 1 - ((1 - w) * (CASE WHEN dmax > 1e-6 THEN 1 - distance / dmax ELSE 1 END) + w * sobel) END, 6) AS energy FROM j JOIN w USING (tile_id)""")
def _(t):
    return rounded(R.energy_blend(P.mask_fixed(t.stained, 1.2), "mask", 0.3, 12, extent=EXTENT, radius=10).select(*COLS, "energy"))


@query("expand_nuclei", f"WITH n AS (SELECT {KEY}, nuc_id FROM pixels), e AS ({near('n', 'nuc_id', ellipse(11), 'max', 'expanded')}) SELECT {KEY}, expanded FROM e")
def _(t):
    return R.expand_nuclei(t.pixels.select(*COLS, "nuc_id"), 5).select(*COLS, "expanded")


@query("compartment_label", f"SELECT {KEY}, CASE WHEN nuc_id > 0 THEN 1 WHEN cell_id > 0 AND bar > 0 THEN 3 WHEN cell_id > 0 THEN 2 ELSE 0 END AS label FROM pixels")
def _(t):
    return P.compartment_label(t.pixels).select(*COLS, "label")


@query("soft_compartment_label", f"""WITH m AS ({MULTI}), v AS (SELECT {KEY}, any_value(cell_id) AS c, any_value(nuc_id) AS n, avg(CASE WHEN dab > 0.5 THEN 1.0 ELSE 0.0 END) AS votes FROM m GROUP BY ALL),
w AS (SELECT {KEY}, CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END AS a, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS b,
  CASE WHEN c > 0 AND n = 0 THEN 1 - votes ELSE 0.0 END AS e, CASE WHEN c > 0 AND n = 0 THEN votes ELSE 0.0 END AS f FROM v),
s AS (SELECT *, CASE WHEN a + b + e + f = 0 THEN 1 ELSE a + b + e + f END AS tot FROM w)
SELECT {KEY}, round(a / tot, 6) AS w_background, round(b / tot, 6) AS w_nucleus, round(e / tot, 6) AS w_cytoplasm, round(f / tot, 6) AS w_membrane FROM s""")
def _(t):
    return rounded(P.soft_compartment_label(t.pixels))


@query("class_balance", """WITH c AS (SELECT count(*) FILTER (WHERE dab > 0.15) AS n_pos, count(*) FILTER (WHERE NOT dab > 0.15) AS n_neg FROM stained)
SELECT n_pos, n_neg, round(CASE WHEN n_pos = 0 THEN 1.0 ELSE n_neg / CAST(n_pos AS DOUBLE) END, 6) AS pos_weight, round(n_pos / CAST(n_pos + n_neg AS DOUBLE), 6) AS pixel_fraction FROM c""")
def _(t):
    return rounded(P.class_balance(t.stained))


@query("membrane_fraction_index", """SELECT slide_id, tile_id, count(*) FILTER (WHERE nuc_id = 0 AND cell_id > 0 AND bar > 0) AS membrane_px, count(*) AS total_px,
round(count(*) FILTER (WHERE nuc_id = 0 AND cell_id > 0 AND bar > 0) / CAST(count(*) AS DOUBLE), 6) AS fraction FROM pixels GROUP BY ALL""")
def _(t):
    return rounded(P.membrane_fraction_index(P.compartment_label(t.pixels)))


@query("validate_tile_labels", """SELECT slide_id, tile_id, max(nuc_id) AS max_nucleus, max(cell_id) AS max_cell, count(nuc_id) AS n_nucleus_px, count(cell_id) AS n_cell_px
FROM pixels GROUP BY ALL HAVING max(nuc_id) > 0 AND max(cell_id) > 0 AND count(nuc_id) = 4096 AND count(cell_id) = 4096""")
def _(t):
    return P.validate_tile_labels(t.pixels, 64, 64)


def maps(t):
    one = F.explode(F.array(
        F.struct(F.lit("unet").alias("model"), F.col("prob").alias("p")),
        F.struct(F.lit("segformer").alias("model"), (1.0 - F.col("prob") * F.col("prob")).alias("p")),
        F.struct(F.lit("dab").alias("model"), F.least(F.col("dab"), F.lit(1.0)).alias("p"))))
    return t.stained.select(*COLS, one.alias("m")).select(*COLS, "m.*")


MAPS = f"""mp AS (SELECT {KEY}, 1 AS o, prob AS p FROM stained UNION ALL SELECT {KEY}, 2, 1 - prob * prob FROM stained UNION ALL SELECT {KEY}, 3, least(dab, 1.0) FROM stained)"""


@query("fuse_masks", f"""WITH {MAPS} SELECT {KEY}, avg(p) > 0.5 AS average, count(*) FILTER (WHERE p > 0.5) > 1.5 AS majority_vote, bool_and(p > 0.5) AS intersection,
arg_min(p > 0.5, o) AND arg_max(p > 0.5, o) AS best_plus_dab FROM mp GROUP BY ALL""")
def _(t):
    return P.fuse_masks(maps(t), ("average", "majority_vote", "intersection", "best_plus_dab"), ["unet", "segformer", "dab"])


@query("per_class_accuracy", "SELECT least(cell_id, 1) * 2 + least(nuc_id, 1) AS label, count(*) AS n_px, round(avg(CASE WHEN least(cell_id, 1) * 2 + least(nuc_id, 1) = least(pred_id, 1) * 2 + least(nuc_id, 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pixels GROUP BY 1")
def _(t):
    p = t.pixels.withColumns({"t": F.expr("least(cell_id, 1) * 2 + least(nuc_id, 1)"), "q": F.expr("least(pred_id, 1) * 2 + least(nuc_id, 1)")})
    return rounded(P.per_class_accuracy(p, "t", "q"))


PROFILE = f"""{GRAY}, k AS (SELECT s.slide_id, s.tile_id, count(*) AS n_px, count(*) FILTER (WHERE {BRIGHT} < threshold) AS tissue_px,
  count(*) FILTER (WHERE {BRIGHT} < threshold AND dab > 0.10) AS pos, avg(dab) FILTER (WHERE {BRIGHT} < threshold) AS m FROM stained s JOIN gt USING (slide_id, tile_id) GROUP BY ALL),
f AS (SELECT *, CASE WHEN tissue_px >= 100 THEN pos / CAST(tissue_px AS DOUBLE) ELSE 0 END AS pf, CASE WHEN tissue_px >= 100 THEN m ELSE 0 END AS mm FROM k),
profile AS (SELECT slide_id, tile_id, tissue_px, round(tissue_px / CAST(n_px AS DOUBLE), 6) AS tissue_fraction, round(pf, 6) AS dab_positive_fraction, round(mm, 6) AS mean_dab_in_tissue,
  CASE WHEN pf < 0.05 THEN 'Negative' WHEN pf < 0.15 THEN 'Low' WHEN pf < 0.30 THEN 'Moderate' ELSE 'High' END AS dab_level FROM f)"""


@query("tile_dab_profile", f"WITH {PROFILE} SELECT * FROM profile")
def _(t):
    return rounded(P.tile_dab_profile(t.stained))


@query("top_k_tiles", f"WITH {PROFILE} SELECT * FROM profile WHERE tissue_px >= 100 ORDER BY mean_dab_in_tissue DESC, tile_id LIMIT 20")
def _(t):
    from stainframe.operators.tiling import top_k_tiles
    return top_k_tiles(rounded(P.tile_dab_profile(t.stained)))


@query("tile_dab_mean", "SELECT slide_id, tile_id, round(avg(dab), 6) AS dab_mean FROM stained GROUP BY ALL")
def _(t):
    return rounded(P.tile_dab_mean(t.stained))
