"""Grid and embedding queries and their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stainframe.operators import embeddings as E
from stainframe.operators import grids as D
from stainframe.operators import tile_filters as TF
from stainframe.operators.rasters import gaussian_weights
from stainframe.verify.registry import query, rounded
from stainframe.verify.sqltext import disc

SCALE, SIDE = 0.005, 100


def rows(offsets) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b})" for a, b in offsets) + ")"


def scattered(value: str, source: str) -> str:
    return f"""SELECT slide_id, gx + dx AS gx, gy + dy AS gy, CASE WHEN count(v) > 0 THEN sum(v) / CAST(count(v) AS DOUBLE) ELSE 0 END AS v, count(v) AS n
FROM (SELECT slide_id, CAST(floor(centroid_x * CAST(0.005 AS DOUBLE)) AS BIGINT) AS gx, CAST(floor(centroid_y * CAST(0.005 AS DOUBLE)) AS BIGINT) AS gy, {value} AS v FROM {source}) c, {rows(disc(4))} o(dx, dy)
WHERE gx BETWEEN 4 AND 95 AND gy BETWEEN 4 AND 95 GROUP BY ALL"""


def scatter(t):
    return D.scatter_to_grid(t.cells, "membrane_ring_dab", SCALE, SIDE, SIDE)


GRID = f"grid AS ({scattered('membrane_ring_dab', 'cells')})"


@query("scatter_to_grid", f"WITH {GRID} SELECT slide_id, gx, gy, round(v, 6) AS v, n FROM grid")
def _(t):
    return rounded(scatter(t))


NORM = f"""{GRID}, gq AS (SELECT slide_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM grid WHERE n > 0 GROUP BY slide_id),
norm AS (SELECT slide_id, gx, gy, n, greatest(0, least(1.0, (v - lo) / CASE WHEN hi - lo < 1e-8 THEN 1.0 ELSE hi - lo END)) AS v FROM grid JOIN gq USING (slide_id))"""


@query("grid_normalise", f"WITH {NORM} SELECT slide_id, gx, gy, round(v, 6) AS v, n FROM norm")
def _(t):
    return rounded(D.grid_normalise(scatter(t)))


def filled(source: str, value: str) -> str:
    step = lambda src, axis, other: (f"SELECT slide_id, {axis} + d AS {axis}, {other}, max({value}) AS {value} FROM {src}, (SELECT unnest(range(-5, 7)) AS d) k "  # noqa: E731
                                     f"WHERE {axis} + d BETWEEN 0 AND 99 GROUP BY ALL")
    return step(f"({step(source, 'gx', 'gy')}) fx", "gy", "gx")


def taps(sigma: float) -> str:
    w = gaussian_weights(sigma)
    return "(VALUES " + ", ".join(f"({i - len(w) // 2}, CAST('{float(x)!r}' AS DOUBLE))" for i, x in enumerate(w)) + ")"


def smoothed(source: str, sigma: float = 3.0) -> str:
    mir = lambda c: f"(CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 99 THEN 199 - ({c}) ELSE {c} END)"
    step = lambda src, axis, other: f"SELECT slide_id, {mir(axis + ' + d')} AS {axis}, {other}, sum(v * w) AS v FROM {src}, {taps(sigma)} k(d, w) GROUP BY ALL"
    return step(f"({step(source, 'gx', 'gy')}) sx", "gy", "gx")


TISSUE = "tissue AS (SELECT DISTINCT slide_id, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy FROM grid WHERE (gx * 3 + gy) % 5 > 0)"


def tissue(t):
    return scatter(t).filter("(gx * 3 + gy) % 5 > 0").select("slide_id", "gx", "gy")


@query("grid_gap_fill_smooth", f"WITH {NORM}, {TISSUE}, f AS ({filled('norm', 'v')}), s AS ({smoothed('f')}) SELECT slide_id, gx, gy, round(v, 6) AS v FROM s SEMI JOIN tissue USING (slide_id, gx, gy)")
def _(t):
    return rounded(D.grid_gap_fill_smooth(D.grid_normalise(scatter(t)), tissue(t), SIDE, SIDE))


@query("grid_grade", f"WITH {GRID}, {TISSUE}, gr AS ({scattered('grade', 'graded')}), f AS ({filled('gr', 'v')}), s AS ({smoothed('f')}), a AS ({filled('gr', 'n')}) "
       "SELECT slide_id, gx, gy, CAST(greatest(0, least(3, round_even(floor(v * 1000000 + 0.5) / 1000000, 0))) AS INT) AS grade FROM s SEMI JOIN (SELECT * FROM a WHERE n > 0) q USING (slide_id, gx, gy) SEMI JOIN tissue USING (slide_id, gx, gy)")
def _(t):
    return D.grid_grade(t.graded, tissue(t), SCALE, SIDE, SIDE)


SPOTS = f"""spots AS (SELECT DISTINCT slide_id, CAST(trunc(centroid_x * CAST(0.005 AS DOUBLE)) AS BIGINT) AS gx, CAST(trunc(centroid_y * CAST(0.005 AS DOUBLE)) AS BIGINT) AS gy FROM cells),
ones AS (SELECT DISTINCT slide_id, gx + dx AS gx, gy + dy AS gy, CAST(1 AS DOUBLE) AS v FROM spots, {rows(disc(1))} o(dx, dy)
  WHERE gx BETWEEN 0 AND 99 AND gy BETWEEN 0 AND 99 AND gx + dx BETWEEN 0 AND 99 AND gy + dy BETWEEN 0 AND 99)"""


@query("density_map", f"""WITH {GRID}, {TISSUE}, {SPOTS}, d1 AS ({smoothed('ones')}), d2 AS ({filled('d1', 'v')}), d3 AS ({smoothed('d2', 1.5)}),
d4 AS (SELECT d3.* FROM d3 SEMI JOIN tissue USING (slide_id, gx, gy)),
dq AS (SELECT slide_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM d4 WHERE v > 0.005 GROUP BY slide_id),
d5 AS (SELECT slide_id, gx, gy, CASE WHEN hi - lo > 1e-9 THEN greatest(0, least(1.0, (v - lo) / (hi - lo))) ELSE v END AS v FROM d4 LEFT JOIN dq USING (slide_id))
SELECT slide_id, gx, gy, round(v, 6) AS v, round(v, 9) >= 0.005 AS shown FROM d5""")
def _(t):
    return rounded(D.density_map(t.cells, tissue(t), SCALE, SIDE, SIDE, radius=1))


@query("grid_last_writer", f"""SELECT slide_id, gx + dx AS gx, gy + dy AS gy, arg_max(grade, cell_id) AS v
FROM (SELECT slide_id, cell_id, grade, CAST(floor(centroid_x * CAST(0.005 AS DOUBLE)) AS BIGINT) AS gx, CAST(floor(centroid_y * CAST(0.005 AS DOUBLE)) AS BIGINT) AS gy FROM graded) c, {rows(disc(3))} o(dx, dy)
WHERE gx + dx BETWEEN 0 AND 99 AND gy + dy BETWEEN 0 AND 99 GROUP BY ALL""")
def _(t):
    return D.grid_last_writer(t.graded, "grade", "cell_id", SCALE, SIDE, SIDE)


@query("cell_value_normalise", """WITH q AS (SELECT slide_id, quantile_cont(membrane_ring_dab, 0.02) AS lo, quantile_cont(membrane_ring_dab, 0.98) AS hi FROM cells GROUP BY slide_id)
SELECT slide_id, cell_id, round(greatest(0, least(1.0, (membrane_ring_dab - lo) / (CASE WHEN hi <= lo THEN lo + 0.01 ELSE hi END - lo))), 6) AS normalised FROM cells JOIN q USING (slide_id) WHERE membrane_ring_dab IS NOT NULL""")
def _(t):
    return rounded(D.cell_value_normalise(t.cells, "membrane_ring_dab").select("slide_id", "cell_id", "normalised"))


# Fixed directions in place of text prompts and cluster centres.
DIRECTIONS = [[math.cos((k + 1) * i) for i in range(64)] for k in range(4)]


def _unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def arr(v) -> str:
    return "[" + ", ".join(f"CAST('{float(x)!r}' AS DOUBLE)" for x in v) + "]"


UNITS = """u AS (SELECT tile_id, slide_id, dab_mean, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-8)) AS v
  FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM tile_embeddings) s)"""


@query("l2_normalise", f"WITH {UNITS} SELECT tile_id, list_transform(v, lambda x: round((x) + 1e-9, 5)) AS unit FROM u")
def _(t):
    # A negative value that rounds to zero keeps its sign in DuckDB; Spark's round drops it.
    near = lambda v: F.when(F.round(v, 5) == 0, F.signum(v) * 0.0).otherwise(F.round(v, 5))
    return E.l2_normalise(t.tile_embeddings).select("tile_id", F.transform("unit", lambda x: near(x + 1e-9)).alias("unit"))


@query("soft_cluster_score", f"""WITH {UNITS}, d AS (SELECT tile_id, list_distance(v, {arr(_unit(DIRECTIONS[0]))}) AS a, list_distance(v, {arr(_unit(DIRECTIONS[1]))}) AS b FROM u)
SELECT tile_id, round(b / (a + b + 1e-8), 6) AS score FROM d""")
def _(t):
    from stainframe.functions.vectors import literal
    unit = E.l2_normalise(t.tile_embeddings)
    return rounded(unit.select("tile_id", E.soft_cluster_score(
        F.col("unit"), literal(_unit(DIRECTIONS[0])), literal(_unit(DIRECTIONS[1]))).alias("score")))


@query("kmeans_epithelial")
def _(t):
    return rounded(E.kmeans_epithelial(t.tile_embeddings).select("tile_id", "epithelial", "score"))


SIMS = f"""{UNITS}, sims AS (SELECT tile_id, """ + ", ".join(f"list_dot_product(v, {arr(_unit(d))}) AS s{i}" for i, d in enumerate(DIRECTIONS)) + " FROM u)"


@query("zero_shot_binary", f"WITH {SIMS} SELECT tile_id, round(exp(s0) / (exp(s0) + exp(s1)), 6) AS p_positive FROM sims")
def _(t):
    return rounded(E.zero_shot_binary(t.tile_embeddings, DIRECTIONS[0], DIRECTIONS[1]).select("tile_id", "p_positive"))


@query("zero_shot_staining", f"""WITH {SIMS} SELECT tile_id, round(greatest(0, least(1, (0.33 * exp(s1 / 0.07) + 0.67 * exp(s2 / 0.07) + exp(s3 / 0.07)) / (exp(s0 / 0.07) + exp(s1 / 0.07) + exp(s2 / 0.07) + exp(s3 / 0.07)))), 6) AS staining FROM sims""")
def _(t):
    return rounded(E.zero_shot_staining(t.tile_embeddings, DIRECTIONS).select("tile_id", "staining"))


@query("consensus_score", "SELECT tile_id, round(avg(score), 6) AS consensus_score, count(score) AS n_models FROM tile_scores GROUP BY tile_id")
def _(t):
    return rounded(E.consensus_score(t.tile_scores))


KNOWN = ("conch", "musk", "uni", "virchow", "phikon")


@query("model_score_summary", f"""WITH k(model) AS (VALUES {', '.join(f"('{m}')" for m in KNOWN)})
SELECT model, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS median, count(score) = 0 AS skipped
FROM k LEFT JOIN tile_scores USING (model) GROUP BY model""")
def _(t):
    return rounded(E.model_score_summary(t.tile_scores, KNOWN))


@query("sink_tile_scores", """SELECT tile_id, round(max(score) FILTER (WHERE model = 'conch'), 6) AS conch, round(max(score) FILTER (WHERE model = 'musk'), 6) AS musk, round(max(score) FILTER (WHERE model = 'uni'), 6) AS uni,
round(max(score) FILTER (WHERE model = 'virchow'), 6) AS virchow, round(max(score) FILTER (WHERE model = 'phikon'), 6) AS phikon, round(avg(score), 6) AS consensus_score FROM tile_scores GROUP BY tile_id""")
def _(t):
    from stainframe.sources.sinks import tile_score_rows, write_tile_scores
    from stainframe.verify.source_queries import scratch
    rows, path = rounded(tile_score_rows(t.tile_scores, KNOWN)), scratch(t.spark, "scores")
    write_tile_scores(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("filter_epithelial_cluster")
def _(t):
    part = F.element_at(F.array(*[F.lit(s) for s in E.SPLITS]), F.pmod("tile_id", F.lit(3)).cast("int") + 1)
    clusters = E.kmeans_epithelial_by_split(t.tile_embeddings.withColumn("split", part)).select("tile_id", "epithelial")
    tiles = t.pixels.select("slide_id", "tile_id").distinct()
    return rounded(TF.filter_epithelial_cluster(t.stained, tiles.join(clusters, "tile_id"))[1])
