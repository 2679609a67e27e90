"""Cells, pixels and baselines derived from the given tables, in Spark SQL and in DuckDB SQL.

One text per view serves both engines; `{name}` marks a given table or an earlier view, and the few
places where the dialects differ are filled in by `Dialect`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from stainframe.functions.stain import inverse, with_dab

GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


#: Rasters of 64 x 64 that one task holds.
RASTERS_PER_TASK = 64


@dataclass(frozen=True)
class Dialect:
    name: str

    def num(self, text: str) -> str:
        return f"{text}D" if self.name == "spark" else f"CAST({text} AS DOUBLE)"

    def raster(self, table: str, cols: str, n: int) -> str:
        """`cols` of every row of `table`, once per (x, y) of an n x n raster."""
        if self.name == "spark":
            return (f"SELECT {cols}, x, y FROM {table} LATERAL VIEW explode(sequence(0, {n - 1})) a AS x "
                    f"LATERAL VIEW explode(sequence(0, {n - 1})) b AS y")
        return (f"SELECT {cols}, CAST(a.x AS INT) AS x, CAST(b.y AS INT) AS y "
                f"FROM {table}, range({n}) a(x), range({n}) b(y)")

    def ring(self, points: list[tuple[str, str]]) -> str:
        if self.name == "spark":
            inner = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in points)
            return f"array({inner})"
        return "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in points) + "]"

    def levels(self) -> str:
        rows = [(0, "1.0"), (1, "2.0"), (2, "4.0"), (3, "8.0")]
        if self.name == "spark":
            return "array(" + ", ".join(
                f"named_struct('level', {i}, 'downsample', {d}D)" for i, d in rows) + ")"
        return "[" + ", ".join(
            f"{{'level': {i}, 'downsample': CAST({d} AS DOUBLE)}}" for i, d in rows) + "]"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def _cells(d: Dialect) -> str:
    n = d.num
    return f"""
WITH u AS (
  SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk, MIN(l_quantity) AS q,
         MIN(l_extendedprice) AS ep, MIN(l_discount) AS disc, MIN(l_tax) AS tax,
         MIN(l_returnflag) AS rf, MIN(l_linestatus) AS ls
  FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber)
SELECT concat('S', lpad(CAST(sk % 20 AS STRING), 2, '0')) AS slide_id,
       l_orderkey * 8 + l_linenumber AS cell_id,
       CAST((pk * 37 + l_orderkey * 11) % 20000 AS DOUBLE) AS centroid_x,
       CAST((pk * 53 + l_orderkey * 29 + l_linenumber * 101) % 20000 AS DOUBLE) AS centroid_y,
       ls = 'O' AS is_center,
       CASE WHEN l_orderkey % 7 = 3 THEN NULL WHEN rf = 'A' THEN 'Patient_Tissue' WHEN rf = 'N' THEN 'iCAP_Control' ELSE 'Unknown' END AS region,
       q * {n('2.0')} AS area_um2, {n('0.85')} + tax * {n('2.5')} AS solidity,
       {n('5.0')} + l_linenumber * 2 AS max_diameter_um, {n('5.0')} + disc * {n('20.0')} AS min_diameter_um,
       CASE WHEN q = 1 THEN NULL ELSE ep * (5 + 2 * (sk % 20)) / {n('2500000.0')} END AS membrane_ring_dab,
       CASE WHEN q = 1 THEN NULL ELSE ep * 9 * (5 + 2 * (sk % 20)) / {n('25000000.0')} END AS raw_membrane_dab,
       CASE WHEN q = 1 THEN NULL ELSE disc * {n('10.0')} END AS membrane_completeness,
       CASE WHEN q = 1 THEN NULL ELSE {n('1.0')} + q * {n('0.4')} END AS membrane_thickness_px
FROM u"""


def _baseline(d: Dialect) -> str:
    n = d.num
    return f"""
SELECT slide_id AS slide_name, region, COUNT(*) AS total_cells,
       CAST(SUM(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
       CAST(SUM(CASE WHEN g = 1 THEN 1 ELSE 0 END) AS BIGINT) AS weak_1plus,
       CAST(SUM(CASE WHEN g = 2 THEN 1 ELSE 0 END) AS BIGINT) AS moderate_2plus,
       CAST(SUM(CASE WHEN g = 3 THEN 1 ELSE 0 END) AS BIGINT) AS strong_3plus,
       {n('100.0')} * SUM(CASE WHEN g >= 1 THEN 1 ELSE 0 END) / COUNT(*) AS pct_positive,
       {n('100.0')} * SUM(g) / COUNT(*) AS h_score,
       {n('0.1')} * SUM(g) / COUNT(*) AS mean_dab_od
FROM (SELECT concat('S', lpad(CAST(l_suppkey % 20 + 3 AS STRING), 2, '0')) AS slide_id,
             CASE l_returnflag WHEN 'A' THEN 'Patient_Tissue' WHEN 'N' THEN 'iCAP_Control' ELSE 'Unknown' END AS region,
             CASE WHEN l_quantity < 6 THEN 0 WHEN l_quantity < 9 + 6 * (l_suppkey % 2) THEN 1
                  WHEN l_quantity < 30 THEN 2 ELSE 3 END AS g
      FROM {{lineitem}}) z GROUP BY slide_id, region"""


def _pixels(d: Dialect) -> str:
    n = d.num
    nucleus = "(d1 <= 36 OR d2 <= 36)"
    stain = "(tile_id % 4 <> 3 AND ((d1 > 100 AND d1 < 144) OR (d2 > 100 AND d2 < 144)))"
    return f"""
SELECT concat('S', lpad(CAST(tile_id % 4 AS STRING), 2, '0')) AS slide_id, tile_id, x, y,
       CASE WHEN {nucleus} THEN 60 WHEN {stain} THEN 140 + CAST(tile_id % 5 AS INT) * 8 ELSE 200 END AS r,
       CASE WHEN {nucleus} THEN 40 WHEN {stain} THEN 100 + CAST(tile_id % 5 AS INT) * 8
            WHEN tile_id % 4 = 3 THEN 205 ELSE 180 END AS g,
       CASE WHEN {nucleus} THEN 80 WHEN {stain} THEN 60 + CAST(tile_id % 5 AS INT) * 8
            WHEN tile_id % 4 = 3 THEN 245 ELSE 220 END AS b,
       CASE WHEN d1 <= 36 THEN 1 WHEN d2 <= 36 THEN 2 ELSE 0 END AS nuc_id,
       CASE WHEN d1 <= 144 THEN 1 WHEN d2 <= 144 THEN 2 ELSE 0 END AS cell_id,
       CASE WHEN e1 <= 121 THEN 1 WHEN e2 <= 121 THEN 2 ELSE 0 END AS pred_id,
       CAST((x * 7 + y * 3 + tile_id) % 11 - 5 AS DOUBLE) / {n('100.0')}
         + CASE WHEN {stain} THEN {n('0.05')} ELSE {n('0.0')} END AS bar,
       CAST((x * 5 + y * 11 + tile_id) % 100 AS DOUBLE) / {n('100.0')} AS prob
FROM (SELECT k AS tile_id, x, y,
             (x-20-k%4)*(x-20-k%4) + (y-20)*(y-20) AS d1,
             (x-44)*(x-44) + (y-42-k%3)*(y-42-k%3) AS d2,
             (x-21-k%4-k%3)*(x-21-k%4-k%3) + (y-20)*(y-20) AS e1,
             (x-44)*(x-44) + (y-40-k%3)*(y-40-k%3) AS e2
      FROM ({d.raster('{supplier}', 's_suppkey AS k', 64)}) t) p"""


def _stained(d: Dialect) -> str:
    """Pixels with `dab`; the DataFrame side uses the library's own stain separation instead."""
    inv = inverse()
    od = [f"-ln(greatest(1, least(255, {c})) / CAST(255 AS DOUBLE))" for c in "rgb"]
    dab = " + ".join(f"({o}) * CAST('{float(inv[i, 1])!r}' AS DOUBLE)" for i, o in enumerate(od))
    return f"SELECT *, greatest(CAST(0 AS DOUBLE), {dab}) AS dab FROM {{pixels}}"


def _slides(d: Dialect) -> str:
    n = d.num
    return f"""
SELECT slide_id, CASE WHEN i % 2 = 0 THEN {n('0.25')} ELSE {n('0.23')} END AS base_mpp,
       CAST(3000 + (i % 3) * 500 AS BIGINT) AS width, CAST(3000 + (i % 2) * 700 AS BIGINT) AS height, {d.levels()} AS levels
FROM (SELECT DISTINCT s_suppkey AS i, concat('S', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS slide_id
      FROM {{supplier}}) s"""


def _regions(d: Dialect) -> str:
    """Three polygons for every slide with cells; the first two overlap."""
    n = d.num

    def at(x: float, y: float) -> tuple[str, str]:
        return f"{n(str(x))} + k * {n('10.0')}", f"{n(str(y))} + k * {n('5.0')}"

    shapes = [
        ("Patient_Tissue", [(500.5, 500.5), (9000.5, 800.5), (11000.5, 9500.5), (700.5, 8000.5)]),
        ("iCAP_Control", [(6000.5, 4000.5), (15000.5, 5000.5), (12000.5, 15000.5), (9000.5, 9000.5), (5000.5, 14000.5)]),
        ("Unknown", [(12500.5, 12500.5), (19000.5, 12000.5), (18000.5, 19000.5)]),
    ]
    selects = [
        f"SELECT slide_id, {i} AS ord, '{name}' AS name, {d.ring([at(*p) for p in pts])} AS ring FROM s"
        for i, (name, pts) in enumerate(shapes)
    ]
    return (f"""
WITH s AS (SELECT DISTINCT concat('S', lpad(CAST(s_suppkey % 20 AS STRING), 2, '0')) AS slide_id,
                  s_suppkey % 20 AS k FROM {{supplier}})
""" + " UNION ALL ".join(selects))


def _polygons(d: Dialect) -> str:
    """A hexagon for every cell on a 500 x 500 plane per slide; no vertex or edge meets a pixel centre."""
    n = d.num
    pts = [("1.0", "0.0"), ("0.5", "1.0"), ("-0.5", "1.0"), ("-1.0", "0.0"), ("-0.5", "-1.0"), ("0.5", "-1.0")]
    ring = d.ring([(f"px + r * {n(a)}", f"py + r * {n(b)}") for a, b in pts])
    return f"""
SELECT slide_id, cell_id, {ring} AS ring
FROM (SELECT slide_id, cell_id, floor(centroid_x / 40) + {n('0.3')} AS px, floor(centroid_y / 40) + {n('0.2')} AS py,
             {n('2.0')} + CAST(cell_id % 3 AS DOUBLE) AS r FROM {{cells}}) c"""


VIEWS = {
    "cells": _cells,
    "graded": lambda d: """
SELECT *, CASE WHEN membrane_ring_dab IS NULL OR membrane_ring_dab < 0.10 THEN 0 WHEN membrane_ring_dab < 0.20 THEN 1
               WHEN membrane_ring_dab < 0.35 THEN 2 ELSE 3 END AS grade FROM {cells}""",
    "baseline": _baseline,
    "pixels": _pixels,
    "slides": _slides,
    "regions": _regions,
    "polygons": _polygons,
    "tiles": lambda d: """
SELECT DISTINCT slide_id, CAST(floor(centroid_x / 704) AS BIGINT) AS tile_x, CAST(floor(centroid_y / 704) AS BIGINT) AS tile_y,
       concat(slide_id, '/', CAST(CAST(floor(centroid_x / 704) AS BIGINT) AS STRING), '_',
              CAST(CAST(floor(centroid_y / 704) AS BIGINT) AS STRING)) AS tile_key FROM {cells}""",
    "tile_grades": lambda d: f"""
SELECT slide_id, tile_x, tile_y, COUNT(*) AS n_cells, {d.num('1.0')} * SUM(grade) / COUNT(*) AS mean_grade,
       CAST(SUM(CASE WHEN grade = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0, CAST(SUM(CASE WHEN grade = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
       CAST(SUM(CASE WHEN grade = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n2, CAST(SUM(CASE WHEN grade = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n3
FROM (SELECT slide_id, CAST(floor(centroid_x / 704) AS BIGINT) AS tile_x, CAST(floor(centroid_y / 704) AS BIGINT) AS tile_y, grade
      FROM {{graded}}) g GROUP BY slide_id, tile_x, tile_y""",
    "manifest": lambda d: f"""
SELECT tile_key, CASE WHEN tile_x % 3 = 0 THEN 'h1' ELSE 'h0' END AS config_hash,
       CASE WHEN tile_y % 2 = 0 THEN CAST(tile_x + tile_y AS DOUBLE) END AS num_cells
FROM {{tiles}} WHERE tile_x % 3 < 2""",
    "repeats": lambda d: f"""
SELECT user_id % 300 AS tile, event_id % 3 AS rep, COUNT(*) AS n_cells, {d.num('3.0')} * avg(value) AS h_score,
       {d.num('100.0')} * SUM(CASE WHEN value > 20 THEN 1 ELSE 0 END) / COUNT(*) AS pct_positive,
       {d.num('100.0')} * SUM(CASE WHEN value > 60 THEN 1 ELSE 0 END) / COUNT(*) AS pct_3plus
FROM {{events}} GROUP BY user_id % 300, event_id % 3""",
    "stained": _stained,
    "labels_long": lambda d: """
SELECT slide_id, tile_id, x, y, 'A' AS model, cell_id AS inst_id FROM {pixels}
UNION ALL SELECT slide_id, tile_id, x, y, 'B' AS model, pred_id AS inst_id FROM {pixels}
UNION ALL SELECT slide_id, tile_id, x, y, 'C' AS model, nuc_id AS inst_id FROM {pixels}""",
    "tile_embeddings": lambda d: f"""
SELECT vec_id AS tile_id, concat('S', lpad(CAST(vec_id % 8 AS STRING), 2, '0')) AS slide_id, embedding,
       CAST(vec_id % 50 AS DOUBLE) / {d.num('100.0')} AS dab_mean FROM {{embeddings}}""",
    "tile_scores": lambda d: " UNION ALL ".join(
        f"SELECT vec_id AS tile_id, '{m}' AS model, CASE WHEN vec_id % {k} = 0 THEN NULL "
        f"ELSE CAST((vec_id * {p}) % 100 AS DOUBLE) / {d.num('100.0')} END AS score FROM {{embeddings}}"
        for m, k, p in (("conch", 7, 13), ("musk", 11, 29), ("uni", 5, 31), ("virchow", 13, 57))),
    "thumbs": lambda d: f"""
SELECT slide_id, x AS tx, y AS ty, (x * x + y * 7 + i) % 10 < 4 AND x + y > 6 AS tissue
FROM ({d.raster("(SELECT DISTINCT s_suppkey AS i, concat('S', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS slide_id FROM {supplier}) s", "i, slide_id", 62)}) t
WHERE x < floor((3000 + (i % 3) * 500) / 64) AND y < floor((3000 + (i % 2) * 700) / 64)""",
    "items": lambda d: """
SELECT p_partkey AS item_id, concat('S', lpad(CAST(p_partkey % 37 AS STRING), 2, '0')) AS slide_id,
       concat('tiles/S', lpad(CAST(p_partkey % 37 AS STRING), 2, '0'), '/', CAST(p_partkey * 352 AS STRING), '_',
              CAST(p_size * 352 AS STRING), '.png') AS image, p_size, p_retailprice, p_brand FROM {part}""",
}


def _needs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


# Added before rounding on both sides: decimal ties would otherwise fall to either side.
NUDGE = 1.2345e-10


def _nudge_rounds(text: str) -> str:
    """Every `round(x, 6)` as `round((x) + NUDGE, 6)`, as `registry.rounded` does."""
    out, i = "", 0
    while (j := text.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        inner = text[j + 6:k - 1]
        out += text[i:j]
        if inner.endswith(", 6"):
            out += f"round(({_nudge_rounds(inner[:-3])}) + {NUDGE}, 6)"
        else:
            out += f"round({_nudge_rounds(inner)})"
        i = k
    return out + text[i:]


def duck_sql(body: str) -> str:
    """`body` with the views it names put in front as common table expressions."""
    body = _nudge_rounds(body)
    found: list[str] = []

    def visit(name: str) -> None:
        if name in GIVEN or name in found:
            return
        for dep in _needs(VIEWS[name](DUCK)):
            visit(dep)
        found.append(name)

    for word in re.findall(r"\b\w+\b", body):
        if word in VIEWS:
            visit(word)
    ctes = []
    for name in found:
        text = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name](DUCK))
        ctes.append(f"{name} AS ({text})")
    body = body.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s", body):
        return "WITH " + ", ".join(ctes) + ", " + body[4:].lstrip()
    return "WITH " + ", ".join(ctes) + " " + body


class Tables:
    """The given tables and the derived views of one data folder, as DataFrames."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self._cache = spark, path.rstrip("/"), {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def _build(self, name: str):
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        if name == "stained":
            return with_dab(self.pixels)
        text = VIEWS[name](SPARK)
        args = {dep: getattr(self, dep) for dep in _needs(text)}
        if name in ("pixels", "thumbs"):
            # One small shuffle of the tile or slide list; the rasters then stay where it put them. The number
            # is given, or Spark would merge the short list into one task before it grows to pixels. It follows the list,
            # or a task's pixels, and the memory that sorts of them take, would grow with the input.
            n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism,
                    -(-args["supplier"].count() // RASTERS_PER_TASK))
            args["supplier"] = args["supplier"].select("s_suppkey").repartition(n, "s_suppkey")
        return self.spark.sql(text, **args)
