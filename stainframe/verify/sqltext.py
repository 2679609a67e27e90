"""Pieces of SQL the twins share."""

from __future__ import annotations

from collections.abc import Sequence

KEY = "slide_id, tile_id, x, y"


def near(table: str, value: str, offsets: Sequence[tuple[int, int]], agg: str, out: str) -> str:
    """`out` = agg of `value` at the given offsets around every pixel of `table` (64 x 64 tiles)."""
    rows = ", ".join(f"({dx}, {dy})" for dx, dy in offsets)
    return (f"SELECT slide_id, tile_id, x, y, {agg}(v) AS {out} FROM (SELECT slide_id, tile_id, x - dx AS x, y - dy AS y, {value} AS v "
            f"FROM {table}, (VALUES {rows}) o(dx, dy)) s WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63 GROUP BY ALL")


def gather(table: str, offsets: str, fx: str, fy: str, out: str, join: str = "JOIN") -> str:
    """Pixels p with offset columns o, joined to the pixel q at (fx, fy); `out` is the select list."""
    return (f"SELECT p.slide_id, p.tile_id, p.x, p.y, {out} FROM (SELECT p.slide_id, p.tile_id, p.x, p.y, o.*, {fx} AS nx, {fy} AS ny "
            f"FROM {table} p, {offsets}) p {join} {table} q ON q.tile_id = p.tile_id AND q.x = p.nx AND q.y = p.ny GROUP BY ALL")


def box(table: str, value: str, agg: str, half: int, out: str, keep: str = "*") -> str:
    """`out` = agg of `value` in the square of the given half side; two window passes."""
    return (f"SELECT {keep}, {agg}(_r_{out}) OVER (PARTITION BY tile_id, x ORDER BY y RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS {out} "
            f"FROM (SELECT *, {agg}({value}) OVER (PARTITION BY tile_id, y ORDER BY x RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS _r_{out} FROM {table}) z")


def square(half: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-half, half + 1) for dy in range(-half, half + 1)]


def disc(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx, dy in square(r) if dx * dx + dy * dy <= r * r]


def ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets of the k x k elliptic kernel: row dy reaches round(r * sqrt(r^2 - dy^2) / r) both ways."""
    r = k // 2
    out = []
    for dy in range(-r, r + 1):
        w = round(((r * r - dy * dy) ** 0.5))
        out += [(dx, dy) for dx in range(-w, w + 1)]
    return out


def otsu(hist: str, keys: str) -> str:
    """Best bin of `hist` (keys, bin, n), null if one bin holds everything."""
    return f"""SELECT {keys}, arg_max(CASE WHEN v > 0 THEN bin END, CASE WHEN v > 0 THEN v END) AS bin FROM (
  SELECT {keys}, bin, CASE WHEN w > w0 THEN w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2) END AS v FROM (
    SELECT {keys}, bin, CAST(sum(n) OVER p AS DOUBLE) AS w0, CAST(sum(n * bin) OVER p AS DOUBLE) AS s0,
      CAST(sum(n) OVER (PARTITION BY {keys}) AS DOUBLE) AS w, CAST(sum(n * bin) OVER (PARTITION BY {keys}) AS DOUBLE) AS s
    FROM {hist} WINDOW p AS (PARTITION BY {keys} ORDER BY bin)) a) b GROUP BY {keys}"""


def uint8(value: str, top: str) -> str:
    return f"CAST(greatest(0, least(255, floor({value} * 255 / greatest({top}, 1e-6) + 1e-9))) AS BIGINT)"
