"""Distances to the nearest set pixel: gaps along columns, then along each row the lowest of the parabolas that those
gaps raise, by some steps to either side and, where these do not settle a row, by their lower envelope, linear in the pixels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Stands for "no set pixel".
NONE = -1
#: Entries of one envelope table, so that memory does not follow the number of lines.
TABLE = 1 << 20
#: Steps to either side that are tried on whole tables before the envelope, which only rows still open then need.
NEAR = 64


def column_gaps(on: np.ndarray) -> np.ndarray:
    """Steps from each pixel to the nearest set one of its column; NONE in a column without any."""
    height, far = on.shape[0], 4 * on.shape[0] + 4
    y = np.arange(height)[:, None]
    above = np.maximum.accumulate(np.where(on, y, -far), axis=0)
    below = np.minimum.accumulate(np.where(on, y, far)[::-1], axis=0)[::-1]
    gap = np.minimum(y - above, below - y)
    return np.where(gap <= height, gap, NONE)


def nearest_in_rows(gap: np.ndarray, cap: int | None = None) -> np.ndarray:
    """`row_envelope`, by steps to either side of all pixels at once; beyond `cap` a value may be too large or NONE.

    After d steps a row whose values are all at most (d + 1)^2 is settled. Rows still open after NEAR steps go to the envelope.
    """
    far = np.iinfo("int64").max
    square = np.where(gap >= 0, gap.astype("int64") ** 2, far)
    least, width = square.copy(), gap.shape[1]
    rows = np.flatnonzero((gap >= 0).any(axis=1))
    last = width - 1 if cap is None else min(cap, width - 1)
    part, at = least[rows], square[rows]
    for d in range(1, min(last, NEAR) + 1):
        todo = part.max(axis=1) > d * d
        if not todo.all():
            least[rows] = part
            rows, part, at = rows[todo], part[todo], at[todo]
        if not rows.size:
            break
        # A pixel without a gap stays the largest number there is.
        moved = np.minimum(at, far - d * d) + d * d
        np.minimum(part[:, d:], moved[:, :-d], out=part[:, d:])
        np.minimum(part[:, :-d], moved[:, d:], out=part[:, :-d])
    least[rows] = part
    if last > NEAR and rows.size:
        least[rows] = row_envelope(gap[rows])
    return np.where(least == far, NONE, least)


def row_envelope(gap: np.ndarray) -> np.ndarray:
    """Least (x - u)^2 + gap[u]^2 over all u of the same row, in whole numbers; NONE in a row without any gap.

    Every row keeps a stack of the columns whose parabola is lowest somewhere, with the place where each
    starts to be. A column enters once and leaves at most once. All rows take each step together.
    """
    lines, width = gap.shape
    square = gap * gap
    site, start = np.zeros((lines, width), "int32"), np.zeros((lines, width), "int32")
    top = np.full(lines, -1)

    def height(rows: np.ndarray, at: np.ndarray | int, of: np.ndarray | int) -> np.ndarray:
        away = np.subtract(at, of, dtype="int64")
        return away * away + square[rows, of]

    for u in range(width):
        rows = np.flatnonzero(gap[:, u] >= 0)
        todo = rows[top[rows] >= 0]
        while todo.size:
            s, t = site[todo, top[todo]], start[todo, top[todo]]
            todo = todo[height(todo, t, s) > height(todo, t, u)]
            top[todo] -= 1
            todo = todo[top[todo] >= 0]
        bare = top[rows] < 0
        first, rest = rows[bare], rows[~bare]
        top[first], site[first, 0], start[first, 0] = 0, u, 0
        s = site[rest, top[rest]].astype("int64")
        begin = 1 + (u * u - s * s + square[rest, u] - square[rest, s]) // (2 * (u - s))
        inside = begin < width
        rest = rest[inside]
        top[rest] += 1
        site[rest, top[rest]], start[rest, top[rest]] = u, begin[inside]
    least = np.full((lines, width), NONE, "int64")
    some = np.flatnonzero(top >= 0)
    k = top[some]
    for x in range(width - 1, -1, -1):
        least[some, x] = height(some, x, site[some, k])
        k = k - (start[some, k] == x)
    return least


def nearest_along_rows(
    pixels: DataFrame, place: Sequence[str], line: Sequence[str], gaps: Mapping[str, str], strip: int = 32,
    cap: int | None = None,
) -> DataFrame:
    """`pixels` with a distance for each of `gaps` (its name -> the column of steps along y, null for none).

    A row of pixels is the unit: rows of one `place`, and in it of one `line` (several may cross the same
    pixel), are independent, so `strip` rows of a place are one group, whatever its height. Pixels already
    placed by `place` are not shuffled again. The gap columns go. Beyond `cap` a distance may be null; in a
    row without any gap it is. Columns of `pixels` travel as they are, nulls too.
    """
    place, line = list(place), list(line)
    part = "_strip"
    while part in pixels.columns:
        part = f"_{part}"
    kept = [f for f in pixels.schema.fields if f.name not in gaps.values()]
    schema = StructType([*kept, *[StructField(n, DoubleType()) for n in gaps]])
    stay = [f.name for f in kept]

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy().astype("int64") for c in ("x", "y"))
        if line:
            by = pd.DataFrame({"y": y, **{f"k{i}": table.column(c).to_pandas() for i, c in enumerate(line)}})
            code = by.groupby(list(by.columns), sort=False, dropna=False).ngroup().to_numpy()
        else:
            code = y - y.min()
        low = np.full(code.max() + 1, np.iinfo("int64").max)
        np.minimum.at(low, code, x)
        column = x - low[code]
        width = int(column.max()) + 1
        order = np.argsort(code, kind="stable")
        step = max(1, TABLE // width)
        cuts = np.searchsorted(code[order], np.arange(0, len(low) + step, step))
        out = table.select(stay)
        for name, source in gaps.items():
            gap = pc.fill_null(table.column(source).cast(pa.int64()), NONE).to_numpy()
            if cap is not None:
                gap = np.where(gap > cap, NONE, gap)
            found = np.empty(len(code), "int64")
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                rows = order[a:b]
                if not rows.size:
                    continue
                own = code[rows] - i * step
                block = np.full((int(own.max()) + 1, width), NONE, "int64")
                block[own, column[rows]] = gap[rows]
                found[rows] = nearest_in_rows(block, cap)[own, column[rows]]
            values = pa.array(np.sqrt(np.maximum(found, 0)), mask=found < 0)
            out = out.append_column(name, values)
        return out

    cast = pixels.withColumns({part: F.floor(F.col("y") / strip), **{c: F.col(c).cast(LongType()) for c in gaps.values()}})
    return cast.groupBy(*place, part).applyInArrow(run, schema)
