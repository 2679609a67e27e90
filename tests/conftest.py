import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stainframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


def disc_tile(n=64):
    """Two round cells with a stained ring; numpy rasters by name."""
    y, x = np.mgrid[:n, :n]
    d1, d2 = (x - 20) ** 2 + (y - 20) ** 2, (x - 44) ** 2 + (y - 42) ** 2
    nuc = np.where(d1 <= 36, 1, np.where(d2 <= 30, 2, 0))
    cell = np.where(d1 <= 144, 1, np.where(d2 <= 121, 2, 0))
    ring = ((d1 > 100) & (d1 < 144)) | ((d2 > 81) & (d2 < 121))
    dab = np.where(ring, 0.5 + 0.01 * ((x * 3 + y) % 7), np.where(nuc > 0, 0.2, 0.05 + 0.001 * ((x + 2 * y) % 5)))
    bar = np.where(ring, 0.05, -0.02) + 0.001 * ((x * 7 + y * 3) % 11)
    return {"nuc_id": nuc, "cell_id": cell, "dab": dab, "bar": bar}


def tile_rows(spark, rasters, tile=1, slide="S01"):
    n, m = next(iter(rasters.values())).shape
    names = list(rasters)
    rows = [
        (slide, tile, xx, yy, *[rasters[k][yy, xx].item() for k in names]) for yy in range(n) for xx in range(m)
    ]
    types = {"i": "int", "f": "double", "b": "boolean"}
    schema = "slide_id string, tile_id bigint, x int, y int, " + ", ".join(
        f"{k} {types[rasters[k].dtype.kind]}" for k in names)
    return spark.createDataFrame(rows, schema)


def to_raster(df, column, shape=(64, 64)):
    out = np.zeros(shape)
    for r in df.select("x", "y", column).collect():
        out[r["y"], r["x"]] = np.nan if r[column] is None else float(r[column])
    return out


@pytest.fixture(scope="session")
def rasters():
    return disc_tile()


@pytest.fixture(scope="session")
def tile(spark, rasters):
    return tile_rows(spark, rasters).cache()
