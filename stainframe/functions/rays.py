"""Rays from cell centres over the pixels of a block, as numpy: which pixels lie in the band of a ray's peak.

Pixels come as rows, in any order; some may be missing and some may come more than once. A place is y * width + x in
the frame of the block, which is one pixel wider than any ray goes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Rank of a place without a pixel, below all that `ranked` gives.
NONE = np.iinfo("int64").min
#: Cells whose rays are walked at a time, so that memory does not follow the cells of a block.
CELLS_AT_ONCE = 256


def ranked(values: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Whole numbers that sort as Spark sorts doubles: null, numbers, NaN."""
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view("int64")
    return np.where(null, NONE + 1, np.where(bits < 0, bits ^ np.iinfo("int64").max, bits))


def clipped(v: np.ndarray, size: int) -> np.ndarray:
    """The pixel of a coordinate, kept on the raster; the last one if there is no coordinate."""
    return np.fmax(0.0, np.fmin(size - 1.0, v)).astype("int64")


@dataclass
class Places:
    """Owners place by place: those of a place start at `first` and are `count`; `row` is where each pixel's own one is."""

    own: np.ndarray
    first: np.ndarray
    count: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, place: np.ndarray, own: np.ndarray, size: int) -> Places:
        count, row = np.bincount(place, minlength=size), np.arange(len(place))
        if count.max(initial=0) <= 1:
            first = np.zeros(size, "int64")
            first[place] = row
            return cls(own, first, count, row)
        # Some come more than once: the different owners of each place.
        order = np.lexsort((own, place))
        p, o = place[order], own[order]
        new = np.append(True, (p[1:] != p[:-1]) | (o[1:] != o[:-1]))
        row[order] = np.cumsum(new) - 1
        count = np.bincount(p[new], minlength=size)
        return cls(o[new], np.cumsum(count) - count, count, row)

    def owned(self, place: np.ndarray, by: np.ndarray):
        """For each round, which of `place` have `by` among their owners, and where that owner is."""
        count = self.count[place]
        for k in range(count.max(initial=0)):
            at = np.minimum(self.first[place] + k, len(self.own) - 1)
            yield (k < count) & (self.own[at] == by), at


@dataclass(frozen=True)
class Band:
    """How rays are walked and what of them is the band; see `profiles.ring_adaptive`."""

    extent: tuple[int, int]
    rays: int
    outer: tuple[int, int]
    band: int
    min_reach: int
    max_dist: int

    def marked(self, places: Places, rank: np.ndarray, frame: tuple[int, int, int], ids, cx, cy) -> tuple[np.ndarray, np.ndarray]:
        """Places along each ray of cells `ids`, and which of them lie in the cell and in the band. `frame`: x0, y0, width."""
        angles = [2 * math.pi * i / self.rays for i in range(self.rays)]
        i = np.arange(self.max_dist)
        x, y = (clipped(c[:, None, None] + np.array([[turn(a)] for a in angles]) * (i + 1.0), size)
                for c, turn, size in ((cx, math.cos, self.extent[0]), (cy, math.sin, self.extent[1])))
        place = (y - frame[1]) * frame[2] + (x - frame[0])
        inside = np.zeros(place.shape, bool)
        for hit, _ in places.owned(place, ids[:, None, None]):
            inside |= hit
        end = (inside * (i + 1)).max(axis=2, keepdims=True)
        start = np.floor(end * self.outer[0] / self.outer[1])
        value = rank[place]
        searched = (value > NONE) & (end >= self.min_reach) & (i >= start) & (i < end)
        peak = np.where(searched, value, NONE).argmax(axis=2)[:, :, None]
        return place, inside & searched.any(axis=2, keepdims=True) & (np.abs(i - peak) <= self.band)

    def rings(self, place, own, rank, frame: tuple[int, int, int, int], ids, cx, cy) -> tuple[np.ndarray, np.ndarray]:
        """Which pixels lie on the ring of their cell, one of `ids`, and how many rays each of these has in its band.

        Pixels are `place`, owner `own` and `rank` of the value; `frame` is x0, y0, width and height of the block.
        """
        x0, y0, width, height = frame
        places = Places.of(place, own, width * height)
        best = np.full(width * height, NONE)
        np.maximum.at(best, place, rank)
        around = np.array([b * width + a for a in (-1, 0, 1) for b in (-1, 0, 1)])
        on, n_rays = np.zeros(len(places.own), bool), np.zeros(len(ids), "int64")
        for k in range(0, len(ids), CELLS_AT_ONCE):
            some = slice(k, k + CELLS_AT_ONCE)
            walk, marked = self.marked(places, best, (x0, y0, width), ids[some], cx[some], cy[some])
            n_rays[some] = marked.any(axis=2).sum(axis=1)
            which = marked.nonzero()
            near = (walk[which][:, None] + around).ravel()
            for hit, at in places.owned(near, np.repeat(ids[some][which[0]], len(around))):
                on[at[hit]] = True
        return on[places.row], n_rays
