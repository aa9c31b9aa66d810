"""Corners of a region's outline.

A small region's outer border is followed as a closed chain of 8-connected steps, the chain is
reduced to the points where its direction turns, and these to a polygon that deviates from them by
at most two percent of the outline's length. Each region is a bounded list of pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# The eight steps, counterclockwise on the screen from the right; allowed deviation.
STEPS = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
DEVIATION = 0.02


def last_part(mask: np.ndarray) -> np.ndarray:
    """The 8-connected part of ``mask`` that begins last in raster order, among those not enclosed by
    another part. ``mask`` has an empty frame."""
    parts: list[np.ndarray] = []
    left = mask.copy()
    while left.any():
        part = _spread(left, np.unravel_index(left.argmax(), left.shape), STEPS)
        left &= ~part
        parts.append(part)
    for part in reversed(parts[1:]):
        others = mask & ~part
        if _spread(~others, (0, 0), STEPS[::2])[part].any():
            return part
    return parts[0]


def _spread(mask: np.ndarray, start: tuple[int, int], steps: list[tuple[int, int]]) -> np.ndarray:
    """What can be reached from ``start`` inside ``mask``."""
    reached = np.zeros_like(mask)
    reached[tuple(start)] = True
    while True:
        wide = np.pad(reached, 1)
        h, w = mask.shape
        grown = reached.copy()
        for dy, dx in steps:
            grown |= wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        grown &= mask
        if np.array_equal(grown, reached):
            return reached
        reached = grown


def turning_points(part: np.ndarray) -> np.ndarray:
    """Points (y, x) of the outer border of a part where its direction changes, counterclockwise on
    the screen from the first pixel. ``part`` has an empty frame."""
    start = tuple(int(c) for c in np.unravel_index(part.argmax(), part.shape))
    full = {(int(y), int(x)) for y, x in np.argwhere(part)}

    def step(p: tuple[int, int], d: int) -> tuple[int, int]:
        return p[0] + STEPS[d % 8][0], p[1] + STEPS[d % 8][1]

    # The border closes over the first neighbor met clockwise from the left.
    closing = next((d for d in range(4, -4, -1) if step(start, d) in full), None)
    if closing is None:
        return np.array([start])
    last, came, at, back = step(start, closing), (closing + 4) % 8, start, closing
    points = []
    while True:
        way = next(d % 8 for d in range(back + 1, back + 9) if step(at, d) in full)
        if way != came:
            points.append(at)
        following = step(at, way)
        if following == start and at == last:
            return np.array(points)
        at, came, back = following, way, (way + 4) % 8


def polygon_size(points: np.ndarray) -> int:
    """Number of corners of the simplified closed polygon through ``points``."""
    points = points.astype("int64")
    count = len(points)
    sides = np.roll(points, -1, axis=0) - points
    limit = (DEVIATION * float(np.sqrt((sides * sides).sum(axis=1).astype(float)).sum())) ** 2
    # Two points far apart: three times on to the farthest point from the last one.
    a = b = 0
    for _ in range(3):
        a = b
        gaps = ((np.roll(points, -a, axis=0) - points[a]) ** 2).sum(axis=1)
        hop = int(gaps.argmax())
        b = (a + hop) % count
    if gaps[hop] <= limit:
        return 1
    kept = _halves(points, a, b, limit) + _halves(points, b, a, limit)
    return _without_straight(points[kept], limit)


def _halves(points: np.ndarray, a: int, b: int, limit: float) -> list[int]:
    """Points kept on the way from ``a`` to ``b``, without ``b``: the way is split at its farthest
    point from the chord until no point is too far."""
    count, todo, kept = len(points), [(a, b)], []
    while todo:
        a, b = todo.pop()
        between = (a + 1 + np.arange((b - a) % count - 1)) % count if (b - a) % count > 1 else np.empty(0, int)
        if len(between):
            dy, dx = points[b] - points[a]
            off = np.abs((points[between, 0] - points[a, 0]) * dx - (points[between, 1] - points[a, 1]) * dy)
            far = int(off.argmax())
            if float(off[far]) ** 2 > limit * float(dx * dx + dy * dy):
                todo += [(int(between[far]), b), (a, int(between[far]))]
                continue
        kept.append(a)
    return kept


def _without_straight(corners: np.ndarray, limit: float) -> int:
    """Number of corners left when those on almost straight, slanted ways are taken out, one walk
    around. A corner after one taken out is passed over."""
    count = size = len(corners)
    ring = [tuple(map(int, c)) for c in corners]
    before, here = ring[-1], ring[0]
    write, read, i = 0, 1 % count, 0
    while i < count and size > 2:
        after = ring[read]
        read = (read + 1) % count
        dy, dx = after[0] - before[0], after[1] - before[1]
        off = abs((here[1] - before[1]) * dy - (here[0] - before[0]) * dx)
        ahead = (here[1] - before[1]) * (after[1] - here[1]) + (here[0] - before[0]) * (after[0] - here[0])
        if off * off <= 0.5 * limit * (dx * dx + dy * dy) and dx and dy and ahead >= 0:
            size -= 1
            ring[write] = before = after
            write = (write + 1) % count
            here = ring[read]
            read = (read + 1) % count
            i += 2
            continue
        ring[write] = before = here
        write = (write + 1) % count
        here = after
        i += 1
    return size


def corners_of(ys: np.ndarray, xs: np.ndarray) -> int:
    mask = np.zeros((np.ptp(ys) + 3, np.ptp(xs) + 3), bool)
    mask[ys - ys.min() + 1, xs - xs.min() + 1] = True
    return polygon_size(turning_points(last_part(mask)))


def corner_count(pixels: str) -> Column:
    """Corners of the region given by an array of (y, x)."""

    @F.pandas_udf("int")
    def count(ys: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([corners_of(np.asarray(y), np.asarray(x)) for y, x in zip(ys, xs)], dtype="int32")

    return count(F.col(f"{pixels}.y"), F.col(f"{pixels}.x"))
