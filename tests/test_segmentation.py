"""Ball fills, merging and outlines against plain walks over random drawings."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flatcel.operators import outlines as OL
from flatcel.operators import regions as R
from flatcel.operators import segmentation as SG
from flatcel.operators import tiles as TI
from flatcel.operators.tile_forest import TileForest


def images(spark, drawings, column="v"):
    rows = [(i, y, x, int(v)) for i, d in enumerate(drawings) for y, row in enumerate(d) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {column} int")


def arrays(df, drawings, column="label"):
    out = [np.zeros(d.shape, int) for d in drawings]
    for r in df.select("image_id", "y", "x", column).collect():
        out[r.image_id][r.y, r.x] = r[column]
    return out


def ball_by_hand(radius):
    return [
        (dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)
        if abs(dx) <= round(math.sqrt(radius * radius - dy * dy))
    ]


def flood(mask, start):
    h, w = mask.shape
    seen, todo = {start}, [start]
    while todo:
        y, x = todo.pop()
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if p not in seen and 0 <= p[0] < h and 0 <= p[1] < w and mask[p]:
                seen.add(p)
                todo.append(p)
    return seen


def walk_balls(drawing, radius):
    """One fill after the other, the core worked out anew each time."""
    free, label, h, w = drawing == 255, np.zeros(drawing.shape, int), *drawing.shape
    offsets, n = ball_by_hand(radius), 0

    def around(y, x):
        return [(y + dy, x + dx) for dy, dx in offsets if 0 <= y + dy < h and 0 <= x + dx < w]

    while True:
        core = np.array([[all(free[p] for p in around(y, x)) for x in range(w)] for y in range(h)])
        if not core.any():
            return label
        n += 1
        start = tuple(np.argwhere(core)[0])
        for y, x in flood(core, start):
            for p in around(y, x):
                label[p], free[p] = n, False


def drawing(rng, h, w):
    """Free area with lines that leave gaps, and specks."""
    d = np.full((h, w), 255)
    for _ in range(rng.integers(1, 5)):
        if rng.random() < 0.5:
            d[rng.integers(0, h), :] = 0
        else:
            d[:, rng.integers(0, w)] = 0
    for _ in range(rng.integers(0, 6)):
        y, x = rng.integers(0, h), rng.integers(0, w)
        d[y : y + rng.integers(1, 5), x : x + rng.integers(1, 5)] = 255
    d[rng.random((h, w)) < 0.03] = 0
    return d


@pytest.mark.parametrize("radius, tile", [(1, 16), (2, 13), (3, 64), (0, 20)])
def test_balls_equal_the_walk(spark, radius, tile):
    rng = np.random.default_rng(radius)
    drawings = [drawing(rng, rng.integers(12, 40), rng.integers(12, 40)) for _ in range(50)]
    got = arrays(SG.trapped_ball(images(spark, drawings), radius, tile=tile), drawings)
    for d, g in zip(drawings, got):
        want = walk_balls(d, radius)
        assert np.array_equal(g, want), (d, g, want)


def test_chain_of_fills_over_many_tiles(spark):
    """Rooms in a row whose doors are too narrow for two fills at once: each waits for the one before."""
    d = np.full((9, 120), 255)
    for x in range(9, 120, 10):
        d[:, x] = 0
        d[3:6, x] = 255
    (got,) = arrays(SG.trapped_ball(images(spark, [d]), 2, tile=8), [d])
    assert np.array_equal(got, walk_balls(d, 2))


def test_fills_end_after_the_given_number(spark):
    d = np.full((6, 30), 255)
    d[:, ::5] = 0
    (got,) = arrays(SG.trapped_ball(images(spark, [d]), 1, tile=16, max_fills=2), [d])
    want = walk_balls(d, 1)
    assert np.array_equal(got, np.where(want <= 2, want, 0)) and want.max() > 2


def corners_by_hand(mask):
    ys, xs = np.nonzero(mask)
    return OL.corners_of(ys, xs)


def test_outlines():
    rect = np.zeros((8, 9), bool)
    rect[2:6, 1:7] = True
    points = OL.turning_points(OL.last_part(np.pad(rect, 1))) - 1
    assert points.tolist() == [[2, 1], [5, 1], [5, 6], [2, 6]]
    dot, line = np.zeros((5, 5), bool), np.zeros((5, 5), bool)
    dot[2, 2] = line[2, 1:4] = True
    assert (corners_by_hand(dot), corners_by_hand(line), corners_by_hand(rect)) == (1, 2, 4)
    cross = np.zeros((30, 30), bool)
    cross[12:18] = cross[:, 12:18] = True
    assert corners_by_hand(cross) == 12
    # The last part that no other encloses counts: not the dot inside of the ring.
    ring = np.zeros((20, 20), bool)
    ring[2:12, 2:12] = True
    ring[4:10, 4:10] = False
    ring[7, 7] = True
    assert corners_by_hand(ring) == 4
    ring[16, 16] = True
    assert corners_by_hand(ring) == 1


def test_outline_points_lie_on_the_border():
    rng = np.random.default_rng(0)
    for _ in range(50):
        blob = rng.random((12, 12)) < 0.6
        part = OL.last_part(np.pad(blob, 1))
        points = OL.turning_points(part)
        for y, x in points:
            assert part[y, x] and not part[y - 1 : y + 2, x - 1 : x + 2].all()
        step = np.roll(points, -1, axis=0) - points
        if len(points) > 1:
            assert all(dy == 0 or dx == 0 or abs(dy) == abs(dx) for dy, dx in step)


def walk_merging(label, min_seg_size, max_iter=None):
    """The rounds in place, label after label, over pixels."""
    label, rounds = label.copy(), 0
    h, w = label.shape
    while max_iter is None or rounds < max_iter:
        rounds += 1
        ids = np.unique(label)
        regions = {j: np.argwhere(label == j) for j in ids}
        for j in ids[ids != 0]:
            points = regions[j]
            own = set(map(tuple, points))
            border = {
                (y + dy, x + dx) for y, x in own for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))
                if 0 <= y + dy < h and 0 <= x + dx < w
            } - own
            near = sorted({int(label[p]) for p in border} - {0})
            target = near[0] if near else (0 if len(points) < min_seg_size else j)
            n = len(points)
            corners = OL.corners_of(points[:, 0], points[:, 1]) if n < 500 else 99
            if n == 1 or corners == 1 or (corners < 6 and n < 500) or (n < 250 and len(near) == 1) or n < 10 * min_seg_size:
                label[points[:, 0], points[:, 1]] = target
        if len(np.unique(label)) == len(ids):
            break
    return label


def patchwork(rng, h, w, cells, gaps):
    """Touching regions of odd shapes: nearest of random points, some of them line."""
    at = rng.integers(0, [h, w], (cells, 2))
    yy, xx = np.mgrid[:h, :w]
    label = np.argmin([(yy - y) ** 2 + (xx - x) ** 2 for y, x in at], axis=0) + 1
    label[np.isin(label, rng.choice(cells, gaps) + 1)] = 0
    return label


@pytest.mark.parametrize("min_seg_size, tile", [(2, 16), (20, 8)])
def test_merging_equals_the_walk(spark, monkeypatch, min_seg_size, tile):
    monkeypatch.setattr(SG.TI, "TILE", 16)  # small buckets, so that choices wait for other buckets
    rng = np.random.default_rng(min_seg_size)
    drawings = [patchwork(rng, rng.integers(20, 60), rng.integers(20, 60), rng.integers(5, 60), rng.integers(0, 8)) for _ in range(12)]
    got = arrays(SG.merge_small(images(spark, drawings, "label"), min_seg_size, tile=tile), drawings)
    for d, g in zip(drawings, got):
        want = walk_merging(d, min_seg_size)
        assert np.array_equal(g, want), (d, g, want)


def test_a_chain_of_merges(spark, monkeypatch):
    """Strips beside each other, each with a smaller neighbor: over ten take the label of the first."""
    monkeypatch.setattr(SG.TI, "TILE", 12)
    d = np.repeat(np.arange(1, 15), 3)[None, :].repeat(6, axis=0)
    (got,) = arrays(SG.merge_small(images(spark, [d], "label"), 20, tile=8), [d])
    assert np.array_equal(got, walk_merging(d, 20)) and len(np.unique(got)) <= 4
    e = d.max() + 1 - d
    with pytest.warns(UserWarning, match="not settled"):
        (got,) = arrays(SG.merge_small(images(spark, [e], "label"), 20, max_iter=1, tile=8), [e])
    assert np.array_equal(got, walk_merging(e, 20, 1))


def segment_by_hand(d, radii, min_seg_size):
    rest, label = d.copy(), np.zeros(d.shape, int)
    for k, radius in enumerate([*radii, None]):
        fill = walk_balls(rest, 0 if radius is None else radius)
        sizes = np.bincount(fill.ravel(), minlength=2)
        sizes[0] = 0
        for f in np.unique(fill[fill > 0]):
            if k or sizes[f] == sizes.max():
                label[fill == f] = label.max() + 1
        rest = np.where(label > 0, 0, rest)
    label = walk_merging(label, min_seg_size)
    order = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    h, w = d.shape
    while True:
        new = label.copy()
        for y, x in np.argwhere(label == 0):
            if any(0 <= y + dy < h and 0 <= x + dx < w and label[y + dy, x + dx] for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))):
                for dy, dx in order:
                    ny, nx = y + dy, x + dx
                    if (dy >= 0 or ny > 0) and (dx >= 0 or nx > 0) and ny < h and nx < w and label[ny, nx]:
                        new[y, x] = label[ny, nx]
                        break
        if np.array_equal(new, label):
            break
        label = new
    return np.unique(label, return_inverse=True)[1].reshape(d.shape)


def test_whole_segmentation_equals_the_walks(spark):
    rng = np.random.default_rng(12)
    drawings = [drawing(rng, 30, 36) for _ in range(12)]
    got = arrays(SG.compute_seg(images(spark, drawings), min_seg_size=3, tile=16), drawings)
    for d, g in zip(drawings, got):
        want = segment_by_hand(d, (2, 1, 0), 3)
        assert np.array_equal(g, want), (d, g, want)


def test_thin_lines_by_a_drawn_picture(spark):
    """Left comes first, then clockwise; the first row and column give nothing up or to the left."""
    picture = ["1000", "0020", "0000", "3004"]
    want = ["1222", "2222", "3222", "3244"]
    d = np.array([[int(c) for c in row] for row in picture])
    (got,) = arrays(R.thin_lines(images(spark, [d], "label"), tile=8), [d])
    assert (got > 0).all()
    assert ["".join(map(str, row)) for row in got] == want


def tiled(spark, drawings, size):
    sizes = spark.createDataFrame([(i, *d.shape) for i, d in enumerate(drawings)], "image_id long, h int, w int")
    return TI.tile(images(spark, drawings).join(sizes, "image_id"), size, 0.5).drop("h", "w")


def numbered_by_hand(d):
    label, n = np.full(d.shape, -1), 0
    for start in map(tuple, np.argwhere(label < 0)):
        if label[start] < 0:
            for p in flood(d == d[start], start):
                label[p] = n
            n += 1
    return label


def files(folder, table):
    return {p.parent.name: p.name for p in Path(folder, table).rglob("*.parquet")}


def test_forest_follows_changes(spark, tmp_path):
    """Walls that appear, vanish and split regions over many tiles; only touched buckets are rewritten."""
    rng = np.random.default_rng(7)
    drawings = [np.ones((40, 56), int) for _ in range(2)]
    for d in drawings:
        d[rng.random(d.shape) < 0.1] = 0
        d[:, 20] = 0
    forest = TileForest(spark, str(tmp_path / "forest"), 8, 0.5, buckets=40)
    forest.create(tiled(spark, drawings, 8))
    for step in range(3):
        old = [d.copy() for d in drawings]
        if step == 0:
            drawings[0][5:9, 20] = 1  # a door joins two halves
        elif step == 1:
            drawings[0][5:9, 20] = 0  # and closes again
            drawings[1][20, 30:] = 0
        else:
            drawings[1][33, 50] = 1 - drawings[1][33, 50]
        before = files(forest.folder, "pixels")
        new = tiled(spark, drawings, 8)
        changed = TI.changed_tiles(tiled(spark, old, 8), new)
        hit = {f"bucket={r.b}" for r in changed.selectExpr("pmod(xxhash64(image_id, ty, tx), 40) as b").collect()}
        forest.update(new.join(changed, ["image_id", "ty", "tx"], "left_semi"))
        after = files(forest.folder, "pixels")
        assert {b for b in after if after[b] != before.get(b)} == hit and 0 < len(hit) < len(after)
        for d, g in zip(drawings, arrays(forest.labels(), drawings)):
            assert np.array_equal(g, numbered_by_hand(d)), step
    before = {t: files(forest.folder, t) for t in ("pixels", "nodes", "members", "links")}
    forest.update(tiled(spark, drawings, 8).where("false"))
    assert {t: files(forest.folder, t) for t in before} == before


def test_narrow_tiles_are_put_together(spark):
    """A halo wider than its tile copies every pixel many times; the walk stays the same over wide tiles."""
    assert TI.widened(16, 1) == 16 and TI.widened(16, 25) == 112 and TI.widened(256, 16) == 256
    d = np.where(np.arange(8 * 150).reshape(8, 150) % 150 % 12 == 11, 0, 255)
    d[3:6, 11::12] = 255
    state = images(spark, [d]).selectExpr("image_id", "y", "x", "v", "0L fill", "0L seed", "true undecided", "false patch")
    halo, tile = 16, TI.widened(8, 16)
    copies = state.select(F.explode(TI._tile_span("y", halo, tile)), "x").select(F.explode(TI._tile_span("x", halo, tile)))
    assert copies.count() < 4 * d.size
    (got,) = arrays(SG.trapped_ball(images(spark, [d]), 2, tile=8), [d])
    assert np.array_equal(got, walk_balls(d, 2))
