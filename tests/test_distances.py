"""Distances to the nearest pixel against all pairs of pixels."""

from __future__ import annotations

import numpy as np
import pytest

from flatcel.operators.pixels import _fold_rows, distance_transform, signed_distance


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 9, 64, 100])
def test_fold_rows(width):
    rng = np.random.default_rng(width)
    g = rng.integers(0, 60, (40, width)).astype(float) ** 2
    g[rng.random(g.shape) < rng.random((40, 1))] = np.inf
    g[0], g[1] = np.inf, 0
    x = np.arange(width)
    plain = ((x[:, None] - x[None, :]) ** 2 + g[:, None, :]).min(axis=2)
    assert np.array_equal(_fold_rows(g), plain)


def to_hits(v, hit):
    ys, xs = np.nonzero(hit)
    if len(ys) == 0:
        return np.full(v.shape, np.nan)
    y, x = np.indices(v.shape)
    return np.sqrt(((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(axis=2))


def test_distances_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    images = {i: (rng.random((rng.integers(1, 75), rng.integers(1, 40))) < p).astype(int) for i, p in enumerate((0.5, 0.05, 0.97, 1, 0))}
    rows = [(i, int(y), int(x), int(v[y, x])) for i, v in images.items() for y, x in np.ndindex(v.shape)]
    mask = spark.createDataFrame(rows, "image_id int, y int, x int, v int")
    plain = {i: to_hits(v, v == 0) for i, v in images.items()}
    got = distance_transform(mask).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain[r.image_id][r.y, r.x]
        assert (r.dist is None and np.isnan(want)) or r.dist == pytest.approx(want, abs=1e-9)
    for r in signed_distance(mask).collect():
        v = images[r.image_id]
        both = plain[r.image_id] - to_hits(v, v == 1)
        if np.isnan(both).all() or both.max() == both.min():
            assert r.sdf is None
        else:
            want = (both[r.y, r.x] - both.min()) / (both.max() - both.min())
            assert r.sdf == pytest.approx(want, abs=1e-9)
