"""Labels of many tiles in one call, against one tile at a time."""

from __future__ import annotations

import random

import numpy as np
import pytest

from flatcel.operators import regions as R
from flatcel.operators import tiles as TI


def tile_rows():
    """Tiles of three images (one without a name), with holes, null values and one large tile."""
    rng, rows = random.Random(3), []
    for image in ("a", "b", None):
        for ty in range(4):
            for tx in range(3):
                size = 40 if (image, ty, tx) == ("b", 1, 1) else 7
                for y in range(size):
                    for x in range(size):
                        if rng.random() < 0.9:
                            value = None if rng.random() < 0.05 else int(rng.random() < 0.6)
                            rows.append((image, ty, tx, 3 * ty + y, 3 * tx + x, y, x, value))
    rng.shuffle(rows)
    return rows


def one_by_one(rows):
    out, tiles = {}, {}
    for r in rows:
        tiles.setdefault(r[:3], []).append(r)
    for key, pixels in tiles.items():
        at = {r[5:7]: r[7] for r in pixels}
        label, n = {}, 0
        for p in sorted(at):
            if p in label:
                continue
            label[p], todo = n, [p]
            while todo:
                y, x = todo.pop()
                for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if q in at and q not in label and at[q] is not None and at[q] == at[y, x]:
                        label[q] = n
                        todo.append(q)
            n += 1
        out |= {(*key, *p): k for p, k in label.items()}
    return out


@pytest.mark.parametrize("task_rows", [1, 60, 1 << 17])
def test_label_tiles(spark, task_rows):
    rows = tile_rows()
    df = spark.createDataFrame(rows, "image_id string, ty long, tx long, y int, x int, ly long, lx long, v int").repartition(4)
    got = R.label_tiles(df, task_rows=task_rows).collect()
    assert {(r.image_id, r.ty, r.tx, r.ly, r.lx): r.label for r in got} == one_by_one(rows)
    assert len(got) == len(rows)


def test_no_call_per_tile(spark):
    df = spark.createDataFrame(tile_rows(), "image_id string, ty long, tx long, y int, x int, ly long, lx long, v int")
    plan = R.label_tiles(df)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_spirals():
    """A region that winds through its tile is one, beside a tile of single pixels."""
    lines = ["11111", "00001", "11101", "10001", "11111"]
    spiral = np.array([[int(c) for c in line] for line in lines])
    checks = np.indices((5, 5)).sum(axis=0) % 2
    tile, at = np.repeat([0, 1], 25), np.tile(np.arange(25), 2)
    got = R._label_many(tile, at // 5, at % 5, np.concatenate([spiral.ravel(), checks.ravel()]))
    assert got[:25].reshape(5, 5).tolist() == [[0] * 5, [1] * 4 + [0], [0] * 3 + [1, 0], [0] + [1] * 3 + [0], [0] * 5]
    assert got[25:].tolist() == list(range(25))


def test_tiles_of_changes(spark):
    """Changed pixels lead to the tiles that the comparison of whole mosaics finds."""
    rng = random.Random(9)
    old = [(i, y, x, rng.choice([0, 1, None]), 30, 41) for i in ("a", "b", "c") for y in range(30) for x in range(41) if rng.random() < 0.95]
    new = [(*r[:3], 1 - r[3], 30, 41) if r[0] == "a" and r[3] is not None and rng.random() < 0.01 else r for r in old]
    new = [r for k, r in enumerate(new) if k != 1500] + [("b", 29, 90, 1, 30, 91)]
    schema = "image_id string, y int, x int, v int, h int, w int"
    old, new = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    got = sorted(map(tuple, TI.tiles_of_changes(old, new, 8, 0.5).collect()))
    mosaics = (TI.tile(df, 8, 0.5).drop("h", "w") for df in (old, new))
    assert got == sorted(map(tuple, TI.changed_tiles(*mosaics).collect())) and len(got) > 20
