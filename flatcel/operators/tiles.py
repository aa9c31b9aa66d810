"""Tiles: neighborhood operators on image blocks, overlapping mosaics.

Neighborhood operators cut images into square tiles with a halo as wide as the
neighborhood. A pixel is copied only if it lies near a tile border, so one
shuffle of little more than the image replaces a join with every kernel offset,
and a poster-sized drawing spreads over as many tasks as it has tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TILE = 256
# A tile is at least this many halos wide: a narrower one copies more pixels than it owns.
HALOS = 4
# Types of what a neighborhood operator returns.
ARROW = {
    "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(),
    "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(),
}

Arrays = dict[str, np.ndarray]


def _tile_span(coordinate: str, radius: int, tile: int) -> Column:
    c = F.col(coordinate)
    return F.sequence(F.floor((c - radius) / tile), F.floor((c + radius) / tile))


def widened(tile: int, halo: int) -> int:
    """The least multiple of ``tile`` that is wide enough for the halo. No result depends on it."""
    return tile * max(1, -(-HALOS * halo // tile))


def stencil(
    pixels: DataFrame,
    inputs: tuple[str, ...],
    radius: int,
    fn: Callable[[np.ndarray, Arrays, np.ndarray, np.ndarray], Arrays],
    outputs: dict[str, str],
    tile: int = TILE,
) -> DataFrame:
    """Apply ``fn`` to each tile.

    ``fn(present, arrays, ys, xs)`` gets the tile with its halo as dense arrays
    (``present`` marks pixels that exist, ``ys``/``xs`` are image coordinates)
    and returns arrays of the same shape, right at least in the core. The result
    has (image_id, y, x) and ``outputs`` (name -> SQL type). Tiles that are narrow for
    ``radius`` are put together.
    """
    tile = widened(tile, radius)
    spread = (
        pixels.select("image_id", "y", "x", *inputs)
        .withColumn("__ty", F.explode(_tile_span("y", radius, tile)))
        .withColumn("__tx", F.explode(_tile_span("x", radius, tile)))
    )
    image_type = pixels.schema["image_id"].dataType.simpleString()
    schema = f"image_id {image_type}, y int, x int, " + ", ".join(f"{n} {t}" for n, t in outputs.items())
    size = tile + 2 * radius

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y0, x0 = key[1].as_py() * tile - radius, key[2].as_py() * tile - radius
        yy, xx = table.column("y").to_numpy() - y0, table.column("x").to_numpy() - x0
        present = np.zeros((size, size), dtype=bool)
        present[yy, xx] = True
        core = np.zeros_like(present)
        core[radius : radius + tile, radius : radius + tile] = True
        oy, ox = np.nonzero(core & present)
        image = table.column("image_id").type
        types = {"image_id": image, "y": pa.int32(), "x": pa.int32(), **{n: ARROW[t] for n, t in outputs.items()}}
        if len(oy) == 0:
            return pa.table({n: pa.array([], t) for n, t in types.items()})
        arrays: Arrays = {}
        for name in inputs:
            values = table.column(name).to_numpy()
            dense = np.zeros((size, size), dtype=values.dtype)
            dense[yy, xx] = values
            arrays[name] = dense
        result = fn(present, arrays, np.arange(size) + y0, np.arange(size) + x0)
        columns = {"y": oy + y0, "x": ox + x0, **{n: result[n][oy, ox] for n in outputs}}
        return pa.table(
            {"image_id": pa.array([key[0].as_py()] * len(oy), image), **{n: pa.array(c).cast(types[n]) for n, c in columns.items()}}
        )

    return spread.groupBy("image_id", "__ty", "__tx").applyInArrow(run, schema)


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """Array whose entry (y, x) is ``a[y + dy, x + dx]``, ``fill`` outside."""
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[
        max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)
    ]
    return out


# --- overlapping mosaics -------------------------------------------------------


def _first_last(coordinate: str, extent: str, size: int, step: int) -> Column:
    c = F.col(coordinate)
    count = F.greatest(F.lit(1), F.ceil((F.col(extent) - size) / step) + 1)
    first = F.greatest(F.lit(0), F.ceil((c - size + 1) / step))
    return F.sequence(first, F.least(F.floor(c / step), count - 1))


def tile(pixels: DataFrame, size: int = 512, overlap: float = 0.5) -> DataFrame:
    """Copy each pixel into all tiles of the overlapping mosaic that hold it.

    ``pixels`` carry the image size as ``h`` and ``w``. Adds tile row and column
    (``ty``, ``tx``), the position in the tile (``ly``, ``lx``) and the mosaic
    size (``rows``, ``cols``).
    """
    step = int(size * (1 - overlap))
    count = {
        n: F.greatest(F.lit(1), F.ceil((F.col(e) - size) / step) + 1) for n, e in (("rows", "h"), ("cols", "w"))
    }
    return (
        pixels.withColumn("ty", F.explode(_first_last("y", "h", size, step)))
        .withColumn("tx", F.explode(_first_last("x", "w", size, step)))
        .withColumns(
            {"ly": F.col("y") - F.col("ty") * step, "lx": F.col("x") - F.col("tx") * step, **count}
        )
    )


def _inner(local: str, index: str, count: str, size: int, margin: int) -> Column:
    low = F.when(F.col(index) == 0, 0).otherwise(margin)
    high = F.when(F.col(index) == F.col(count) - 1, size).otherwise(size - margin)
    return (F.col(local) >= low) & (F.col(local) < high)


def merge_tiles(tiles: DataFrame, size: int = 512, overlap: float = 0.5) -> DataFrame:
    """One value per pixel: each tile keeps its center window, outer tiles reach
    to the image edge."""
    margin = int(size * overlap / 2)
    return tiles.where(_inner("ly", "ty", "rows", size, margin) & _inner("lx", "tx", "cols", size, margin))


def border_pairs(tiles: DataFrame, size: int = 512, overlap: float = 0.5) -> DataFrame:
    """Labels of neighboring tiles that meet on their facing borders.

    The lower border of a tile and the upper border of the next one, both half
    an overlap in, are the same image row, so pairs are an equi join on the
    pixel; likewise for columns. ``tiles`` needs ``label``.
    """
    margin = int(size * overlap / 2)
    out = None
    for local, index, other, olocal, ocount in (("ly", "ty", "tx", "lx", "cols"), ("lx", "tx", "ty", "ly", "rows")):
        across = _inner(olocal, other, ocount, size, margin)
        upper = tiles.where(across & (F.col(local) == size - margin)).select(
            "image_id", "y", "x", F.struct("ty", "tx", "label").alias("a"), (F.col(index) + 1).alias("__n"), F.col(other).alias("__o")
        )
        lower = tiles.where(across & (F.col(local) == margin)).select(
            "image_id", "y", "x", F.struct("ty", "tx", "label").alias("b"), F.col(index).alias("__n"), F.col(other).alias("__o")
        )
        pairs = upper.join(lower, ["image_id", "y", "x", "__n", "__o"]).select("image_id", "a", "b").distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def changed_tiles(old: DataFrame, new: DataFrame, value: str = "v") -> DataFrame:
    """Tiles in which any pixel differs between two versions."""
    keys = ["image_id", "ty", "tx", "y", "x"]
    a = old.select(*keys, F.col(value).alias("__a"))
    b = new.select(*keys, F.col(value).alias("__b"))
    return (
        a.join(b, keys, "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select("image_id", "ty", "tx").distinct()
    )


def tiles_of_changes(old: DataFrame, new: DataFrame, size: int = 512, overlap: float = 0.5, value: str = "v") -> DataFrame:
    """What ``changed_tiles`` finds in the mosaics of two versions, from pixels with ``h`` and ``w``:
    pixels are compared once, not once for each tile that holds them."""
    keys = ["image_id", "y", "x", "h", "w"]
    a = old.select(*keys, F.col(value).alias("__a"))
    b = new.select(*keys, F.col(value).alias("__b"))
    changed = a.join(b, keys, "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return tile(changed, size, overlap).select("image_id", "ty", "tx").distinct()
