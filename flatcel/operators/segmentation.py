"""Segmentation of line drawings: ball fills in order, merging of small regions, the whole chain.

Both greedy steps are walks in the order of the first pixel or the label, but what they decide is
local. They run in rounds that settle every part no undecided earlier part can still reach, which
gives the result of the walk: inside a tile (with a halo) to the end, between tiles by rounds over
the few parts that cross tile borders.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flatcel.operators import scan as SC
from flatcel.operators import tiles as TI
from flatcel.operators.outlines import corner_count
from flatcel.operators.pixels import CROSS, ball, extreme
from flatcel.operators.regions import (
    PIXEL,
    fill_map,
    filter_regions,
    label_regions,
    mark_filled,
    number_regions,
    region_adjacency,
    region_props,
    relabel,
    thin_lines,
)
from flatcel.operators.skew import join_lookup, join_unique
from flatcel.session import cut_lineage, drop_written

NONE = np.iinfo("int64").max
# A part is named by its first pixel: row and column in one number, sorted like the raster.
CODE_SHIFT = 32


def mask_components(mask: np.ndarray) -> np.ndarray:
    """Flat index of the first pixel of each pixel's 4-connected part of ``mask``, -1 outside.
    Works on runs of a row, of which there are far fewer than pixels."""
    heads = mask.copy()
    heads[:, 1:] &= ~mask[:, :-1]
    run = np.cumsum(heads.ravel()).reshape(mask.shape) - 1
    meet = mask[:-1] & mask[1:]
    a, b = run[:-1][meet], run[1:][meet]
    root = np.arange(np.count_nonzero(heads))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(short := root[root], root):
            root = short
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    out = np.full(mask.shape, -1)
    out[mask] = np.flatnonzero(heads)[root[run[mask]]]
    return out


# --- ball fills --------------------------------------------------------------------


def settle_view(
    present: np.ndarray, free: np.ndarray, fill: np.ndarray, radius: int, ys: np.ndarray, xs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Fill what can be decided inside one view of a drawing: (fill, undecided core).

    The core is where a ball fits. A core part is filled, grown back by the ball, once no other part
    that its fill would touch comes earlier; what touches a fill leaves the core. Near the edge of
    the view the core is not known: parts that may reach it wait, and parts that do are taken as the
    earliest of all, so whatever is filled here is filled in every view."""
    kernel, edge = ball(radius), radius + 1
    inside = np.zeros_like(present)
    inside[edge:-edge, edge:-edge] = True
    rows, cols = np.flatnonzero(present.any(axis=1)), np.flatnonzero(present.any(axis=0))
    window = (slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1))  # the rest is empty
    ys, xs = ys[window[0]], xs[window[1]]
    present, inside, free = present[window], inside[window], free[window]
    whole, fill = fill.copy(), fill[window].copy()
    hidden = present & ~inside
    open_ = free & (fill == 0)

    def core_of(mask: np.ndarray) -> np.ndarray:
        return inside & present & (extreme(mask.astype("int8"), present, kernel, False) > 0)

    def grown(mask: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
        return extreme(mask.astype("int8"), present, shape, True) > 0

    core = core_of(open_)
    while core.any():
        first = mask_components(core)
        code = (ys[first // len(xs)].astype("int64") << CODE_SHIFT) + xs[first % len(xs)] + 1
        unknown = hidden & open_
        cut = waits = np.zeros(0, first.dtype)
        if unknown.any():
            cut = np.unique(first[core & grown(unknown, CROSS)])
            waits = np.unique(np.concatenate([cut, first[core & grown(grown(unknown, kernel), kernel)]]))
        seen = np.where(core, np.where(np.isin(first, cut), 0, code), NONE)
        near = extreme(extreme(seen, present, kernel, False), present, kernel, False)
        parts, at = np.unique(first[core], return_inverse=True)
        lowest = np.full(len(parts), NONE)
        np.minimum.at(lowest, at, near[core])
        own = (ys[parts // len(xs)].astype("int64") << CODE_SHIFT) + xs[parts % len(xs)] + 1
        ready = parts[(lowest == own) & ~np.isin(parts, waits)]
        if not len(ready):
            break
        swept = np.where(present, extreme(np.where(core & np.isin(first, ready), code, 0), present, kernel, True), 0)
        fill = np.where(swept > 0, swept, fill)
        open_ &= swept == 0
        core &= core_of(open_)
    undecided = np.zeros(whole.shape, bool)
    whole[window], undecided[window] = fill, core
    return whole, undecided


STATE = "y int, x int, v int, fill long, seed long, undecided boolean, patch boolean"


def _pass(state: DataFrame, only: DataFrame | None, radius: int, tile: int) -> DataFrame:
    """Settle every tile (or those of ``only``) with its halo. A pixel may have several rows; the
    greatest value of each column holds. Returns the pixels of the tiles, and as patches the pixels of
    other tiles that were filled on the way."""
    halo = 4 * radius + 8
    size = tile + 2 * halo
    kernel = ball(radius)
    image_type = state.schema["image_id"].dataType.simpleString()
    spread = state.withColumn("__ty", F.explode(TI._tile_span("y", halo, tile))).withColumn(
        "__tx", F.explode(TI._tile_span("x", halo, tile))
    )
    if only is not None:
        spread = spread.join(only, ["image_id", "__ty", "__tx"], "left_semi")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, ty, tx = key
        y0, x0 = int(ty) * tile - halo, int(tx) * tile - halo
        at = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        present = np.zeros((size, size), bool)
        present[at] = True
        v, fill, seed = (np.zeros((size, size), "int64") for _ in range(3))
        for array, name in ((v, "v"), (fill, "fill"), (seed, "seed")):
            np.maximum.at(array, at, pdf[name].to_numpy())
        own = np.zeros_like(present)
        own[halo : halo + tile, halo : halo + tile] = True
        if not (own & present).any():
            return pd.DataFrame({c.split()[0]: [] for c in f"image_id long, {STATE}".split(", ")})
        before = fill
        fill = np.maximum(fill, extreme(seed, present, kernel, True))
        fill = np.where(present, fill, 0)
        fill, core = settle_view(present, v == 255, fill, radius, np.arange(size) + y0, np.arange(size) + x0)
        out = []
        for where, patch in ((own & present, False), (~own & (fill > 0) & (before == 0), True)):
            yy, xx = np.nonzero(where)
            out.append(
                pd.DataFrame(
                    {
                        "image_id": np.repeat(image, len(yy)), "y": (yy + y0).astype("int32"), "x": (xx + x0).astype("int32"),
                        "v": 0 if patch else v[yy, xx].astype("int32"), "fill": fill[yy, xx], "seed": np.zeros(len(yy), "int64"),
                        "undecided": core[yy, xx] & (not patch), "patch": patch,
                    }
                )
            )
        return pd.concat(out) if len(out[1]) else out[0]

    return spread.groupBy("image_id", "__ty", "__tx").applyInPandas(run, f"image_id {image_type}, {STATE}")


def _earliest_parts(undecided: DataFrame, radius: int, tile: int) -> DataFrame:
    """Of the undecided core pixels those of parts that no earlier part can touch, as seeds."""
    parts = label_regions(undecided.select(*PIXEL, F.lit(1).alias("v")), "v", tile).select(
        *PIXEL, (F.shiftleft(F.col("region_y").cast("long"), CODE_SHIFT) + F.col("region_x") + 1).alias("code")
    )
    parts = cut_lineage(parts)
    kernel = ball(radius)
    # Two fills touch if a ball around one part's pixel meets a ball around the other's.
    reach = sorted({(a + c, b + d) for a, b in kernel for c, d in kernel})

    def lowest(present, arrays, ys, xs):
        return {"code": arrays["code"], "low": extreme(arrays["code"], present, reach, False)}

    met = TI.stencil(parts, ("code",), 2 * radius, lowest, {"code": "long", "low": "long"}, tile)
    ready = met.groupBy("image_id", "code").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("__n")).where("low = code")
    return join_unique(parts, ready.select("image_id", "code", "__n"), ["image_id", "code"], "__n").select(
        *PIXEL, F.lit(0).alias("v"), F.lit(0).cast("long").alias("fill"), F.col("code").alias("seed"),
        F.lit(False).alias("undecided"), F.lit(False).alias("patch"),
    )


def _tiles_around(pixels: DataFrame, reach: int, tile: int) -> DataFrame:
    return pixels.select(
        "image_id", F.explode(TI._tile_span("y", reach, tile)).alias("__ty"), "x"
    ).select("image_id", "__ty", F.explode(TI._tile_span("x", reach, tile)).alias("__tx")).distinct()


def trapped_ball(
    mask: DataFrame, radius: int, method: str | None = None, tile: int = TI.TILE, max_fills: int | None = None
) -> DataFrame:
    """Areas of a mask (255 free, 0 line or filled) a ball of ``radius`` can sweep, one after the
    other: (image_id, y, x, label), labels from 1 in the order of the fills.

    Where the ball fits is the core. The 4-connected core part of the first core pixel in raster
    order is grown back by the ball and taken out of the free area; the core shrinks by what can no
    longer hold a ball; and so on to the end. Fills never overlap, and each fill is a wall for the
    next. ``max_fills`` ends the walk of an image early; ``method`` then keeps only areas of at least
    the largest, mean or median size. Tiles that are narrow for the ball are put together.

    An image leaves the rounds once all its parts are decided.
    """
    halo = 4 * radius + 8
    tile = TI.widened(tile, halo)
    state = mask.select(
        *PIXEL, F.col("v").cast("int").alias("v"), F.lit(0).cast("long").alias("fill"), F.lit(0).cast("long").alias("seed"),
        F.lit(True).alias("undecided"), F.lit(False).alias("patch"),
    )
    only, written, settled = None, [], []
    at = {n: F.floor(F.col(c) / tile) for c, n in (("y", "__ty"), ("x", "__tx"))}
    keys = ["image_id", *at]
    while True:
        out = _pass(state, only, radius, tile)
        if only is not None:
            out = out.unionByName(state.withColumns(at).join(only, keys, "left_anti").drop(*at).withColumn("patch", F.lit(False)))
        state = cut_lineage(out)
        drop_written(*written)
        undecided = cut_lineage(state.where("undecided").select(*PIXEL))
        written = [state, undecided]
        filled = state.where("fill > 0").select(*PIXEL, "fill")
        if undecided.isEmpty():
            settled.append(filled)
            break
        waits = undecided.select("image_id").distinct()
        settled.append(cut_lineage(filled.join(waits, "image_id", "left_anti")))
        state = state.join(waits, "image_id", "left_semi")
        waiting = undecided.withColumns(at).select(*keys).distinct()
        # What another tile filled changes a view; only tiles that still decide something look again.
        only = cut_lineage(_tiles_around(state.where("patch"), halo, tile).join(waiting, keys, "left_semi"))
        written.append(only)
        if not only.isEmpty():
            continue
        seeds = cut_lineage(_earliest_parts(undecided, radius, tile))
        only = cut_lineage(_tiles_around(seeds, halo, tile).join(waiting, keys, "left_semi"))
        written += [seeds, only]
        state = state.unionByName(seeds)
    fills = reduce(DataFrame.unionByName, settled).groupBy(*PIXEL).agg((F.max("fill") - 1).alias("__f"))
    named = cut_lineage(
        fills.select(
            *PIXEL, F.shiftright("__f", CODE_SHIFT).cast("int").alias("region_y"),
            F.col("__f").bitwiseAND((1 << CODE_SHIFT) - 1).cast("int").alias("region_x"),
        )
    )
    drop_written(*written, *settled)
    grown = number_regions(named, first=1).select(*PIXEL, "label")
    if max_fills is not None:
        grown = grown.where(F.col("label") <= max_fills)
    if method is None:
        return grown
    grown = cut_lineage(grown)
    kept = filter_regions(region_props(grown), method).select("image_id", "label", F.col("area").alias("__n"))
    return join_unique(grown, kept, ["image_id", "label"], "__n").drop("__n")


def trapped_ball_sequence(mask: DataFrame, radii: tuple[int, ...] = (2, 1, 0), tile: int = TI.TILE) -> DataFrame:
    """Fill with shrinking balls (the first keeps only the largest area), then flood what is left: a
    label image with 0 for lines. Fills are numbered by pass and, inside a pass, in their order."""
    rest = cut_lineage(mask.select(*PIXEL, "v"))
    out = None
    for k, radius in enumerate([*radii, None]):
        if radius is None:
            fill = number_regions(label_regions(rest.where("v = 255"), "v", tile), first=1).select(*PIXEL, "label")
        else:
            fill = trapped_ball(rest, radius, "max" if k == 0 else None, tile)
        fill = cut_lineage(fill.withColumn("pass", F.lit(k)))
        before, rest = rest, cut_lineage(mark_filled(rest, fill))
        drop_written(before)
        out = fill if out is None else out.unionByName(fill)
    ids = out.groupBy("image_id", "pass", "label").agg(F.count(F.lit(1)).alias("__n"))
    numbered = SC.numbered(
        ids, ["image_id"], ["pass", "label"], [{"p": F.col("pass"), "l": F.floor(F.col("label") / SC.BUCKET_ROWS)}], "__pos"
    ).withColumn("fill_id", (F.col("__pos") + 1).cast("int"))
    fills = join_unique(out, numbered, ["image_id", "pass", "label"], "__n").select(*PIXEL, "fill_id")
    return fill_map(fills, mask)


# --- small regions -----------------------------------------------------------------

# Fixed values of the merging rules: area below which few corners or a single neighbor suffice.
PLAIN_AREA, PLAIN_CORNERS, LONELY_AREA, SMALL_FACTOR = 500, 6, 250, 10


def merge_small(labels: DataFrame, min_seg_size: int = 20, max_iter: int | None = None, tile: int = TI.TILE) -> DataFrame:
    """Merge small regions into the smallest label they touch. Label 0 is line.

    A round walks the labels in ascending order; a region takes the smallest label on its border as
    the border is by then, or without any becomes line if below ``min_seg_size``, if it is a point
    (one pixel, or an outline of one corner), or has under 6 corners and under 500 pixels, or under
    250 pixels and one label on its border, or under ten times ``min_seg_size``. Corners are those of
    the simplified outer outline of the region's last part; regions of 500 pixels or more count as
    having several. Rounds go on until the number of labels of an image no longer changes;
    ``max_iter`` rounds at most if given, then with a warning if an image was not settled.

    The pixels are read once. A region's choice depends on smaller labels beside it alone, so a round
    is settled from table to table: regions sorted by place, each bucket as far as it can get, until
    no choice is open.
    """
    labels = cut_lineage(labels)
    found = labels.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("area"), F.min(F.struct("y", "x")).alias("first")
    )
    facts = cut_lineage(
        found.select("image_id", "label", "area", *[F.floor(F.col(f"first.{c}") / TI.TILE).alias(f"b{c}") for c in "yx"])
    )
    outlined = (
        join_unique(labels, facts.select("image_id", "label", "area"), ["image_id", "label"], "area")
        .where((F.col("label") != 0) & (F.col("area") < PLAIN_AREA))
        .groupBy("image_id", "label")
        .agg(F.collect_list(F.struct("y", "x")).alias("pixels"))
    )
    outlined = outlined.withColumn("corners", corner_count("pixels"))
    atoms = facts.join(outlined, ["image_id", "label"], "left")
    # ``label`` never changes, ``now`` is what the region has become.
    atoms = cut_lineage(atoms.withColumns({"now": F.col("label"), "going": F.lit(True)}))
    touching = cut_lineage(
        region_adjacency(labels, tile).where("label <> 0 and other <> 0").select("image_id", "label", "other")
    )
    rounds = 0
    while max_iter is None or rounds < max_iter:
        rounds += 1
        going = atoms.where("going")
        moved = _merge_round(going, touching, min_seg_size)
        counts = F.count_distinct("now").alias("before")
        after = cut_lineage(
            join_lookup(going, moved.withColumnRenamed("label", "now"), ["image_id", "now"]).withColumn("new", F.coalesce("to", "now"))
        )
        drop_written(moved)
        settled = after.groupBy("image_id").agg(counts, F.count_distinct("new").alias("after"))
        settled = cut_lineage(settled.select("image_id", (F.col("before") != F.col("after")).alias("__go")))
        changed = join_lookup(after.withColumn("now", F.col("new")).drop("new", "to", "going"), settled, ["image_id"])
        merged = cut_lineage(
            changed.withColumnRenamed("__go", "going").unionByName(atoms.where("not going"))
        )
        drop_written(atoms, after)
        atoms = merged
        left = settled.where("__go").count()
        drop_written(settled)
        if not left:
            break
    else:
        import warnings

        warnings.warn(f"merge_small: {left} images not settled after {max_iter} rounds", stacklevel=2)
    mapping = atoms.select("image_id", "label", "now", F.col("area").alias("__n"))
    return join_unique(labels, mapping, ["image_id", "label"], "__n").select(
        *[c for c in labels.columns if c != "label"], F.col("now").cast("int").alias("label")
    )


def _merge_round(atoms: DataFrame, touching: DataFrame, min_seg_size: int) -> DataFrame:
    """(image_id, label, to) of the regions that change in one round."""
    key = ["image_id", "label"]
    regions = atoms.where("now <> 0").groupBy("image_id", F.col("now").alias("label")).agg(
        F.sum("area").alias("area"), F.min(F.struct("by", "bx")).alias("b"), F.count(F.lit(1)).alias("__parts"),
        F.any_value("corners").alias("__single"),
    )
    movable = regions.where(F.col("area") < max(PLAIN_AREA, SMALL_FACTOR * min_seg_size))
    # A region of one part keeps its outline; others are traced again, at most 500 pixels each.
    several = movable.where((F.col("__parts") > 1) & (F.col("area") < PLAIN_AREA)).select("image_id", F.col("label").alias("now"))
    traced = atoms.join(several, ["image_id", "now"], "left_semi").groupBy("image_id", F.col("now").alias("label")).agg(
        F.flatten(F.collect_list("pixels")).alias("__p")
    ).select("image_id", "label", corner_count("__p").alias("__traced"))
    nodes = cut_lineage(
        movable.join(traced, key, "left").select(
            *key, "area", F.col("b.by").alias("by"), F.col("b.bx").alias("bx"),
            F.when(F.col("__parts") == 1, F.col("__single")).otherwise(F.col("__traced")).alias("corners"),
        )
    )
    names = atoms.select(*key, "now")
    sides = join_lookup(touching, names, key, "inner").select("image_id", F.col("now").alias("__f"), F.col("other").alias("label"))
    sides = sides.join(nodes.select("image_id", F.col("label").alias("__f")), ["image_id", "__f"], "left_semi").distinct()
    sides = join_lookup(sides, names, key, "inner").select("image_id", F.col("__f").alias("label"), F.col("now").alias("other"))
    sides = sides.where("label <> other and other <> 0").distinct()
    # Greater labels and regions that never move are known as they are.
    free = nodes.select("image_id", F.col("label").alias("other"), F.lit(True).alias("__moves"))
    marked = join_lookup(sides, free, ["image_id", "other"])
    known = F.when((F.col("other") > F.col("label")) | F.col("__moves").isNull(), F.col("other"))
    open_sides = cut_lineage(
        marked.withColumn("is", known).join(nodes.select(*key, "by", "bx"), key).select(*key, "by", "bx", "other", "is")
    )
    image_type, label_type = (nodes.schema[c].dataType.simpleString() for c in key)

    def choose(regions: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        met: dict[int, list[tuple[int, float]]] = {}
        for f, g, value in zip(sides["label"], sides["other"], sides["is"]):
            met.setdefault(f, []).append((g, value))
        done: dict[int, int] = {}
        for r in regions.sort_values("label").itertuples():
            border = [done.get(g) if value is None or value != value else int(value) for g, value in met.get(r.label, [])]
            if any(b is None for b in border):
                continue
            ids = sorted({*border} - {0})
            target = ids[0] if ids else (0 if r.area < min_seg_size else r.label)
            point = r.area == 1 or r.corners == 1
            plain = r.area < PLAIN_AREA and r.corners < PLAIN_CORNERS
            lonely = r.area < LONELY_AREA and len(ids) == 1
            small = r.area < SMALL_FACTOR * min_seg_size
            done[r.label] = target if point or plain or lonely or small else r.label
        image = regions["image_id"].iloc[0] if len(regions) else None
        return pd.DataFrame({"image_id": [image] * len(done), "label": list(done), "to": list(done.values())})

    place = ["image_id", "by", "bx"]
    rest, decided = nodes, None
    while True:
        now = cut_lineage(
            rest.groupBy(*place).cogroup(open_sides.groupBy(*place)).applyInPandas(
                choose, f"image_id {image_type}, label {label_type}, to {label_type}"
            )
        )
        decided = now if decided is None else decided.unionByName(now)
        left = cut_lineage(rest.join(now, key, "left_anti"))
        if left.isEmpty():
            break
        rest = left
        answers = now.select("image_id", F.col("label").alias("other"), F.col("to").alias("__to"))
        before = open_sides
        open_sides = cut_lineage(
            open_sides.join(rest.select(*key), key, "left_semi").join(answers, ["image_id", "other"], "left").select(
                *key, "by", "bx", "other", F.coalesce("is", "__to").alias("is")
            )
        )
        drop_written(before)
    return cut_lineage(decided.where("label <> to"))


def compute_seg(
    mask: DataFrame, radii: tuple[int, ...] = (2, 1, 0), max_iter: int | None = None, min_seg_size: int = 20, tile: int = TI.TILE
) -> DataFrame:
    """Segmentation of a binarized line image: ball fills, small regions merged, lines given to their
    neighbors, labels made contiguous. ``max_iter`` bounds the rounds of merging, see ``merge_small``."""
    fills = trapped_ball_sequence(mask, radii, tile)
    merged = merge_small(fills, min_seg_size, max_iter, tile)
    return relabel(thin_lines(merged, tile=tile))
