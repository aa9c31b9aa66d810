"""Regions: labelling, filling, merging, thinning, boxes, points.

Labels are made in two steps. Inside a tile a small array routine joins equal
neighbors; between tiles only the pixels along the borders are compared and the
tile regions are linked by distributed connected components. A background that
fills a third of all pixels is a few thousand tile regions, not one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flatcel.functions.arrays import seeded_number, seeded_text
from flatcel.operators import scan as SC
from flatcel.operators import tiles as TI
from flatcel.operators.graph import components
from flatcel.operators.pixels import CROSS
from flatcel.operators.skew import join_lookup, join_unique, with_group_facts
from flatcel.session import cut_lineage, drop_written

PIXEL = ["image_id", "y", "x"]
# Rows of whole tiles that a task labels at once.
LABEL_ROWS = 1 << 17


def local_components(present: np.ndarray, values: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Index of the first pixel (raster order) of the equal-valued region of each
    present pixel: minimum labels pass along links, roots are then shortened."""
    h, w = values.shape
    at = np.arange(h * w).reshape(h, w)
    links = []
    for dy, dx in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else []):
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
        same = present[a] & present[b] & (values[a] == values[b])
        links.append(np.stack([at[a][same], at[b][same]]))
    a, b = np.concatenate(links, axis=1)
    root = np.arange(h * w)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            short = root[root]
            if np.array_equal(short, root):
                break
            root = short
        if np.array_equal(before, root):
            return root.reshape(h, w)


def _tile_regions(pixels: DataFrame, value: str, tile: int, diagonal: bool) -> DataFrame:
    """Pixels with the first pixel (ry, rx) of their region inside their tile."""

    def local(present, arrays, ys, xs):
        root = local_components(present, arrays[value], diagonal)
        return {
            value: arrays[value],
            "ry": ys[root // root.shape[1]].astype("int32"),
            "rx": xs[root % root.shape[1]].astype("int32"),
        }

    kind = pixels.schema[value].dataType.simpleString()
    return TI.stencil(pixels, (value,), 0, local, {value: kind, "ry": "int", "rx": "int"}, tile)


def _node(image: str = "image_id", y: str = "ry", x: str = "rx") -> Column:
    return F.struct(F.col(image).alias("image_id"), F.col(y).alias("y"), F.col(x).alias("x"))


def _border_links(local: DataFrame, value: str, tile: int, diagonal: bool) -> DataFrame:
    """Links between regions of neighboring tiles, from border pixels only."""
    on_edge = (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    edge = local.where(on_edge)
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    ahead = edge.select(
        "image_id", value, _node().alias("src"), F.floor(F.col("y") / tile).alias("__ty"), F.floor(F.col("x") / tile).alias("__tx"),
        F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("p"),
    ).select("image_id", value, "src", "__ty", "__tx", "p.y", "p.x").where(
        (F.floor(F.col("y") / tile) != F.col("__ty")) | (F.floor(F.col("x") / tile) != F.col("__tx"))
    )
    met = edge.select("image_id", value, "y", "x", _node().alias("dst"))
    return ahead.join(met, ["image_id", value, "y", "x"]).select("src", "dst").distinct()


def label_regions(
    pixels: DataFrame, value: str = "v", tile: int = TI.TILE, diagonal: bool = False
) -> DataFrame:
    """Connected regions of equal ``value``: adds ``region_y``/``region_x``, the
    first pixel of the region in raster order."""
    local = cut_lineage(_tile_regions(pixels, value, tile, diagonal))
    links = cut_lineage(_border_links(local, value, tile, diagonal))
    if links.isEmpty():
        return local.withColumnsRenamed({"ry": "region_y", "rx": "region_x"})
    roots = components(links).select(
        "node.image_id", F.col("node.y").alias("ry"), F.col("node.x").alias("rx"),
        F.col("component.y").alias("__y"), F.col("component.x").alias("__x"),
    )
    # A tile region has at most tile x tile pixels, so no key here is hot.
    return local.join(roots, ["image_id", "ry", "rx"], "left").select(
        *PIXEL, value, F.coalesce("__y", "ry").alias("region_y"), F.coalesce("__x", "rx").alias("region_x")
    )


def number_regions(labelled: DataFrame, first: int = 0) -> DataFrame:
    """Replace region_y/region_x by ``label``, counted in raster order."""
    regions = labelled.groupBy("image_id", "region_y", "region_x").agg(F.count(F.lit(1)).alias("__n"))
    numbered = SC.numbered(
        regions, ["image_id"], ["region_y", "region_x"], SC.by_number("region_y", 64), "__pos"
    ).select("image_id", "region_y", "region_x", "__n", (F.col("__pos") + first).cast("int").alias("label"))
    return join_unique(labelled, numbered, ["image_id", "region_y", "region_x"], "__n").drop(
        "__n", "region_y", "region_x"
    )


def relabel(labels: DataFrame, as_byte: bool = False) -> DataFrame:
    """Labels renumbered 0..n-1 by value; optionally wrapped to a byte."""
    values = labels.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("__n"))
    numbered = SC.numbered(values, ["image_id"], ["label"], SC.by_number("label"), "__pos")
    new = F.col("__pos") % 256 if as_byte else F.col("__pos")
    return join_unique(labels, numbered, ["image_id", "label"], "__n").select(
        *[c for c in labels.columns if c != "label"], new.cast("int").alias("label")
    )


def fill_from(seeds: DataFrame, pixels: DataFrame, value: str = "v", tile: int = TI.TILE) -> DataFrame:
    """Pixels reached by flood fill from seed points (image_id, y, x) without
    leaving the seed's ``value``."""
    labelled = cut_lineage(label_regions(pixels, value, tile))
    hit = (
        labelled.join(seeds.select(*PIXEL).distinct(), PIXEL, "left_semi")
        .select("image_id", "region_y", "region_x")
        .distinct()
        .withColumn("__hit", F.lit(True))
    )
    sizes = labelled.groupBy("image_id", "region_y", "region_x").agg(F.count(F.lit(1)).alias("__n"))
    wanted = sizes.join(hit, ["image_id", "region_y", "region_x"]).drop("__hit")
    return join_unique(labelled, wanted, ["image_id", "region_y", "region_x"], "__n").drop("__n")


def region_props(labels: DataFrame) -> DataFrame:
    """Area and bounding rectangle of each label."""
    return labels.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x").alias("x1"), F.max("x").alias("x2"),
    )


def filter_regions(props: DataFrame, method: str | None = "mean") -> DataFrame:
    """Regions whose area reaches the largest, median or mean area of their
    image (None keeps all)."""
    if method is None:
        return props
    area = F.col("area")
    limit = {"max": F.max(area), "mean": F.avg(area), "median": F.percentile(area, 0.5)}[method]
    return with_group_facts(props, ["image_id"], {"__limit": limit}).where(area >= F.col("__limit")).drop("__limit")


def region_adjacency(labels: DataFrame, tile: int = TI.TILE) -> DataFrame:
    """Contact of each label with others: pixels of ``other`` that touch
    ``label`` on one of four sides."""

    def sides(present, arrays, ys, xs):
        around = [
            np.where(TI.shifted(present, dy, dx, False), TI.shifted(arrays["label"], dy, dx, 0), arrays["label"])
            for dy, dx in CROSS
            if dy or dx
        ]
        return {"label": arrays["label"], **{f"n{i}": a for i, a in enumerate(around)}}

    four = TI.stencil(labels, ("label",), 1, sides, {n: "int" for n in ("label", "n0", "n1", "n2", "n3")}, tile)
    touching = F.array_distinct(F.array("n0", "n1", "n2", "n3"))
    return (
        four.select("image_id", F.col("label").alias("other"), F.explode(touching).alias("label"))
        .where("label <> other")
        .groupBy("image_id", "label", "other")
        .agg(F.count(F.lit(1)).alias("contact"))
    )


# Order in which a line pixel looks for a neighbor to copy (fixed values: left,
# then clockwise).
THIN_ORDER = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def thin_round(present: np.ndarray, label: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """One round: line pixels (0) beside a region take a neighbor's label. The
    first row and column are never copied from when looking up or left."""
    region = present & (label != 0)
    beside = np.zeros_like(region)
    for dy, dx in CROSS:
        beside |= TI.shifted(region, dy, dx, False)
    out = label.copy()
    open_ = present & (label == 0) & beside
    for dy, dx in THIN_ORDER:
        allowed = np.ones_like(open_)
        if dx < 0:
            allowed &= (xs - 1 > 0)[None, :]
        if dy < 0:
            allowed &= (ys - 1 > 0)[:, None]
        near = TI.shifted(np.where(region, label, 0), dy, dx, 0)
        take = open_ & allowed & (near != 0)
        out[take] = near[take]
        open_ &= ~take
    return out


def thin_lines(
    labels: DataFrame, max_iter: int | None = None, rounds_per_pass: int = 8, tile: int = TI.TILE
) -> DataFrame:
    """Give line pixels (label 0) to neighboring regions, round by round until none changes, or
    ``max_iter`` rounds. A halo of ``rounds_per_pass`` pixels lets each pass over the data do that
    many rounds exactly."""
    done = 0
    labels = cut_lineage(labels.select(*PIXEL, "label"))
    zeros = F.count_if(F.col("label") == 0)
    left = labels.agg(zeros).first()[0]
    while left and (max_iter is None or done < max_iter):
        rounds = rounds_per_pass if max_iter is None else min(rounds_per_pass, max_iter - done)

        def grow(present, arrays, ys, xs, rounds=rounds):
            label = arrays["label"]
            for _ in range(rounds):
                label = thin_round(present, label, ys, xs)
            return {"label": label}

        before, labels = labels, cut_lineage(TI.stencil(labels, ("label",), rounds, grow, {"label": "int"}, tile))
        drop_written(before)
        done += rounds
        now = labels.agg(zeros).first()[0]
        if now == left:
            break
        left = now
    return labels


def fill_map(fills: DataFrame, pixels: DataFrame) -> DataFrame:
    """Label image of ordered fills (image_id, fill_id, y, x): later fills
    override, unfilled pixels are 0."""
    top = fills.groupBy(*PIXEL).agg(F.max("fill_id").alias("__f"))
    return pixels.select(*PIXEL).join(top, PIXEL, "left").select(
        *PIXEL, F.coalesce("__f", F.lit(0)).cast("int").alias("label")
    )


def mark_filled(mask: DataFrame, fills: DataFrame, value: str = "v") -> DataFrame:
    """Mask with filled pixels set to 0."""
    filled = fills.select(*PIXEL).distinct().withColumn("__hit", F.lit(True))
    return mask.join(filled, PIXEL, "left").select(
        *PIXEL, F.when(F.col("__hit"), 0).otherwise(F.col(value)).cast("int").alias(value)
    )


def color_regions(labels: DataFrame, seed: int, black_zero: bool = True) -> DataFrame:
    """Seeded random color of each label, for viewing."""
    byte = [(seeded_number(seed, F.lit(k), "label") % 255).cast("int") for k in range(3)]
    dark = (F.col("label") == 0) & F.lit(black_zero)
    return labels.select(
        *labels.columns, *[F.when(dark, 0).otherwise(b).alias(c) for b, c in zip(byte, "rgb")]
    )


# --- tiles ---------------------------------------------------------------------


def _label_many(tile: np.ndarray, ly: np.ndarray, lx: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Labels of the pixels of many tiles, numbered from 0 in each ``tile`` (numbers 0, 1, ...)."""
    h, w = int(ly.max()) + 1, int(lx.max()) + 1
    place, first, inverse = np.unique((tile * h + ly) * w + lx, return_index=True, return_inverse=True)
    tile, ly, lx, values = tile[first], ly[first], lx[first], values[first]
    links = []
    for inside, step in ((lx < w - 1, 1), (ly < h - 1, w)):
        a = np.flatnonzero(inside)
        b = np.minimum(np.searchsorted(place, place[a] + step), len(place) - 1)
        same = (place[b] == place[a] + step) & (values[a] == values[b]).astype(bool)
        links.append(np.stack([a[same], b[same]]))
    a, b = np.concatenate(links, axis=1)
    root = np.arange(len(place))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(short := root[root], root):
            root = short
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    own = root == np.arange(len(root))
    number = np.cumsum(own) - 1
    before = np.zeros(int(tile.max()) + 1, number.dtype)
    np.add.at(before, tile[own], 1)
    before = np.cumsum(before) - before
    return (number[root] - before[tile])[inverse].astype("int32")


def label_tiles(tiles: DataFrame, value: str = "v", task_rows: int = LABEL_ROWS) -> DataFrame:
    """Regions inside each tile of an overlapping mosaic, numbered within the
    tile by their first pixel. A task labels many tiles at once, ``task_rows`` pixels
    or a larger tile: a call per tile would cost more than its pixels."""
    keys = ["image_id", "ty", "tx"]

    def label(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        number = np.cumsum(starts) - 1
        places = (batch.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("ly", "lx"))
        labels = _label_many(number, *places, batch.column(value).to_pandas().to_numpy())
        return batch.append_column("label", pa.array(labels))

    def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < task_rows:
                continue
            joined = pa.concat_batches(kept)
            starts = _starts(joined, keys)
            last = int(np.flatnonzero(starts)[-1])
            if last:
                yield label(joined.slice(0, last), starts[:last])
            # A tile of more rows than that waits for its end.
            kept, rows = [joined.slice(last)], 0 if last == 0 else joined.num_rows - last
        if kept and sum(b.num_rows for b in kept):
            joined = pa.concat_batches(kept)
            yield label(joined, _starts(joined, keys))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema)
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(whole_tiles, f"{columns}, label int")


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in any of the keys."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = True
    for key in keys:
        code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= code[1:] != code[:-1]
    return out


def stitch(tiles: DataFrame, size: int = 512, overlap: float = 0.5) -> DataFrame:
    """One label image from labelled overlapping tiles. A region is identified
    by (tile, label), so labels of different tiles never collide."""
    tiles = cut_lineage(tiles)
    pairs = TI.border_pairs(tiles, size, overlap)

    def key(c: str) -> Column:
        return F.struct("image_id", f"{c}.ty", f"{c}.tx", f"{c}.label")

    links = cut_lineage(pairs.select(key("a").alias("src"), key("b").alias("dst")))
    merged = TI.merge_tiles(tiles, size, overlap)
    roots = components(links).select("node.*", F.struct("component.ty", "component.tx", "component.label").alias("__root"))
    own = F.struct("ty", "tx", "label")
    named = cut_lineage(
        merged.join(roots, ["image_id", "ty", "tx", "label"], "left").select(
            *PIXEL, F.coalesce("__root", own).alias("root")
        )
    )
    firsts = named.groupBy("image_id", "root").agg(
        F.min(F.struct("y", "x")).alias("f"), F.count(F.lit(1)).alias("__n")
    ).select("image_id", "root", "f.y", "f.x", "__n")
    numbered = SC.numbered(firsts, ["image_id"], ["y", "x"], SC.by_number("y", 64), "__pos").select(
        "image_id", "root", "__n", F.col("__pos").cast("int").alias("label")
    )
    return join_unique(named, numbered, ["image_id", "root"], "__n").select(*PIXEL, "label")


# --- boxes and differences ------------------------------------------------------


SMALL_BOX_SET = 4096
BOX = ["y1", "x1", "y2", "x2"]


def _merge_few(boxes: np.ndarray) -> np.ndarray:
    """Closure of overlapping boxes (rows y1, x1, y2, x2) of one image."""
    left, done = list(map(tuple, boxes.tolist())), []
    while left:
        box = left.pop()
        rest = np.array(left + done, dtype=boxes.dtype).reshape(-1, 4)
        hit = (rest[:, 0] <= box[2]) & (rest[:, 2] >= box[0]) & (rest[:, 1] <= box[3]) & (rest[:, 3] >= box[1])
        if not hit.any():
            done.append(box)
            continue
        touched = np.vstack([rest[hit], np.array([box])])
        union = (*touched[:, :2].min(axis=0).tolist(), *touched[:, 2:].max(axis=0).tolist())
        gone = set(map(tuple, rest[hit].tolist()))
        left = [b for b in left if b not in gone] + [union]
        done = [b for b in done if b not in gone]
    return np.array(done, dtype=boxes.dtype).reshape(-1, 4)


def merge_boxes(boxes: DataFrame, small_set: int = SMALL_BOX_SET) -> DataFrame:
    """Boxes (image_id, y1, x1, y2, x2) merged while they overlap or touch.

    Images with up to ``small_set`` boxes are merged in one task each; larger
    ones by links and connected components (``_merge_many``), with equal result.
    """
    distinct = boxes.select("image_id", *BOX).distinct()
    counts = distinct.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n"))
    large = cut_lineage(counts.where(F.col("__n") > small_set).select("image_id"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_merge_few(pdf[BOX].to_numpy()), columns=BOX)
        out.insert(0, "image_id", pdf["image_id"].iloc[0])
        return out

    if large.isEmpty():
        return distinct.groupBy("image_id").applyInPandas(merge, schema)
    small = distinct.join(large, "image_id", "left_anti").groupBy("image_id").applyInPandas(merge, schema)
    return small.unionByName(_merge_many(distinct.join(large, "image_id", "left_semi")))


def _merge_many(boxes: DataFrame) -> DataFrame:
    """Two boxes overlap iff one covers part of the top row of the other, so on
    each row that is some box's top, boxes sorted by x are linked to the one
    reaching farthest so far: a linear number of links, no pairs. Components of
    the links are replaced by their hulls until no hull overlaps another."""
    current = cut_lineage(boxes)
    while True:
        tops = current.select("image_id", F.col("y1").alias("row")).distinct()
        lines = current.withColumn("box", F.struct("image_id", *BOX)).select(
            "image_id", *BOX, "box", F.explode(F.sequence("y1", "y2")).alias("row")
        ).join(tops, ["image_id", "row"], "left_semi")
        chained = SC.scan(
            lines, ["image_id", "row"], ["x1", "x2", "y1", "y2"], SC.by_number("x1"),
            __far=SC.running_max(F.struct("x2", "box"), inclusive=False),
        )
        links = cut_lineage(
            chained.where("__far is not null and x1 <= __far.x2").select(F.col("box").alias("src"), F.col("__far.box").alias("dst"))
        )
        if links.isEmpty():
            return current
        named = components(links)
        flat = current.withColumn("node", F.struct("image_id", *BOX)).join(named, "node", "left")
        current = cut_lineage(
            flat.groupBy("image_id", F.coalesce("component", "node").alias("c"))
            .agg(F.min("y1").alias("y1"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.max("x2").alias("x2"))
            .drop("c")
            .distinct()
        )


def diff_regions(old: DataFrame, new: DataFrame, min_distance: int = 64, value: str = "v", tile: int = TI.TILE) -> DataFrame:
    """Boxes around changed places of an image: 8-connected changed pixels,
    grown by ``min_distance`` inside the image, merged when they overlap."""
    a = old.select(*PIXEL, F.col(value).alias("__a"))
    b = new.select(*PIXEL, F.col(value).alias("__b"))
    sizes = new.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    changed = a.join(b, PIXEL).where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*PIXEL, F.lit(1).alias("v"))
    found = label_regions(changed, "v", tile, diagonal=True).groupBy("image_id", "region_y", "region_x").agg(
        F.min("y").alias("t"), F.max("y").alias("b"), F.min("x").alias("l"), F.max("x").alias("r")
    )
    grown = join_lookup(found, sizes, ["image_id"], "inner").select(
        "image_id",
        F.greatest(F.col("t") - min_distance, F.lit(0)).alias("y1"),
        F.greatest(F.col("l") - min_distance, F.lit(0)).alias("x1"),
        F.least(F.col("b") + 1 + min_distance, F.col("h")).alias("y2"),
        F.least(F.col("r") + 1 + min_distance, F.col("w")).alias("x2"),
    )
    return merge_boxes(grown)


# --- points --------------------------------------------------------------------

OPEN, KEPT = 0, 1


def dedupe_points(points: DataFrame, distance: int = 3, order: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Greedy thinning: in ``order``, a point stays unless one that stays lies within
    ``distance``. Ties in ``order`` go by the other columns, so the order is total; of
    points at one place the first stays, of equal rows one.

    Whole-numbered points are walked tile by tile, with a halo. What depends on points beyond the
    halo stays open; rounds over the images that hold such points decide it. Other coordinates go
    by tables of neighbors. The result is that of the walk."""
    if any(points.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long") for c in "yx"):
        return _dedupe_by_pairs(points, distance, order)
    total = list(dict.fromkeys((*order, "y", "x", *points.columns)))
    halo = 4 * distance
    tile = TI.widened(TI.TILE, halo)
    width, columns = tile + 2 * halo, points.columns
    reach = np.arange(-distance, distance + 1)
    disc = reach[:, None] ** 2 + reach[None, :] ** 2 <= distance * distance

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = None
        for batch in batches:
            ids, tys, txs, ys, xs, states = (batch.column(c).to_pylist() for c in ("image_id", "__ty", "__tx", "y", "x", "__s"))
            at, out = [], []
            for i, (key, y, x, state) in enumerate(zip(zip(ids, tys, txs), ys, xs, states)):
                if key != view:
                    view = key
                    blocked, unsure = (np.zeros((width + 2 * distance, width + 2 * distance), bool) for _ in range(2))
                y, x = y - key[1] * tile + halo, x - key[2] * tile + halo
                if state == OPEN:
                    if blocked[y + distance, x + distance]:
                        continue
                    seen = distance <= y < width - distance and distance <= x < width - distance
                    state = KEPT if seen and not unsure[y + distance, x + distance] else OPEN
                mark = blocked if state == KEPT else unsure
                mark[y : y + 2 * distance + 1, x : x + 2 * distance + 1] |= disc
                if halo <= y < halo + tile and halo <= x < halo + tile:
                    at.append(i)
                    out.append(state)
            own = batch.select(columns).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.int32())], names=[*columns, "__s"])

    placed = F.col("y").isNotNull() & F.col("x").isNotNull()
    kept = [points.where(~placed).distinct()]
    state, before = points.where(placed).withColumn("__s", F.lit(OPEN)), None
    while True:
        views = state.withColumn("__ty", F.explode(TI._tile_span("y", halo, tile))).withColumn(
            "__tx", F.explode(TI._tile_span("x", halo, tile))
        )
        view_key = ["image_id", "__ty", "__tx"]
        dealt = views.repartition(*view_key).sortWithinPartitions(*view_key, *total)
        state = cut_lineage(dealt.mapInArrow(walk, state.schema))
        drop_written(before)
        open_ = cut_lineage(state.where(F.col("__s") == OPEN).select("image_id").distinct())
        done = state.where(F.col("__s") == KEPT)
        if open_.isEmpty():
            kept.append(done)
            break
        kept.append(cut_lineage(done.join(open_, "image_id", "left_anti")))
        before, state = state, state.join(open_, "image_id", "left_semi")
    return reduce(DataFrame.unionByName, [k.select(*points.columns) for k in kept])


def _dedupe_by_pairs(points: DataFrame, distance: float, order: tuple[str, ...]) -> DataFrame:
    """Every round keeps the points that no undecided earlier one blocks and drops what they
    block, over a neighbor table banded by cells."""
    cell = max(distance, 1)
    total = dict.fromkeys((*order, "y", "x", *points.columns))
    rows = cut_lineage(points.distinct().withColumn("__o", F.struct(*total)))
    here = rows.select("image_id", "y", "x", "__o", F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"))
    around = here.withColumn("cy", F.explode(F.array(*[F.col("cy") + d for d in (-1, 0, 1)]))).withColumn(
        "cx", F.explode(F.array(*[F.col("cx") + d for d in (-1, 0, 1)]))
    )
    other = here.withColumnsRenamed({"y": "oy", "x": "ox", "__o": "first"})
    gap = (F.col("y") - F.col("oy")) ** 2 + (F.col("x") - F.col("ox")) ** 2
    near = cut_lineage(
        around.join(other, ["image_id", "cy", "cx"])
        .where((F.col("first") < F.col("__o")) & (gap <= distance * distance))
        .select("image_id", "first", F.col("__o").alias("later"))
    )
    waiting, kept = rows.select("image_id", "__o"), None
    while True:
        blocked = near.select("image_id", F.col("later").alias("__o")).distinct()
        now = cut_lineage(waiting.join(blocked, ["image_id", "__o"], "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        dropped = near.join(now.withColumnRenamed("__o", "first"), ["image_id", "first"], "left_semi").select(
            "image_id", F.col("later").alias("__o")
        ).distinct()
        gone = cut_lineage(now.unionByName(dropped))
        waiting = cut_lineage(waiting.join(gone, ["image_id", "__o"], "left_anti"))
        if waiting.isEmpty():
            break
        near = cut_lineage(
            near.join(gone.withColumnRenamed("__o", "first"), ["image_id", "first"], "left_anti").join(
                gone.withColumnRenamed("__o", "later"), ["image_id", "later"], "left_anti"
            )
        )
    return rows.join(kept, ["image_id", "__o"], "left_semi").drop("__o").select(*points.columns)


def spaced_sample(points: DataFrame, num_points: int, distance: int, seed: int) -> DataFrame:
    """Up to ``num_points`` random points per image, pairwise farther apart than
    ``distance``; the order of choice is a seeded hash."""
    from pyspark.sql import Window

    mixed = points.withColumn("__h", seeded_text(seed, "image_id", "y", "x"))
    spaced = dedupe_points(mixed, distance, ("__h",)) if distance > 0 else mixed
    counts = points.groupBy("image_id").agg((F.count(F.lit(1)) <= num_points).alias("__all"))
    # Few points need no spacing; a row_number limit is cut below the shuffle.
    every = mixed.join(counts.where("__all"), "image_id", "left_semi")
    some = spaced.join(counts.where("not __all"), "image_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("__h", "y", "x"))
    picked = some.withColumn("__rank", rank).where(F.col("__rank") <= num_points).drop("__rank")
    return every.unionByName(picked).drop("__h")


# --- segments lost in a resize ---------------------------------------------------


def restore_lost_segments(original: DataFrame, resized: DataFrame, sizes: DataFrame) -> DataFrame:
    """Put labels that vanished in a resize back as one pixel at their scaled
    center of mass; where two fall on one pixel the larger label shows.
    ``sizes``: image_id, h, w (original), out_h, out_w (resized)."""
    present = resized.where("label <> -100").select("image_id", "label").distinct()
    centers = (
        original.groupBy("image_id", "label")
        .agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
        .join(present, ["image_id", "label"], "left_anti")
        .join(sizes, "image_id")
        .select(
            "image_id",
            F.floor(F.col("my") * F.col("out_h") / F.col("h")).cast("int").alias("y"),
            F.floor(F.col("mx") * F.col("out_w") / F.col("w")).cast("int").alias("x"),
            "label",
        )
        .groupBy(*PIXEL)
        .agg(F.max("label").alias("__lost"))
    )
    return resized.join(centers, PIXEL, "left").select(*PIXEL, F.coalesce("__lost", "label").alias("label"))


def id_offset_map(original: DataFrame, resized: DataFrame) -> DataFrame:
    """New consecutive id of each original label, null for labels that are
    missing from the resized image."""
    present = resized.where("label <> -100").select("image_id", "label").distinct().withColumn("__here", F.lit(1))
    ids = original.select("image_id", "label").distinct().join(present, ["image_id", "label"], "left")
    counted = SC.scan(
        ids, ["image_id"], ["label"], SC.by_number("label"), __before=SC.running_sum(F.coalesce("__here", F.lit(0)), inclusive=False)
    )
    return counted.select("image_id", "label", F.when(F.col("__here") == 1, F.col("__before")).cast("int").alias("new_id"))


def apply_id_map(labels: DataFrame, id_map: DataFrame) -> DataFrame:
    """Relabel by an id map; pixels without a new id become -100."""
    return join_lookup(labels, id_map, ["image_id", "label"]).select(
        *PIXEL, F.coalesce("new_id", F.lit(-100)).alias("label")
    )
