"""Pixel operators: binarization, morphology, boxes, resizing, distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flatcel.operators import scan as SC
from flatcel.operators.skew import join_lookup, join_unique, with_group_facts
from flatcel.operators.tiles import TILE, shifted, stencil
from flatcel.session import cut_lineage, drop_written


def alpha_stats(pixels: DataFrame) -> DataFrame:
    """Per image: is any pixel see-through, is every pixel fully see-through."""
    return pixels.groupBy("image_id").agg(
        F.max(F.col("a") < 255).alias("has_transparent"), (F.max("a") == 0).alias("is_empty")
    )


def binarize_manual(pixels: DataFrame, threshold: int) -> DataFrame:
    """255 where the inverted alpha exceeds the threshold, else 0."""
    if not 0 <= threshold < 255:
        raise ValueError("threshold must be between 0 and 254")
    return pixels.select(
        "image_id", "y", "x", F.when(255 - F.col("a") > threshold, 255).otherwise(0).alias("v")
    )


def otsu(pixels: DataFrame) -> DataFrame:
    """Per image the threshold of the inverted alpha that maximizes the variance
    between both sides. Works on the histogram: 256 rows per image at most."""
    hist = pixels.groupBy("image_id", (255 - F.col("a")).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    image = Window.partitionBy("image_id")
    upto = image.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select(
        "image_id",
        "i",
        F.sum("n").over(upto).alias("n1"),
        F.sum(F.col("n") * F.col("i")).over(upto).alias("s1"),
        F.sum("n").over(image).alias("n"),
        F.sum(F.col("n") * F.col("i")).over(image).alias("s"),
    )
    n2 = F.col("n") - F.col("n1")
    gap = F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / n2
    between = F.when(n2 > 0, F.col("n1").cast("double") * n2 * gap * gap)
    return cum.groupBy("image_id").agg(
        F.coalesce(F.max_by("i", F.struct(between, -F.col("i"))), F.lit(0)).alias("threshold")
    )


def binarize_otsu(pixels: DataFrame) -> DataFrame:
    sizes = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n"))
    limits = otsu(pixels).join(sizes, "image_id")
    return join_unique(pixels, limits, ["image_id"], "__n").select(
        "image_id", "y", "x", F.when(255 - F.col("a") > F.col("threshold"), 255).otherwise(0).alias("v")
    )


def _replicated(present: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Fill the outside of a rectangular image with its nearest edge pixel."""
    rows, cols = np.nonzero(present.any(axis=1))[0], np.nonzero(present.any(axis=0))[0]
    yy = np.clip(np.arange(values.shape[0]), rows[0], rows[-1])
    xx = np.clip(np.arange(values.shape[1]), cols[0], cols[-1])
    return values[np.ix_(yy, xx)]


def binarize_adaptive(
    pixels: DataFrame, neighborhood: int = 51, constant: int = 2, method: str = "mean", tile: int = TILE
) -> DataFrame:
    """Background (255) where the inverted alpha is above its local mean minus
    ``constant``, line (0) elsewhere. The mean is a box or a Gaussian, edges
    repeat the border pixel, halves round to even."""
    radius = neighborhood // 2
    if method == "mean":
        weights = np.full(neighborhood, 1.0)
    else:
        sigma = 0.3 * ((neighborhood - 1) * 0.5 - 1) + 0.8
        weights = np.exp(-((np.arange(neighborhood) - radius) ** 2) / (2 * sigma * sigma))
        weights = weights / weights.sum()
    scale = float(neighborhood * neighborhood) if method == "mean" else 1.0
    limit = -math.ceil(constant)

    def along(wide: np.ndarray) -> np.ndarray:
        """Weighted sums of the neighborhood in each column; what reaches out of the tile is not used."""
        padded = np.pad(wide, ((radius + 1, radius), (0, 0)))
        if method == "mean":  # differences of prefix sums: whatever the radius, two steps a pixel
            total = np.cumsum(padded, axis=0)
            return total[2 * radius + 1 :] - total[: -2 * radius - 1]
        return sum(w * padded[1 + i : 1 + i + len(wide)] for i, w in enumerate(weights))

    def local_mean(present, arrays, ys, xs):
        im = 255 - arrays["a"].astype("int64")
        wide = _replicated(present, im).astype(float)
        wide = along(along(wide).T).T
        mean = np.rint(wide / scale)
        return {"v": np.where(im - mean > limit, 255, 0).astype("int32")}

    return stencil(pixels, ("a",), radius, local_mean, {"v": "int"}, tile)


def ball(radius: int) -> list[tuple[int, int]]:
    """Offsets of a filled circle: per row the half width rounds to even."""
    if radius == 0:
        return [(0, 0)]
    offsets = []
    for dy in range(-radius, radius + 1):
        half = round(math.sqrt(radius * radius - dy * dy))
        offsets += [(dy, dx) for dx in range(-half, half + 1)]
    return offsets


CROSS = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _reach(kernel: list[tuple[int, int]]) -> int:
    return max(max(abs(dy), abs(dx)) for dy, dx in kernel)


def extreme(values: np.ndarray, present: np.ndarray, kernel: list[tuple[int, int]], largest: bool) -> np.ndarray:
    """Largest or smallest value under the kernel, outside pixels ignored."""
    info = np.iinfo(values.dtype)
    fill = info.min if largest else info.max
    known = np.where(present, values, fill)
    pick = np.maximum if largest else np.minimum
    out = np.full_like(values, fill)
    h, w = values.shape
    for dy, dx in kernel:
        if abs(dy) < h and abs(dx) < w:
            own = out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            pick(own, known[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)], out=own)
    return out


def erode(mask: DataFrame, kernel: list[tuple[int, int]], value: str = "v", tile: int = TILE) -> DataFrame:
    def smallest(present, arrays, ys, xs):
        return {value: extreme(arrays[value].astype("int32"), present, kernel, False)}

    return stencil(mask, (value,), _reach(kernel), smallest, {value: "int"}, tile)


def dilate(mask: DataFrame, kernel: list[tuple[int, int]], value: str = "v", tile: int = TILE) -> DataFrame:
    def highest(present, arrays, ys, xs):
        return {value: extreme(arrays[value].astype("int32"), present, kernel, True)}

    return stencil(mask, (value,), _reach(kernel), highest, {value: "int"}, tile)


def content_bbox(pixels: DataFrame, padding: int = 10) -> DataFrame:
    """Box around the visible pixels of each image, as crop limits
    [top, bottom) and [left, right).

    A side farther than ``padding`` from the image edge moves out by padding
    plus one, which may pass the edge; images without content keep their full
    size.
    """
    seen = F.col("a") > 0
    box = pixels.groupBy("image_id").agg(
        (F.max("y") + 1).alias("h"),
        (F.max("x") + 1).alias("w"),
        F.min(F.when(seen, F.col("y"))).alias("t"),
        (F.max(F.when(seen, F.col("y"))) + 1).alias("b"),
        F.min(F.when(seen, F.col("x"))).alias("l"),
        (F.max(F.when(seen, F.col("x"))) + 1).alias("r"),
    )
    grow = 1 + padding

    def low(c: str) -> Column:
        return F.coalesce(F.when(F.col(c) > padding, F.col(c) - grow).otherwise(F.col(c)), F.lit(0))

    def high(c: str, size: str) -> Column:
        return F.coalesce(F.when(F.col(c) < F.col(size) - padding, F.col(c) + grow).otherwise(F.col(c)), F.col(size))

    return box.select(
        "image_id", low("t").alias("top"), high("b", "h").alias("bottom"), low("l").alias("left"),
        high("r", "w").alias("right"), "h", "w",
    )


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside the box of their image, moved to its corner."""
    area = (F.col("h") * F.col("w")).alias("__n")
    limits = boxes.select("image_id", "top", "bottom", "left", "right", area)
    return (
        join_unique(pixels, limits, ["image_id"], "__n")
        .where("y >= top and y < bottom and x >= left and x < right")
        .withColumns({"y": F.col("y") - F.col("top"), "x": F.col("x") - F.col("left")})
        .drop("top", "bottom", "left", "right", "__n")
    )


def _grid(sizes: DataFrame, h: str = "h", w: str = "w") -> DataFrame:
    """All pixel positions of images of the given sizes; rows are dealt out
    before they unfold into columns. Spark guesses the size before that, and would
    send all pixels to the driver for a broadcast; hence the hint for the joins."""
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col(h) - 1)))
    pixels = rows.repartition("image_id", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.col(w) - 1)))
    return pixels.hint("merge")


def uncrop(cropped: DataFrame, boxes: DataFrame) -> DataFrame:
    """Put cropped images back in place; the outside repeats the nearest pixel.
    Limits outside of the image are cut to it first."""
    box = boxes.select(
        "image_id",
        "h",
        "w",
        F.greatest("top", F.lit(0)).alias("__t"),
        (F.least("bottom", "h") - 1).alias("__b"),
        F.greatest("left", F.lit(0)).alias("__l"),
        (F.least("right", "w") - 1).alias("__r"),
        F.col("top").alias("__top"),
        F.col("left").alias("__left"),
    )
    target = _grid(box).select(
        "image_id",
        "y",
        "x",
        (F.greatest("__t", F.least("y", "__b")) - F.col("__top")).alias("__sy"),
        (F.greatest("__l", F.least("x", "__r")) - F.col("__left")).alias("__sx"),
    )
    source = cropped.withColumnsRenamed({"y": "__sy", "x": "__sx"})
    return target.join(source, ["image_id", "__sy", "__sx"]).drop("__sy", "__sx")


def fit_size(h: Column, w: Column, target_w: int, target_h: int) -> tuple[Column, Column]:
    """Largest size of the same proportions inside the target (fractions cut)."""
    ratio = w / h
    wide = ratio > F.lit(target_w / target_h)
    out_w = F.when(wide, F.lit(target_w)).otherwise(F.floor(F.lit(target_h) * ratio)).cast("int")
    out_h = F.when(wide, F.floor(F.lit(target_w) / ratio)).otherwise(F.lit(target_h)).cast("int")
    return out_h, out_w


def source_index(k: Column, in_size: Column, out_size: Column) -> Column:
    """Pixel that the nearest-neighbor resize reads for output position k."""
    center = (k + 0.5) * (in_size.cast("double") / out_size) - 0.5
    return F.greatest(F.lit(0), F.least(F.floor(center + 0.5), in_size - 1)).cast("int")


def resize_nearest(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Resize images; ``sizes``: image_id, h, w (now), out_h, out_w (wanted)."""
    target = _grid(sizes, "out_h", "out_w").select(
        "image_id",
        "y",
        "x",
        source_index(F.col("y"), F.col("h"), F.col("out_h")).alias("__sy"),
        source_index(F.col("x"), F.col("w"), F.col("out_w")).alias("__sx"),
    )
    source = pixels.withColumnsRenamed({"y": "__sy", "x": "__sx"})
    return target.join(source, ["image_id", "__sy", "__sx"]).drop("__sy", "__sx")


def pad_center(pixels: DataFrame, sizes: DataFrame, target_w: int, target_h: int, value: int, column: str) -> DataFrame:
    """Center images (``sizes``: image_id, h, w) on a larger canvas."""
    top, left = F.floor((F.lit(target_h) - F.col("h")) / 2), F.floor((F.lit(target_w) - F.col("w")) / 2)
    canvas = _grid(sizes.withColumns({"__h": F.lit(target_h), "__w": F.lit(target_w)}), "__h", "__w").select(
        "image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), (F.col("y") - top).cast("int").alias("y"),
        (F.col("x") - left).cast("int").alias("x"),
    )
    return canvas.join(pixels.select("image_id", "y", "x", column), ["image_id", "y", "x"], "left").select(
        "image_id", F.col("cy").alias("y"), F.col("cx").alias("x"), F.coalesce(column, F.lit(value)).alias(column)
    )


def _fold_rows(g: np.ndarray) -> np.ndarray:
    """min over j of (x - j)^2 + g[row, j] for every row and x.

    The best j never falls as x grows, so the columns are settled from coarse to fine:
    each looks only between the best j of its settled neighbors, all rows at once.
    Work is width x log(width) a row. Infinite entries take no part."""
    out = np.full(g.shape, np.inf)
    rows = np.nonzero(np.isfinite(g).any(axis=1))[0]
    if len(rows) == 0:
        return out
    width = g.shape[1]
    best = np.zeros((len(rows), width), dtype=np.int64)
    step = 1 << (width - 1).bit_length()
    while step:
        x = np.arange(step - 1, width, 2 * step)
        if len(x):
            low = np.where(x >= step, best[:, np.maximum(x - step, 0)], 0).ravel()
            high = np.where(x + step < width, best[:, np.minimum(x + step, width - 1)], width - 1).ravel()
            n = high - low + 1
            starts = np.cumsum(n) - n
            j = np.arange(n.sum()) - np.repeat(starts - low, n)
            cost = g[np.repeat(np.repeat(rows, len(x)), n), j] + (np.repeat(np.tile(x, len(rows)), n) - j) ** 2
            least = np.minimum.reduceat(cost, starts)
            at = np.nonzero(cost == np.repeat(least, n))[0]
            best[:, x] = j[at[np.searchsorted(at, starts)]].reshape(len(rows), -1)
            out[np.ix_(rows, x)] = least.reshape(len(rows), -1)
        step //= 2
    return out


ROWS_PER_STRIP = 32


def _distances(mask: DataFrame, **hits: Column) -> DataFrame:
    """(image_id, y, x, one column per name): distance to the nearest pixel where the condition of
    that name holds, null in images without one.

    Columns first, as one scan for the nearest hits above and below; then strips of image
    rows are folded with their parabolas, for all names in one pass."""
    scans = {}
    for name, hit in hits.items():
        at = F.when(hit, F.col("y"))
        scans |= {f"__up_{name}": SC.last_value(at), f"__down_{name}": SC.next_value(at)}
    columns = SC.scan(mask, ["image_id", "x"], ["y"], SC.by_number("y"), **scans)
    nearest = [
        F.least(F.col("y") - F.col(f"__up_{n}"), F.col(f"__down_{n}") - F.col("y")).cast("double").alias(n) for n in hits
    ]
    image_type, names = mask.schema["image_id"].dataType.simpleString(), list(hits)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y, x = y - y.min(), x - x.min()
        out = pdf[["image_id", "y", "x"]].copy()
        for name in names:
            grid = np.full((y.max() + 1, x.max() + 1), np.inf)
            grid[y, x] = np.where(pdf[name].isna(), np.inf, pdf[name] ** 2)
            squared = _fold_rows(grid)[y, x]
            out[name] = np.where(np.isfinite(squared), np.sqrt(squared), np.nan)
        return out

    # A few rows per call: single rows would drown in the overhead of the calls.
    strips = columns.select("image_id", "y", "x", *nearest).groupBy("image_id", F.floor(F.col("y") / ROWS_PER_STRIP))
    folded = strips.applyInPandas(fold, f"image_id {image_type}, y int, x int, " + ", ".join(f"{n} double" for n in hits))
    return folded.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in hits})


def distance_transform(mask: DataFrame, value: str = "v") -> DataFrame:
    """Distance of every pixel to the nearest pixel whose ``value`` is 0. Images without such a
    pixel get null."""
    return _distances(mask.select("image_id", "y", "x", value), dist=F.col(value) == 0)


def signed_distance(mask: DataFrame, value: str = "v") -> DataFrame:
    """Inside minus outside distance, stretched to 0..1 per image. ``value`` is
    1 inside and 0 outside."""
    v = F.col(value)
    sides = _distances(mask.select("image_id", "y", "x", value), __in=v == 0, __out=v == 1)
    both = cut_lineage(sides.select("image_id", "y", "x", (F.col("__in") - F.col("__out")).alias("sdf")))
    return with_group_facts(both, ["image_id"], {"__lo": F.min("sdf"), "__hi": F.max("sdf")}).select(
        "image_id", "y", "x",
        F.when(F.col("__hi") > F.col("__lo"), (F.col("sdf") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).alias("sdf"),
    )


def combine_boundary(udf: DataFrame, mask: DataFrame, strength: float, max_dist: float = 10.0) -> DataFrame:
    """Line where the predicted distance is below ``strength`` or the binarized
    image (255 background) shows a line."""
    return udf.join(mask, ["image_id", "y", "x"]).select(
        "image_id",
        "y",
        "x",
        F.greatest(
            F.when(F.col("udf") * max_dist < strength, 1.0).otherwise(0.0), 1.0 - F.col("v") / 255.0
        ).alias("boundary"),
    )


def combine_edges(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Blend a binarized line image (``binary``) with color edges (``edges``)
    inside a line mask (``mask``): only full blends stay; edges on the border of
    the mask are left out of ``masked_edges``."""

    def inner(present, arrays, ys, xs):
        return {"inner": extreme(arrays["mask"].astype("int32"), present, SQUARE, False)}

    eroded = stencil(pixels, ("mask",), 1, inner, {"inner": "int"}, tile)
    blend = F.least(F.lit(255), F.bround(F.col("binary") * 0.8 + F.col("edges"), 0).cast("int"))
    return pixels.join(eroded, ["image_id", "y", "x"]).select(
        "image_id",
        "y",
        "x",
        F.when((F.col("mask") != 0) & (blend == 255), 255).otherwise(0).alias("combined"),
        F.when(F.col("inner") != 0, F.col("edges")).otherwise(0).alias("masked_edges"),
    )


# Farthest colors of a project that one round looks at.
CANDIDATES = 4096


def quantize_colors(pixels: DataFrame, colors: int = 256, key: str = "project_id") -> DataFrame:
    """Reduce the colors of a sequence to ``colors``, alpha kept.

    Starts from the most frequent color and keeps adding the color farthest from those chosen (ties:
    smaller RGB), then maps each color to its nearest chosen one (ties: the one chosen first).

    The table of distinct colors with their running distance stays spread over all tasks. A round
    takes the CANDIDATES farthest colors of each project and chooses among them while the next choice
    is still farther than any color left out can be (distances only shrink), so a round makes many
    choices, and its result is that of choosing one by one. Only chosen colors, at most ``colors`` a
    project, go back to the table.
    """
    kind = pixels.schema[key].dataType.simpleString()
    limit = CANDIDATES
    rgb = F.struct("r", "g", "b")
    table = pixels.groupBy(key, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    state = cut_lineage(table.withColumn("gap", F.lit(1 << 40).cast("long")))
    frequent = F.max_by(rgb, F.struct(F.col("n"), -F.col("r"), -F.col("g"), -F.col("b")))
    chosen = cut_lineage(state.groupBy(key).agg(F.array(frequent).alias("chosen")))
    fresh = chosen
    farthest = Window.partitionBy(key).orderBy(F.desc("gap"), "r", "g", "b")

    def choose(candidates: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        candidates = candidates.sort_values(["gap", "r", "g", "b"], ascending=[False, True, True, True])
        points = candidates[["r", "g", "b"]].to_numpy("int64")
        gap = candidates["gap"].to_numpy("int64").copy()
        room = colors - int(had["size"].iloc[0]) if len(had) and len(gap) else 0
        # One number that sorts like (distance, smaller color).
        tie = (1 << 24) - 1 - (points << np.array([16, 8, 0])).sum(axis=1)
        least = (gap[-1] << 24) + tie[-1] if len(gap) == limit else 0
        picked = []
        while room > len(picked):
            best = int(((gap << 24) + tie).argmax())
            if gap[best] == 0 or (gap[best] << 24) + tie[best] < least:
                break
            picked.append(best)
            gap = np.minimum(gap, ((points - points[best]) ** 2).sum(axis=1))
        return candidates.iloc[picked][[key, "r", "g", "b"]].assign(i=np.arange(len(picked), dtype="int32"))

    def distance(c: Column) -> Column:
        return sum((F.col(n).cast("long") - c[n]) ** 2 for n in "rgb").cast("long")

    while True:
        near = F.array_min(F.transform("chosen", distance))
        moved = join_lookup(state, fresh, [key], null_safe=True)
        before, state = state, cut_lineage(
            moved.select(key, "r", "g", "b", F.coalesce(F.least("gap", near), F.col("gap")).alias("gap"))
        )
        drop_written(before)
        top = state.where("gap > 0").withColumn("__r", F.row_number().over(farthest)).where(F.col("__r") <= limit)
        sizes = chosen.select(F.col(key).alias("__key"), F.size("chosen").alias("size"))
        picks = top.drop("__r").groupBy(key).cogroup(sizes.groupBy("__key")).applyInPandas(
            choose, f"{key} {kind}, r int, g int, b int, i int"
        )
        in_order = F.array_sort(F.collect_list(F.struct("i", rgb.alias("c"))))
        fresh = cut_lineage(picks.groupBy(key).agg(F.transform(in_order, lambda p: p["c"]).alias("chosen")))
        if fresh.isEmpty():
            break
        added = fresh.select(F.col(key).alias("__key"), F.col("chosen").alias("__more"))
        both = chosen.join(added, F.col(key).eqNullSafe(F.col("__key")), "left")
        more = F.coalesce("__more", F.array().cast("array<struct<r: int, g: int, b: int>>"))
        before, chosen = chosen, cut_lineage(both.select(key, F.concat("chosen", more).alias("chosen")))
        drop_written(before)
    # Position in the list settles ties for the color chosen first.
    nearest = F.array_min(F.transform("chosen", lambda c, i: F.struct(distance(c).alias("d"), i.alias("i"), c.alias("c"))))
    mapping = join_lookup(state.drop("gap"), chosen, [key], null_safe=True).select(
        key, "r", "g", "b", *[nearest["c"][c].alias(f"q{c}") for c in "rgb"]
    )
    return join_lookup(pixels, mapping, [key, "r", "g", "b"], "inner", null_safe=True).select(
        *[c for c in pixels.columns if c not in "rgb"], *[F.col(f"q{c}").alias(c) for c in "rgb"]
    )


# --- skeleton key points -------------------------------------------------------

FLAT_COS = 0.866  # cosine of 30 degrees: straighter than this is no corner


def _bend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of vectors enclose between 30 and 150 degrees; a zero vector encloses nothing."""
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1).astype(float))
    return np.abs((a * b).sum(1)) < FLAT_COS * size


def _corners(line: np.ndarray, ys: np.ndarray, xs: np.ndarray, steps: int = 4) -> np.ndarray:
    """Which of the pixels with two line neighbors bend, both right there and a few steps on.
    All pixels follow their two arms at once, one array operation a step."""
    ways = np.array([w for w in SQUARE if w != (0, 0)])
    start = np.stack([ys, xs], axis=1)
    rows = np.arange(len(start))

    def open_ways(at: np.ndarray) -> np.ndarray:
        return line[at[:, :1] + ways[:, 0], at[:, 1:] + ways[:, 1]]

    both = np.argsort(~open_ways(start), axis=1, kind="stable")
    near, far = [], []
    for side in (0, 1):
        arm = ways[both[:, side]]
        behind, here = start, start + arm
        for _ in range(steps):
            ahead = here[:, None] + ways
            free = open_ways(here) & (ahead != behind[:, None]).any(2)
            moves = free.any(1)[:, None]
            behind, here = np.where(moves, here, behind), np.where(moves, ahead[rows, free.argmax(1)], here)
        near.append(arm)
        far.append(here - start - arm)
    return _bend(*near) & _bend(*far)


def skeleton_points(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Every line pixel (v > 0) with its neighbor count and the flags
    ``is_end`` (one neighbor), ``is_junction`` (three to six), ``is_opened``
    (junction mask after opening with a 2x2 square) and ``is_corner``."""

    def look(present, arrays, ys, xs):
        line = present & (arrays["v"] > 0)
        count = sum(shifted(line.astype("int32"), dy, dx, 0) for dy, dx in SQUARE if dy or dx)
        junction = line & (count >= 3) & (count <= 6)
        # Both halves of the opening look up and left, as an even kernel does.
        corner4 = [(-1, -1), (-1, 0), (0, -1), (0, 0)]
        worn = extreme(junction.astype("int32"), present, corner4, False)
        opened = extreme(worn, present, corner4, True) > 0
        corner = np.zeros_like(line)
        edge = 6
        ry, rx = np.nonzero(line & (count == 2))
        inside = (ry >= edge) & (rx >= edge) & (ry < line.shape[0] - edge) & (rx < line.shape[1] - edge)
        ry, rx = ry[inside], rx[inside]
        corner[ry, rx] = _corners(line, ry, rx)
        return {
            "line": line, "neighbors": count.astype("int32"), "is_end": line & (count == 1),
            "is_junction": junction, "is_opened": opened, "is_corner": corner,
        }

    flags = {n: "boolean" for n in ("is_end", "is_junction", "is_opened", "is_corner")}
    return stencil(mask, ("v",), 6, look, {"line": "boolean", "neighbors": "int", **flags}, tile)


def neighbor_count(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Number of line pixels among the eight neighbors (in the image)."""

    def look(present, arrays, ys, xs):
        line = present & (arrays["v"] > 0)
        count = sum(shifted(line.astype("int32"), dy, dx, 0) for dy, dx in SQUARE if dy or dx)
        return {"line": line, "neighbors": count.astype("int32")}

    return stencil(mask, ("v",), 1, look, {"line": "boolean", "neighbors": "int"}, tile).select(
        "image_id", "y", "x", "line", "neighbors"
    )


def keypoints(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """End, junction and corner points. The opened junctions are used where
    they keep more than 30% of the junction pixels of an image."""
    seen = F.col("is_end") | F.col("is_junction") | F.col("is_opened") | F.col("is_corner")
    points = cut_lineage(skeleton_points(mask, tile).where(seen))
    clean = F.count_if("is_opened") > F.count_if("is_junction") * 0.3
    kinds = F.array_compact(
        F.array(
            F.when(F.col("is_end"), F.lit("endpoint")),
            F.when(F.when(F.col("__clean"), F.col("is_opened")).otherwise(F.col("is_junction")), F.lit("junction")),
            F.when(F.col("is_corner"), F.lit("corner")),
        )
    )
    return with_group_facts(points, ["image_id"], {"__clean": clean}).select(
        "image_id", "y", "x", F.explode(kinds).alias("kind")
    )


