"""Colors of segments: dominant color, statistics, palettes, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.functions.color import (
    BLACK_DENSE,
    NULL_COLOR,
    TRANSPARENT_DENSE,
    dense_to_rgba,
    rgba_to_dense,
)
from flatcel.operators.scan import BUCKET_ROWS, by_number, numbered
from flatcel.operators.skew import join_lookup, join_unique

PEAKINESS_THRESHOLD = 0.49
RGB = 2**24  # number of colors without alpha


def peakiness(counts: Column) -> Column:
    """Kurtosis of a color histogram; null when all counts are equal."""
    return F.kurtosis(counts) + F.lit(3.0)


def segment_colors(
    pixels: DataFrame,
    keys: tuple[str, ...] = ("frame_id", "seg_id"),
    threshold: float = PEAKINESS_THRESHOLD,
) -> DataFrame:
    """Dominant color of every segment.

    ``pixels`` holds one row per pixel: the keys, ``r g b a`` and the booleans
    ``is_line`` (covered by the binarized line) and ``is_black`` (pure black in
    the line layer). The first aggregation is by color as well, so the giant
    background segment shrinks to its few colors inside the map tasks and never
    travels as pixels.
    """
    by_color = pixels.groupBy(*keys, "r", "g", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("is_line")).alias("n_open"),
        F.count_if(~F.col("is_line") & (F.col("a") == 0)).alias("n_clear"),
        F.count_if(~F.col("is_black")).alias("n_not_black"),
        F.count_if(~F.col("is_line") & (F.col("a") != 0)).alias("n_vote"),
    )
    votes = F.when(F.col("n_vote") > 0, F.col("n_vote"))
    color_rank = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    stats = by_color.groupBy(*keys).agg(
        F.sum("n").alias("num_pixels"),
        F.sum("n_open").alias("open"),
        F.sum("n_clear").alias("clear"),
        F.sum("n_not_black").alias("not_black"),
        F.count(votes).alias("colors"),
        peakiness(votes).alias("peak"),
        # Count and color in one number (counts stay below 2^39), because a
        # maximum of numbers can be hash-aggregated and one of structs cannot.
        F.max(votes * RGB + (RGB - 1 - color_rank)).alias("top"),
    )
    rank = RGB - 1 - F.col("top").bitwiseAND(F.lit(RGB - 1))
    dominant = rgba_to_dense(
        F.shiftright(rank, 16),
        F.shiftright(rank, 8).bitwiseAND(F.lit(255)),
        rank.bitwiseAND(F.lit(255)),
        F.lit(255),
    )
    score = F.when(F.col("colors") > 1, F.col("peak") / F.col("colors"))
    accepted = (F.col("colors") == 1) | F.coalesce(score >= threshold, F.lit(False))
    status = (
        F.when(F.col("open") == 0, "over_thresholded")
        .when(F.col("clear") > F.col("open") * 0.5, "transparent")
        .when(F.col("not_black") == 0, "black")
        .when(accepted, "normal")
        .otherwise("multi_color")
    )
    color = (
        F.when(F.col("status") == "transparent", F.lit(TRANSPARENT_DENSE))
        .when(F.col("status") == "black", F.lit(BLACK_DENSE))
        .when(F.col("status") == "normal", dominant)
        .otherwise(F.lit(NULL_COLOR))
        .cast("bigint")
    )
    voted = F.col("status").isin("normal", "multi_color")
    return (
        stats.withColumn("status", status)
        .withColumn("color", color)
        .withColumn("peakiness", F.when(voted, score))
        .select(*keys, "color", "status", "num_pixels", "peakiness")
    )


def segment_stats(segments: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Segments per frame, by status."""
    named = {
        "num_multi_color_segs": "multi_color",
        "num_over_thresholded_segs": "over_thresholded",
        "num_transparent_segs": "transparent",
        "num_black_segs": "black",
    }
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_total_segs"),
        *[F.count_if(F.col("status") == s).alias(n) for n, s in named.items()],
    )


def drop_empty_keyframes(stats: DataFrame) -> DataFrame:
    """Frames that show more than one segment."""
    return stats.where(F.col("num_total_segs") > 1)


def build_palette(segments: DataFrame) -> DataFrame:
    """Distinct colors of a project, numbered by first appearance.

    ``segments``: project_id, frame_idx, seg_id, color. The null color takes a
    slot of the list like any other, though no segment will point at it.
    """
    firsts = segments.groupBy("project_id", "color").agg(
        F.min(F.struct("frame_idx", "seg_id")).alias("first")
    ).select("project_id", "color", "first.frame_idx", "first.seg_id")
    return numbered(
        firsts, ["project_id"], ["frame_idx", "seg_id"], by_number("frame_idx"), "color_id"
    ).select("project_id", F.col("color_id").cast("int").alias("color_id"), "color")


def frame_color_ids(segments: DataFrame, palette: DataFrame) -> DataFrame:
    """Palette index of every segment; null-colored segments stay -100."""
    return join_lookup(segments, palette, ["project_id", "color"], "inner").select(
        "project_id",
        "frame_idx",
        "seg_id",
        F.when(F.col("color") == NULL_COLOR, F.lit(NULL_COLOR))
        .otherwise(F.col("color_id"))
        .alias("color_id"),
    )


def build_palette_unique(segments: DataFrame) -> DataFrame:
    """One palette slot per segment; the id stored in the frame is the index
    inside that frame, not the slot number."""
    slots = numbered(
        segments, ["project_id"], ["frame_idx", "seg_id"],
        [{"f": F.col("frame_idx"), "s": F.floor(F.col("seg_id") / BUCKET_ROWS)}], "slot",
    )
    return slots.select(
        "project_id",
        "frame_idx",
        "seg_id",
        F.col("slot").cast("int").alias("slot"),
        "color",
        F.when(F.col("color") == NULL_COLOR, F.lit(NULL_COLOR))
        .otherwise(F.col("seg_id"))
        .alias("color_id"),
    )


def ids_to_colors(ids: DataFrame, palette: DataFrame, null_dense: int = NULL_COLOR) -> DataFrame:
    """Dense color and RGBA of palette ids (-100 in every channel for null).

    An id pointing at a stored -1 color counts as null, as such entries mark
    colors that must never be predicted.
    """
    looked_up = join_lookup(ids, palette, ["project_id", "color_id"])
    is_null = F.col("color_id") == NULL_COLOR
    null_entry = is_null | (F.col("color") == -1)
    rgba = dense_to_rgba(F.col("color"))
    unknown = null_entry | (F.col("color") == NULL_COLOR)
    channels = [
        F.when(unknown, F.lit(NULL_COLOR)).otherwise(rgba[c]).alias(c) for c in "rgba"
    ]
    return looked_up.select(
        *ids.columns,
        F.when(null_entry, F.lit(null_dense)).otherwise(F.col("color")).cast("bigint").alias("dense"),
        *channels,
    )


def render_segments(
    seg_pixels: DataFrame,
    segments: DataFrame,
    null_rgba: tuple[int, int, int, int] = (0, 0, 0, 0),
    keys: tuple[str, ...] = ("image_id", "seg_id"),
) -> DataFrame:
    """Paint each pixel with its segment's color. The pixel counts kept with the
    segments tell the giant ones (a background), which are looked up by
    broadcast; all others take an equi join."""
    painted = join_unique(
        seg_pixels, segments.select(*keys, "color", "num_pixels"), list(keys), "num_pixels", how="left"
    )
    rgba = dense_to_rgba(F.col("color"))
    unknown = F.coalesce(F.col("color") == NULL_COLOR, F.lit(True))
    return painted.select(
        *seg_pixels.columns,
        *[
            F.when(unknown, F.lit(null_rgba[i])).otherwise(rgba[c]).alias(c)
            for i, c in enumerate("rgba")
        ],
    )


def mask_new_colors(target: DataFrame, reference: DataFrame, key: str = "pair_id") -> DataFrame:
    """Target ids that the reference never shows become -100."""
    shown = reference.select(key, "color_id").distinct().withColumn("shown", F.lit(True))
    return join_lookup(target, shown, [key, "color_id"]).select(
        *[c for c in target.columns if c != "color_id"],
        F.when(F.col("shown"), F.col("color_id")).otherwise(F.lit(NULL_COLOR)).alias("color_id"),
    )


def new_ids(target: DataFrame, reference: DataFrame, key: str = "pair_id") -> DataFrame:
    """Ids of the target that are absent from the reference."""
    ids = target.where(F.col("color_id") != NULL_COLOR).select(key, "color_id")
    return ids.distinct().join(
        reference.select(key, "color_id").distinct(), [key, "color_id"], "left_anti"
    )


def mask_null_colors(ids: DataFrame, seg_pixels: DataFrame, key: str = "frame_id") -> DataFrame:
    """Ids of segments without a single pixel, or without a color, become -100."""
    present = (
        seg_pixels.where(F.col("seg_id") != NULL_COLOR)
        .select(key, "seg_id")
        .distinct()
        .withColumn("present", F.lit(True))
    )
    return ids.join(present, [key, "seg_id"], "left").select(
        *[c for c in ids.columns if c != "color_id"],
        F.when(F.col("present"), F.col("color_id")).otherwise(F.lit(NULL_COLOR)).alias("color_id"),
    )


def segment_limit(seg_pixels: DataFrame, key: str = "frame_id", limit: int = 255) -> DataFrame:
    """Segments per frame and whether there are too many to colorize."""
    n = F.count(F.lit(1))
    return (
        seg_pixels.select(key, "seg_id")
        .distinct()
        .groupBy(key)
        .agg(n.alias("num_segments"), (n > limit).alias("too_many"))
    )


def check_contiguous(seg_pixels: DataFrame, key: str = "frame_id") -> DataFrame:
    """Whether the labels of an image form an unbroken range."""
    return (
        seg_pixels.select(key, "seg_id")
        .distinct()
        .groupBy(key)
        .agg(
            (F.count(F.lit(1)) == F.max("seg_id") - F.min("seg_id") + 1).alias("contiguous")
        )
    )
