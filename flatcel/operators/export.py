"""Export planning and compositing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.functions.names import left_pad
from flatcel.operators.skew import join_lookup
from flatcel.operators.timeline import cel_at, frame_extent

BLOCK = 65536


def frame_ranges(extent: DataFrame) -> DataFrame:
    """Every frame number from first to last, made block by block so that a
    single endless timeline does not unfold inside one task."""
    blocks = extent.where("first_real is not null").select(
        "project_id",
        "first_real",
        "last_real",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("last_real") - F.col("first_real")) / BLOCK))).alias("block"),
    )
    low = F.col("first_real") + F.col("block") * BLOCK
    return blocks.repartition("project_id", "block").select(
        "project_id",
        "block",
        F.explode(F.sequence(low, F.least(F.col("last_real"), low + (BLOCK - 1)))).alias("frame_nr"),
    ).withColumn("frame_nr", F.col("frame_nr").cast("int"))


def plan_export(frames: DataFrame, settings: DataFrame, swatches: DataFrame) -> DataFrame:
    """Frames times passes to render, or the reason why there are none.

    ``settings``: project_id, line_visible, color_visible, separated. Passes are
    one flat pass (null) or one per swatch position. Errors, first one wins:
    NO_VISIBLE_LAYERS, NO_FRAMES, EMPTY_PALETTE.
    """
    sizes = swatches.groupBy("project_id").agg(F.count(F.lit(1)).alias("__colors"))
    state = (
        settings.join(frame_extent(frames), "project_id", "left")
        .join(sizes, "project_id", "left")
        .withColumn(
            "error",
            F.when(~F.col("line_visible") & ~F.col("color_visible"), "NO_VISIBLE_LAYERS")
            .when(F.col("first_real").isNull(), "NO_FRAMES")
            .when(F.col("separated") & F.col("__colors").isNull(), "EMPTY_PALETTE"),
        )
    )
    good = state.where("error is null")
    numbers = frame_ranges(good.select("project_id", "first_real", "last_real"))
    blocks = numbers.select("project_id", "block").distinct()
    flat = good.where("not separated").select("project_id", F.lit(None).cast("int").alias("pass"))
    split = good.where("separated").select("project_id").join(
        swatches.select("project_id", F.col("pos").alias("pass")), "project_id"
    )
    # Passes are handed to each block of frames, never to a project as a whole.
    passes = flat.unionByName(split).join(blocks, "project_id")
    # Frames get their images before they are multiplied by the passes.
    planned = (
        numbers.join(cel_at(frames), ["project_id", "frame_nr"], "left")
        .join(passes, ["project_id", "block"])
        .select("project_id", "frame_nr", "pass", "line_id", "color_id", F.lit(None).cast("string").alias("error"))
    )
    failed = state.where("error is not null").select(
        "project_id",
        F.lit(None).cast("int").alias("frame_nr"),
        F.lit(None).cast("int").alias("pass"),
        F.lit(None).cast("string").alias("line_id"),
        F.lit(None).cast("string").alias("color_id"),
        "error",
    )
    return planned.unionByName(failed)


def export_paths(plan: DataFrame, target: Column, frame_count: Column) -> DataFrame:
    """Path stem of every planned file.

    The chosen target loses its last four characters; color passes go to a
    numbered sub-folder. Written numbers start at 0 and are one digit shorter
    than the frame count (wide numbers are not cut).
    """
    folder = F.regexp_replace(target, "/[^/]*$", "")
    prefix = F.split(F.element_at(F.split(target, "/"), -1), r"\.")[0]
    base = F.expr("left(__target, length(__target) - 4)")
    color = F.concat(F.lit("color"), left_pad(F.col("pass") + 1, 2))
    path = F.when(F.col("pass").isNull(), base).otherwise(
        F.concat_ws("/", folder, color, F.concat_ws("_", prefix, color))
    )
    digits = F.length(frame_count.cast("string")) - 1
    return (
        plan.withColumn("__target", target)
        .withColumn("sub_folder", F.when(F.col("pass").isNotNull(), F.concat_ws("/", folder, color)))
        .withColumn("stem", F.concat_ws("_", path, left_pad(F.col("frame_nr") - 1, digits)))
        .drop("__target")
    )


def compose_plan(has_color: Column, has_line: Column, pass_: Column, show_line: Column, show_color: Column,
                 show_background: Column) -> Column:
    """Layers to draw for a frame, bottom first. A color pass ignores the
    visibility of the color layer and never draws lines."""
    separated = pass_.isNotNull()
    layers = F.array_compact(
        F.array(
            F.when(show_background, F.lit("background")),
            F.when((show_color | separated) & has_color, F.lit("color")),
            F.when(show_line & has_line & ~separated, F.lit("line")),
        )
    )
    return F.when(F.size(layers) == 0, F.array(F.lit("blank"))).otherwise(layers)


def distinct_renders(plan: DataFrame) -> DataFrame:
    """Each (line, color, pass) once, with the number of frames that use it."""
    return plan.groupBy("project_id", "line_id", "color_id", "pass").agg(
        F.count(F.lit(1)).alias("num_frames"), F.min("frame_nr").alias("first_frame")
    )


def fan_out(plan: DataFrame, rendered: DataFrame) -> DataFrame:
    """Hand each finished render to all frames that show it."""
    keys = ["project_id", "line_id", "color_id", "pass"]
    return join_lookup(plan, rendered.where("project_id is not null"), keys, "inner", null_safe=True)


def composite(layers: DataFrame, keys: tuple[str, ...] = ("image_id", "y", "x")) -> DataFrame:
    """Alpha-over of stacked pixels (keys, z, r, g, b, a), lowest z first.

    A pixel only ever has as many rows as there are layers, so the small array
    per pixel is bounded by the stack height.
    """
    stack = layers.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", "a"))).alias("s"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])

    def over(below: Column, top: Column) -> Column:
        ta = top["a"] / 255.0
        rest = below["a"] * (1.0 - ta)
        alpha = ta + rest
        mixed = [
            F.when(alpha == 0, F.lit(0.0)).otherwise((top[c] * ta + below[c] * rest) / alpha).alias(c) for c in "rgb"
        ]
        return F.struct(*mixed, alpha.alias("a"))

    done = stack.select(*keys, F.aggregate("s", zero, over).alias("c"))
    return done.select(
        *keys,
        *[F.floor(F.col(f"c.{c}") + 0.5).cast("int").alias(c) for c in "rgb"],
        F.floor(F.col("c.a") * 255.0 + 0.5).cast("int").alias("a"),
    )
