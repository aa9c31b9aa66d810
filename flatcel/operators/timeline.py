"""Timelines: holds, references, ordering, selection, exposure sheets.

``frames`` tables have project_id, layer, frame_nr, image_id (null for a ghost
frame) and the booleans is_original and is_selected. Frames are unique per
(project_id, layer, frame_nr); a missing frame is a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.operators import scan as SC
from flatcel.operators.skew import join_lookup, join_unique, with_group_facts
from flatcel.session import cut_lineage, drop_written

LINE, COLOR = "lineLayer1", "colorLayer1"
LAYER = ["project_id", "layer"]
FRAME = ["project_id", "layer", "frame_nr"]


def _other_layer(layer: Column) -> Column:
    return F.when(layer == LINE, F.lit(COLOR)).otherwise(F.lit(LINE))


def with_drawing(frames: DataFrame) -> DataFrame:
    """Add ``drawing``, equal for two frames of a layer iff they show the same
    drawing. A ghost frame borrows the drawing of the linked layer and only
    equals other ghost frames; null when there is nothing to borrow."""
    linked = frames.where(F.col("image_id").isNotNull()).select(
        "project_id",
        _other_layer(F.col("layer")).alias("layer"),
        "frame_nr",
        F.col("image_id").alias("__linked"),
    )
    return (
        frames.join(linked.hint("merge"), FRAME, "left")  # as many rows as frames: no broadcast
        .withColumn(
            "drawing",
            F.when(F.col("image_id").isNotNull(), F.concat(F.lit("own:"), "image_id")).otherwise(
                F.concat(F.lit("linked:"), "__linked")
            ),
        )
        .drop("__linked")
    )


def block_start(frames: DataFrame, drawing: str = "image_id") -> DataFrame:
    """Add the first frame number of the run of equal drawings a frame is in
    (null outside of any run). The neighbour test is an equi join on
    ``frame_nr - 1``; only the spread of the start number is a scan."""
    previous = frames.select(
        "project_id", "layer", (F.col("frame_nr") + 1).alias("frame_nr"), F.col(drawing).alias("__prev")
    )
    d = F.col(drawing)
    flagged = frames.join(previous.hint("merge"), FRAME, "left").withColumn(
        "__start", F.when(d.isNotNull() & ~F.coalesce(d == F.col("__prev"), F.lit(False)), F.col("frame_nr"))
    )
    scanned = SC.scan(
        flagged, LAYER, ["frame_nr"], SC.by_number("frame_nr"), block_start=SC.last_value(F.col("__start"))
    )
    return scanned.withColumn("block_start", F.when(d.isNotNull(), F.col("block_start"))).drop("__prev", "__start")


def hold_blocks(frames: DataFrame) -> DataFrame:
    """Runs of consecutive frame numbers that show one image."""
    runs = block_start(frames).where(F.col("block_start").isNotNull())
    return runs.groupBy(*LAYER, F.col("block_start").alias("first_frame")).agg(
        F.min("image_id").alias("image_id"),
        F.max("frame_nr").alias("last_frame"),
        F.count(F.lit(1)).alias("num_frames"),
    )


def reference_frames(frames: DataFrame, layer: str = COLOR) -> DataFrame:
    return frames.where((F.col("layer") == layer) & F.col("is_original")).select("project_id", "frame_nr")


def match_references(frames: DataFrame, layer: str = COLOR) -> DataFrame:
    """Nearest reference of every selected frame of a layer.

    Left and right candidates come out of one scan. The left one is reported as
    the start of its block, while the distance is taken before that walk; on a
    tie left wins, and the losing side is cleared when both exist.
    """
    # A scan reads its input twice: store what took a join and a scan to make.
    rows = cut_lineage(block_start(with_drawing(frames).where(F.col("layer") == layer), "drawing"))
    ref = F.when(
        F.col("is_original"),
        F.struct(F.col("frame_nr"), F.coalesce("block_start", "frame_nr").alias("walked")),
    )
    near = SC.scan(
        rows,
        LAYER,
        ["frame_nr"],
        SC.by_number("frame_nr"),
        __left=SC.last_value(ref),
        __right=SC.next_value(F.when(F.col("is_original"), F.col("frame_nr"))),
    ).where("is_selected")
    left, right, nr = F.col("__left"), F.col("__right"), F.col("frame_nr")
    both = left.isNotNull() & right.isNotNull()
    left_wins = F.abs(left["frame_nr"] - nr) <= F.abs(right - nr)
    return near.select(
        "project_id",
        "layer",
        "frame_nr",
        "is_original",
        F.when(both & ~left_wins, None).otherwise(left["walked"]).alias("ref_left"),
        F.when(both & left_wins, None).otherwise(right).alias("ref_right"),
        F.when(both, F.when(left_wins, left["walked"]).otherwise(right))
        .otherwise(F.coalesce(left["walked"], right))
        .alias("ref_closest"),
    )


def references_in_use(matched: DataFrame) -> DataFrame:
    """Distinct reference numbers of the selected frames; a missing side counts
    as one null entry."""
    return matched.select(
        "project_id", F.explode(F.array("ref_left", "ref_right")).alias("ref_nr")
    ).distinct()


def cel_at(frames: DataFrame) -> DataFrame:
    """Line and color image side by side, for frames that have at least one."""
    real = frames.where(F.col("image_id").isNotNull())
    line = real.where(F.col("layer") == LINE).select(
        "project_id", "frame_nr", F.col("image_id").alias("line_id")
    )
    color = real.where(F.col("layer") == COLOR).select(
        "project_id", "frame_nr", F.col("image_id").alias("color_id"),
    )
    return line.join(color, ["project_id", "frame_nr"], "full")


def ref_line_to_color(frames: DataFrame) -> DataFrame:
    """Line image to hand-made color image; the later frame decides."""
    color = frames.where((F.col("layer") == COLOR) & F.col("is_original")).select(
        "project_id", "frame_nr", F.col("image_id").alias("color_id")
    )
    line = frames.where(F.col("layer") == LINE).select(
        "project_id", "frame_nr", F.col("image_id").alias("line_id")
    )
    return (
        line.join(color, ["project_id", "frame_nr"])
        .where("line_id is not null and color_id is not null")
        .groupBy("project_id", "line_id")
        .agg(F.max_by("color_id", "frame_nr").alias("color_id"))
    )


def same_drawing(frames: DataFrame) -> DataFrame:
    """Group every frame with the frames of its layer that show the same
    drawing: the first such frame and their number (no pairs are listed)."""
    rows = with_drawing(frames).where(F.col("drawing").isNotNull())
    return with_group_facts(
        rows,
        [*LAYER, "drawing"],
        {"first_same": F.min("frame_nr"), "num_same": F.count(F.lit(1))},
    ).select(*FRAME, "first_same", "num_same")


def same_drawing_as(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames sharing the drawing of each ``wanted`` (request_id, project_id,
    layer, frame_nr)."""
    keyed = with_drawing(frames).select(*FRAME, "drawing")
    asked = wanted.join(keyed, FRAME).select("request_id", *LAYER, "drawing")
    return keyed.join(asked, [*LAYER, "drawing"]).select("request_id", *FRAME)


def frames_share_drawing(frames: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether all frames of a request show one drawing. ``requests``:
    request_id, project_id, layer, frame_nr. The ghost flag is part of the
    drawing, so the mode of the first frame needs no special care."""
    keyed = with_drawing(frames).select(*FRAME, "drawing")
    return (
        requests.join(keyed, FRAME, "left")
        .groupBy("request_id")
        .agg(
            (
                (F.count(F.lit(1)) == F.count("drawing"))
                & F.coalesce(F.min("drawing") == F.max("drawing"), F.lit(False))
            ).alias("share")
        )
    )


def correct_originality(frames: DataFrame) -> DataFrame:
    """Frames sharing an image with an original become originals. Frames
    without an image form one group of their own, as in a null-safe match."""
    marked = with_group_facts(
        frames, [*LAYER, "image_id"], {"__any": F.max("is_original")}
    )
    return marked.select(
        *[c for c in frames.columns if c != "is_original"], F.col("__any").alias("is_original")
    )


def expand_selection(frames: DataFrame, clicks: DataFrame) -> DataFrame:
    """Selection after toggling frames (``clicks``: project_id, layer, frame_nr,
    seq). A click flips its frame and hands the result to all frames of the
    drawing, so n clicks on one drawing flip the state seen first n times."""
    keyed = with_drawing(frames).withColumn(
        "__group",
        F.coalesce(F.col("drawing"), F.concat(F.lit("frame:"), F.col("frame_nr").cast("string"))),
    )
    state = (
        clicks.join(keyed.select(*FRAME, "__group", "is_selected"), FRAME)
        .groupBy(*LAYER, "__group")
        .agg(F.min_by("is_selected", "seq").alias("__seen"), F.count(F.lit(1)).alias("__clicks"))
    )
    toggled = F.when(F.col("__clicks") % 2 == 1, ~F.col("__seen")).otherwise(F.col("__seen"))
    return join_lookup(keyed, state, [*LAYER, "__group"]).select(
        *[c for c in frames.columns if c != "is_selected"],
        F.coalesce(toggled, F.col("is_selected")).alias("is_selected"),
    )


def add_ghosts(frames: DataFrame) -> DataFrame:
    """Frames plus an empty partner on the linked layer wherever it is missing."""
    suffix = F.when(F.col("layer") == LINE, F.lit("_color")).otherwise(F.lit("_line"))
    partners = frames.where(F.col("image_id").isNotNull()).select(
        "project_id",
        _other_layer(F.col("layer")).alias("layer"),
        "frame_nr",
        F.concat(F.col("image_id"), suffix).alias("image_id"),
        F.lit(False).alias("is_original"),
        F.lit(False).alias("is_selected"),
    )
    return frames.unionByName(partners.join(frames.select(*FRAME), FRAME, "left_anti"))


def cel_changes(frames: DataFrame) -> DataFrame:
    """Next and previous frame number at which the visible cel changes.

    A change is a frame whose (line, color) pair differs from the frame before
    it, including the switch from something to nothing (which may fall on a
    number without any frame).
    """
    cels = cel_at(frames).withColumn(
        "__id",
        F.concat(F.coalesce("line_id", F.lit("line-null")), F.lit("|"), F.coalesce("color_id", F.lit("color-null"))),
    ).select("project_id", "frame_nr", "__id")
    shifted = cels.select("project_id", (F.col("frame_nr") + 1).alias("frame_nr"), F.col("__id").alias("__prev"))
    points = (
        cels.join(shifted, ["project_id", "frame_nr"], "full")
        .where(~F.col("__id").eqNullSafe(F.col("__prev")))
        .select("project_id", "frame_nr", F.lit(True).alias("change"), F.lit(False).alias("asked"))
    )
    asked = frames.select(
        "project_id", "frame_nr", F.lit(False).alias("change"), F.lit(True).alias("asked")
    )
    rows = points.unionByName(asked).groupBy("project_id", "frame_nr").agg(
        F.max("change").alias("change"), F.max("asked").alias("asked")
    )
    at = F.when(F.col("change") & (F.col("frame_nr") > 0), F.col("frame_nr"))
    return (
        SC.scan(
            rows,
            ["project_id"],
            ["frame_nr"],
            SC.by_number("frame_nr"),
            prev_change=SC.last_value(at, inclusive=False),
            next_change=SC.next_value(at, inclusive=False),
        )
        .where("asked")
        .select("project_id", "frame_nr", "prev_change", "next_change")
    )


def unique_drawings(frames: DataFrame) -> DataFrame:
    """Images of a layer in order of first use."""
    drawings = (
        frames.where(F.col("image_id").isNotNull())
        .groupBy(*LAYER, "image_id")
        .agg(F.min("frame_nr").alias("first_frame"), F.count(F.lit(1)).alias("num_frames"))
    )
    return SC.numbered(drawings, LAYER, ["first_frame"], SC.by_number("first_frame"), "drawing_pos")


def drawing_uses(frames: DataFrame) -> DataFrame:
    """Which images of a layer are used more than once."""
    return (
        frames.where(F.col("image_id").isNotNull())
        .groupBy(*LAYER, "image_id")
        .agg((F.count(F.lit(1)) == 1).alias("is_unique"))
    )


def frame_extent(frames: DataFrame) -> DataFrame:
    """First and last frame with an image, over both layers."""
    nr = F.when(F.col("image_id").isNotNull(), F.col("frame_nr"))
    return frames.groupBy("project_id").agg(F.min(nr).alias("first_real"), F.max(nr).alias("last_real"))


def order_ops(matched: DataFrame) -> DataFrame:
    """Processing position: by reference, then frames left of it before frames
    right of it, nearest first; the reference frame itself opens its group. A
    reference of 0 on the left counts as missing; frames without any reference
    come first, by number."""
    ref = F.when(F.coalesce(F.col("ref_left"), F.lit(0)) != 0, F.col("ref_left")).otherwise(F.col("ref_right"))
    dist = F.col("__ref") - F.col("frame_nr")
    rows = (
        cut_lineage(matched).withColumn("ref_nr", ref)
        .withColumn("__ref", F.coalesce(F.col("ref_nr"), F.lit(-1)))
        .withColumn("__side", F.when(F.col("ref_nr").isNull(), 0).when(dist == 0, 0).when(dist > 0, 1).otherwise(2))
        .withColumn("__dist", F.when(F.col("ref_nr").isNull(), F.col("frame_nr")).otherwise(F.abs(dist)))
    )
    buckets = [
        {"r": F.col("__ref"), "s": F.col("__side"), "d": F.floor(F.col("__dist") / SC.BUCKET_ROWS)},
        {"rr": F.floor(F.col("__b_r") / SC.BUCKET_ROWS)},
    ]
    return SC.numbered(rows, ["project_id"], ["__ref", "__side", "__dist"], buckets, "ord").select(
        "project_id", "frame_nr", "is_original", "ref_nr", F.col("ord").cast("int").alias("ord")
    )


def in_between_ref(ops: DataFrame, span: int = 256) -> DataFrame:
    """Colorized frame to reference instead of the far original.

    Among the frames done before an op and lying between it and its reference,
    the one farthest from the reference. ``ops``: project_id, frame_nr, ref_nr,
    ord, with order as made by ``order_ops`` (originals left out). Inside one
    side of a reference group all nearer frames are done, so the best of them is
    simply the preceding op; frames of other groups can only win in the gap up
    to that op, which is searched with a banded equi join.
    """
    ops = cut_lineage(ops.where("ref_nr is not null")).withColumn("__side", F.signum(F.col("frame_nr") - F.col("ref_nr")).cast("int"))
    dist = F.abs(F.col("frame_nr") - F.col("ref_nr"))
    near = SC.scan(
        ops.withColumn("__dist", dist),
        ["project_id", "ref_nr", "__side"],
        ["__dist"],
        SC.by_number("__dist"),
        __near=SC.last_value(F.when(F.col("__side") != 0, F.col("frame_nr")), inclusive=False),
    )
    f, near_nr = F.col("frame_nr"), F.coalesce("__near", F.col("ref_nr") - F.col("__side"))
    gap = near.withColumns(
        {
            "__lo": F.when(f <= F.col("ref_nr"), f).otherwise(near_nr + 1),
            "__hi": F.when(f <= F.col("ref_nr"), near_nr - 1).otherwise(f),
        }
    )
    bands = gap.where("__lo <= __hi").select(
        "project_id", "frame_nr", "ref_nr", "ord", "__lo", "__hi",
        F.explode(F.sequence(F.floor(F.col("__lo") / span), F.floor(F.col("__hi") / span))).alias("__band"),
    )
    done = ops.select(
        "project_id",
        F.floor(F.col("frame_nr") / span).alias("__band"),
        F.col("frame_nr").alias("__nr"),
        F.col("ord").alias("__done"),
    )
    foreign = (
        bands.join(done, ["project_id", "__band"])
        .where("__nr between __lo and __hi and __done < ord")
        .groupBy("project_id", "frame_nr")
        .agg(F.max_by("__nr", F.struct(F.abs(F.col("__nr") - F.col("ref_nr")), -F.col("__nr"))).alias("__foreign"))
    )
    return near.join(foreign, ["project_id", "frame_nr"], "left").select(
        "project_id", "frame_nr", "ref_nr", "ord", F.coalesce("__foreign", "__near").alias("in_between")
    )


def plan_colorize(matched: DataFrame, frames: DataFrame, analyze: bool = False) -> DataFrame:
    """Ordered ops per project, or its first error.

    Rows carry ``error`` (NO_REFERENCE, REF_LINE_MISSING or null) and
    ``error_frame``; a project with an error keeps one row without an op.
    """
    ordered = order_ops(matched)
    if analyze:
        return ordered.withColumns({"error": F.lit(None).cast("string"), "error_frame": F.lit(None).cast("int")})
    lines = frames.where(F.col("layer") == LINE).select(
        "project_id", F.col("frame_nr").alias("ref_nr"), F.lit(True).alias("__line")
    )
    checked = cut_lineage(
        ordered.join(lines, ["project_id", "ref_nr"], "left").withColumn(
            "__bad",
            F.when(F.col("is_original"), None)
            .when(F.coalesce(F.col("ref_nr"), F.lit(0)) == 0, "NO_REFERENCE")
            .when(F.col("__line").isNull(), "REF_LINE_MISSING"),
        )
    )
    errors = (
        checked.where("__bad is not null")
        .groupBy("project_id")
        .agg(F.min(F.struct("ord", F.col("__bad").alias("error"), F.col("frame_nr").alias("error_frame"))).alias("e"))
        .select("project_id", "e.error", "e.error_frame")
    )
    empty = errors.select(
        "project_id",
        F.lit(None).cast("int").alias("frame_nr"),
        F.lit(None).cast("boolean").alias("is_original"),
        F.lit(None).cast("int").alias("ref_nr"),
        F.lit(None).cast("int").alias("ord"),
        "error",
        "error_frame",
    )
    failed = errors.select("project_id", F.lit(True).alias("__failed"))
    fine = join_lookup(checked, failed, ["project_id"]).where("__failed is null").select(
        "project_id", "frame_nr", "is_original", "ref_nr", "ord",
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("error_frame"),
    )
    return fine.unionByName(empty)


def dedupe_ops(ops: DataFrame, frames: DataFrame) -> DataFrame:
    """For each op, the op that does the work for its line drawing.

    A drawing with a hand-made color image is reused from there; otherwise the
    first op of the drawing runs and the others copy its result.
    """
    lines = frames.where(F.col("layer") == LINE).select("project_id", "frame_nr", F.col("image_id").alias("line_id"))
    rows = cut_lineage(
        ops.join(lines, ["project_id", "frame_nr"]).where("line_id is not null and not is_original")
    )
    firsts = rows.groupBy("project_id", "line_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min_by("frame_nr", "ord").alias("run_frame")
    )
    seeded = firsts.join(
        ref_line_to_color(frames).withColumnRenamed("color_id", "seeded_color"), ["project_id", "line_id"], "left"
    )
    return join_unique(rows, seeded, ["project_id", "line_id"], "__n").select(
        "project_id",
        "frame_nr",
        "line_id",
        "seeded_color",
        F.when(F.col("seeded_color").isNull(), F.col("run_frame")).alias("run_frame"),
        (F.col("seeded_color").isNull() & (F.col("run_frame") == F.col("frame_nr"))).alias("runs"),
    )


def derive_cels(frames: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exposure sheet: the distinct (line, color) pairs of a project named c1,
    c2, ... by first use, and the cel shown on each track at each frame.
    ``images``: image_id, has_bytes; ids without bytes count as absent."""
    real = images.where("has_bytes").select("image_id", F.lit(True).alias("__bytes"))
    flags = frames.where(F.col("layer") == COLOR).select("project_id", "frame_nr", "is_original")
    placed = cut_lineage(cel_at(frames))
    with_line = join_lookup(placed, real.withColumnsRenamed({"image_id": "line_id", "__bytes": "__lb"}), ["line_id"])
    cels = cut_lineage(
        join_lookup(with_line, real.withColumnsRenamed({"image_id": "color_id", "__bytes": "__cb"}), ["color_id"])
        .join(flags, ["project_id", "frame_nr"], "left")
        .select(
            "project_id",
            "frame_nr",
            F.when(F.col("__lb"), F.col("line_id")).alias("line_id"),
            F.when(F.col("__cb"), F.col("color_id")).alias("color_id"),
            "is_original",
        )
    )
    drop_written(placed)
    pairs = cels.groupBy("project_id", "line_id", "color_id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("frame_nr").alias("first_frame"),
        F.min_by("is_original", "frame_nr").alias("__orig"),
    )
    numbered = SC.numbered(pairs, ["project_id"], ["first_frame"], SC.by_number("first_frame"), "__pos").withColumn(
        "cel_id", F.concat(F.lit("c"), (F.col("__pos") + 1).cast("string"))
    )
    named = numbered.select(
        "project_id",
        "cel_id",
        "line_id",
        "color_id",
        F.when(F.col("color_id").isNull(), "none")
        .when(F.col("__orig"), "reference")
        .otherwise("colorized")
        .alias("provenance"),
    )
    shown = join_unique(
        cels, numbered.select("project_id", "line_id", "color_id", "__n", "cel_id"),
        ["project_id", "line_id", "color_id"], "__n",
    )
    exposures = shown.select(
        "project_id",
        "frame_nr",
        "cel_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("line_id").isNotNull(), F.lit("line")),
                    F.when(F.col("color_id").isNotNull(), F.lit("color")),
                )
            )
        ).alias("track"),
    )
    return named, exposures


def delete_frames(frames: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the selected frames.

    Bytes of the selected images are cleared (hence for every frame using
    them); a frame number loses all its rows only if it was selected and no
    layer still has bytes there. Selected color frames stop being originals.
    """
    cleared = frames.where("is_selected and image_id is not null").select("image_id").distinct()
    images_after = images.join(cleared.withColumn("__gone", F.lit(True)), "image_id", "left").select(
        *[c for c in images.columns if c != "has_bytes"],
        (F.col("has_bytes") & F.col("__gone").isNull()).alias("has_bytes"),
    )
    stored = images_after.where("has_bytes").select("image_id", F.lit(True).alias("__stored"))
    rows = join_lookup(frames, stored, ["image_id"])
    numbers = rows.groupBy("project_id", "frame_nr").agg(
        F.max("is_selected").alias("__hit"), F.max(F.coalesce("__stored", F.lit(False))).alias("__kept")
    )
    kept = rows.join(numbers, ["project_id", "frame_nr"]).where("not __hit or __kept")
    lost_flag = (F.col("layer") == COLOR) & (
        F.col("is_selected") | (F.col("__hit") & F.col("__stored").isNull())
    )
    frames_after = kept.select(
        *FRAME,
        "image_id",
        (F.col("is_original") & ~lost_flag).alias("is_original"),
        F.lit(False).alias("is_selected"),
    )
    return frames_after, images_after


def upsert_frames(frames: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ordered image assignments (``changes``: project_id, layer,
    frame_nr, seq, image_id, is_original, force).

    An original is only ever replaced by a forced change. The outcome of a
    series follows from its last forced change (or the stored frame): if that is
    an original it stands, else the first original after it, else the last one.
    """
    cols = ["image_id", "is_original", "is_selected"]
    stored = frames.select(*FRAME, F.lit(-1).cast("bigint").alias("seq"), *cols, F.lit(True).alias("force"))
    events = stored.unionByName(
        changes.select(*FRAME, F.col("seq").cast("bigint").alias("seq"), "image_id", "is_original",
                       F.lit(None).cast("boolean").alias("is_selected"), "force")
    )
    # A frame never stored starts empty and not original, which is the same as a
    # base before all changes.
    based = with_group_facts(
        events, FRAME, {"__base": F.max(F.when(F.col("force"), F.col("seq")))}
    ).where(F.col("__base").isNull() | (F.col("seq") >= F.col("__base")))
    at = F.col("seq") == F.col("__base")
    state = F.struct("seq", "image_id", "is_original")
    return (
        based.groupBy(*FRAME)
        .agg(
            F.max_by(F.when(at, state), F.when(at, F.col("seq"))).alias("base"),
            F.min_by(state, F.when(F.col("is_original") & ~F.coalesce(at, F.lit(False)), F.col("seq"))).alias("first"),
            F.max_by(state, "seq").alias("last"),
        )
        .withColumn(
            "__s",
            F.when(F.col("base.is_original"), F.col("base")).otherwise(F.coalesce("first", "last")),
        )
        .join(frames.select(*FRAME, "is_selected"), FRAME, "left")
        .select(*FRAME, "__s.image_id", "__s.is_original", F.coalesce("is_selected", F.lit(False)).alias("is_selected"))
    )


def recolor_targets(frames: DataFrame, images: DataFrame, seeds: DataFrame) -> DataFrame:
    """Images a recolor pass must rewrite, in order: the seed of the project
    first, then each further color drawing that has bytes. ``seeds``:
    project_id, image_id; ``images``: image_id, has_bytes."""
    bytes_ = images.where("has_bytes").select("image_id")
    seed = seeds.join(bytes_, "image_id", "left_semi").select(
        "project_id", "image_id", F.lit(-1).alias("first_frame")
    )
    rest = (
        frames.where((F.col("layer") == COLOR) & F.col("image_id").isNotNull())
        .groupBy("project_id", "image_id")
        .agg(F.min("frame_nr").alias("first_frame"))
        .join(bytes_, "image_id", "left_semi")
        .join(seed.select("project_id", "image_id"), ["project_id", "image_id"], "left_anti")
    )
    both = seed.unionByName(rest.select("project_id", "image_id", "first_frame"))
    return SC.numbered(both, ["project_id"], ["first_frame"], SC.by_number("first_frame"), "pos").select(
        "project_id", "image_id", F.col("pos").cast("int").alias("pos")
    )
