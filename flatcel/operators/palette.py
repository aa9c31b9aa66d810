"""Palettes: defaults, changes, merging, recoloring.

``swatches`` tables: project_id, pos, hex, new_hex, visible, new_visible,
opacity, new_opacity, selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.functions.color import hex_channel, hex_to_u32, rgba_to_hex
from flatcel.operators import scan as SC
from flatcel.operators.skew import join_lookup
from flatcel.session import cut_lineage


def normalise_swatches(swatches: DataFrame) -> DataFrame:
    """Null defaults; the later ones fall back on the already defaulted ones."""
    opacity = F.coalesce("opacity", F.lit(255))
    visible = F.coalesce("visible", F.lit(True))
    return swatches.withColumns(
        {
            "new_hex": F.coalesce("new_hex", "hex"),
            "visible": visible,
            "opacity": opacity,
            "new_opacity": F.coalesce(F.col("new_opacity"), opacity),
            "new_visible": F.coalesce(F.col("new_visible"), visible),
        }
    )


def changed_swatches(swatches: DataFrame, all_frames: bool) -> DataFrame:
    """Swatches a recolor pass acts on; a hidden one fades to opacity 0."""
    n = normalise_swatches(swatches)
    changed = (
        (F.col("hex") != F.col("new_hex"))
        | (F.col("opacity") != F.col("new_opacity"))
        | (F.col("visible") != F.col("new_visible"))
    )
    taking_part = F.lit(True) if all_frames else F.coalesce("selected", F.lit(False))
    return n.where(taking_part & changed).withColumn(
        "new_opacity", F.when(F.col("new_visible"), F.col("new_opacity")).otherwise(0)
    )


def recolor_mapping(swatches: DataFrame, all_frames: bool = True) -> DataFrame:
    """Old and new packed color of each changed swatch, in palette order."""
    return changed_swatches(swatches, all_frames).select(
        "project_id",
        "pos",
        hex_to_u32(F.col("hex"), F.col("opacity")).alias("old_u32"),
        hex_to_u32(F.col("new_hex"), F.col("new_opacity")).alias("new_u32"),
    )


def compose_mapping(mapping: DataFrame, max_rounds: int = 40) -> DataFrame:
    """One row per old color with what is left of it after the whole list.

    The list is applied in order to every pixel, so a color just written can be
    replaced again by a later entry. Entry p is followed by the next entry that
    reads the color p wrote: these chains are collapsed by pointer doubling, a
    handful of joins on the palette table, before any pixel is touched.
    """
    reads = mapping.select(
        "project_id", F.col("old_u32").alias("u32"), "pos", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("out")
    )
    writes = mapping.select(
        "project_id", F.col("new_u32").alias("u32"), "pos", F.lit(1).alias("kind"), F.col("new_u32").alias("out")
    )
    linked = SC.scan(
        reads.unionByName(writes),
        ["project_id", "u32"],
        # At equal position the read sorts first: an entry never follows itself.
        ["pos", "kind"],
        SC.by_number("pos"),
        nxt=SC.next_value(F.when(F.col("kind") == 0, F.col("pos")), inclusive=False),
    ).where("kind = 1")
    chain = cut_lineage(
        mapping.select("project_id", "pos", "old_u32")
        .join(linked.select("project_id", "pos", F.col("out").alias("final"), "nxt"), ["project_id", "pos"])
    )
    for _ in range(max_rounds):
        if chain.where("nxt is not null").isEmpty():
            break
        ahead = chain.select(
            "project_id", F.col("pos").alias("nxt"), F.col("final").alias("__final"), F.col("nxt").alias("__nxt")
        )
        chain = cut_lineage(
            chain.join(ahead, ["project_id", "nxt"], "left").select(
                "project_id", "pos", "old_u32", F.coalesce("__final", "final").alias("final"), F.col("__nxt").alias("nxt")
            )
        )
    else:
        raise RuntimeError("palette chains did not settle")
    return chain.groupBy("project_id", "old_u32").agg(F.min_by("final", "pos").alias("new_u32"))


def recolor_pixels(pixels: DataFrame, composed: DataFrame) -> DataFrame:
    """Replace packed colors (alpha included in the match). ``pixels``:
    project_id, u32 and position columns."""
    table = composed.select("project_id", F.col("old_u32").alias("u32"), "new_u32")
    return join_lookup(pixels, table, ["project_id", "u32"]).select(
        *[c for c in pixels.columns if c != "u32"], F.coalesce("new_u32", "u32").alias("u32")
    )


def response_palette(response: Column) -> Column:
    """Palette entries (array of JSON texts) of a server response: the first
    present of five field names."""
    # Field names in order of preference (fixed values).
    names = ("ref_palette_rgba", "target_palette_rgba", "palette_rgba", "palette", "colors_rgba")
    found = F.coalesce(*[F.get_json_object(response, f"$.{n}") for n in names])
    return F.coalesce(F.from_json(found, "array<string>"), F.array().cast("array<string>"))


def palette_entry(entry: Column) -> Column:
    """RGBA of one entry, written as [r,g,b,a] or {r,g,b,a} (a defaults to 255)."""
    listed = F.from_json(entry, "array<int>")
    named = F.from_json(entry, "struct<r:int,g:int,b:int,a:int>")
    is_list = F.startswith(entry, F.lit("["))
    return F.struct(
        *[F.when(is_list, F.get(listed, F.lit(i))).otherwise(named[c]).alias(c) for i, c in enumerate("rgb")],
        F.when(is_list, F.get(listed, F.lit(3))).otherwise(F.coalesce(named["a"], F.lit(255))).alias("a"),
    )


def merge_palette(swatches: DataFrame, colors: DataFrame) -> DataFrame:
    """New swatches for colors (project_id, seq, r, g, b, a) not in the palette
    yet, first occurrence first; transparent entries never enter."""
    fresh = (
        colors.where(~F.coalesce(F.col("a") == 0, F.lit(False)))
        .select("project_id", "seq", rgba_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
        .groupBy("project_id", "hex")
        .agg(F.min("seq").alias("seq"))
        .join(swatches.select("project_id", "hex").distinct(), ["project_id", "hex"], "left_anti")
    )
    return fresh.select(
        "project_id",
        "seq",
        "hex",
        F.col("hex").alias("new_hex"),
        F.lit(True).alias("visible"),
        F.lit(True).alias("new_visible"),
        F.lit(False).alias("selected"),
        F.lit(255).alias("opacity"),
        F.lit(255).alias("new_opacity"),
    )


def commit_palette(swatches: DataFrame) -> DataFrame:
    """Palette after a committed recolor: new values become current, hidden
    entries go, and of equal colors the first stays."""
    kept = normalise_swatches(swatches).where("new_visible")
    row = F.struct("pos", F.col("new_opacity").alias("opacity"), F.col("new_visible").alias("visible"))
    return (
        kept.groupBy("project_id", F.col("new_hex").alias("hex"))
        .agg(F.min_by(row, "pos").alias("s"))
        .select("project_id", "hex", "s.*")
    )


def _pass_state() -> tuple[Column, Column]:
    visible = F.coalesce("new_visible", "visible")
    opacity = F.coalesce(F.col("new_opacity"), F.col("opacity"), F.lit(255))
    return visible, opacity


def palette_filter(pixels: DataFrame, hex_color: str, opacity: int = 255, visible: bool = True) -> DataFrame:
    """Keep one color of an image: RGB is matched without alpha, a match takes
    the opacity, everything else turns into 0 in all channels."""
    rgb = [int(hex_color[i : i + 2], 16) for i in (1, 3, 5)]
    keep = (F.col("r") == rgb[0]) & (F.col("g") == rgb[1]) & (F.col("b") == rgb[2]) & F.lit(visible and opacity != 0)
    return pixels.withColumns(
        {
            **{c: F.when(keep, F.col(c)).otherwise(0) for c in "rgb"},
            "a": F.when(keep, F.lit(opacity)).otherwise(0),
        }
    )


def palette_passes(pixels: DataFrame, swatches: DataFrame) -> DataFrame:
    """All one-color passes of a palette at once: the visible pixels of each
    pass. Pixels missing from a pass are transparent there, so the result has
    about as many rows as the image, not image times palette."""
    visible, opacity = _pass_state()
    color = ["project_id", "r", "g", "b"]
    targets = (
        swatches.where(visible & (opacity != 0))
        .select(
            "project_id",
            *[hex_channel(F.col("hex"), i).alias(c) for i, c in enumerate("rgb")],
            F.struct(F.col("pos").alias("pass"), opacity.alias("a")).alias("__pass"),
        )
        .groupBy(*color)
        .agg(F.collect_list("__pass").alias("__passes"))
    )
    shown = join_lookup(pixels.drop("a"), targets, color, "inner")
    return shown.select("*", F.inline("__passes")).drop("__passes")
