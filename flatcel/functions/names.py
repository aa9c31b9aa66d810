"""File names, cache keys, versions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The supported frame range, the oldest readable version and the
# readable image types.
MAX_FRAME_NR = 1000
MIN_VERSION = (0, 3, 0)
IMAGE_EXTENSIONS = ("png",)


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("int")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def frame_idx(path: Column) -> Column:
    """Digits (and an optional letter, dropped) right before ``.png``."""
    return _number(F.regexp_extract(basename(path), r"([0-9]+)[a-zA-Z]?\.png", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def timeline_frame_nr(name: Column) -> Column:
    """Trailing digits of the stem plus one; null without digits."""
    return _number(F.regexp_extract(stem(name), r"([0-9]+)$", 1)) + 1


def frame_verdict(nr: Column) -> Column:
    return F.when(nr.isNull(), "MISSING").when(nr > MAX_FRAME_NR, "TOO_HIGH").otherwise("OK")


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def left_pad(value: Column, digits: Column | int) -> Column:
    """Zero padding that, unlike ``lpad``, never cuts a wide value."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits) if isinstance(digits, int) else digits), F.lit("0"))


def seg_cache_key(
    content_hash: Column,
    threshold: Column,
    auto_alpha: Column,
    tb_dilation: Column,
    ai_dilation: Column,
    min_seg: Column,
    prefix: str = "segMap_",
) -> Column:
    """File name of a cached segmentation, holding every parameter of it."""
    return F.concat(
        F.lit(prefix),
        content_hash,
        F.lit("_line_threshold_"),
        F.when(auto_alpha, F.lit("auto")).otherwise(threshold.cast("string")),
        F.lit("_tbDilate_"),
        left_pad(tb_dilation, 2),
        F.lit("_aiDilate_"),
        left_pad(ai_dilation, 2),
        F.lit("_minSegSize_"),
        min_seg.cast("string"),
        F.lit(".png"),
    )


def is_too_old(version: Column) -> Column:
    """Version below 0.3.0; a pre-release of 0.3.0 is below it as well."""
    parts = F.split(F.regexp_replace(F.split(version, "-")[0], "^[vV]", ""), r"\.")
    numbers = F.array(*[F.coalesce(F.get(parts, F.lit(i)).cast("int"), F.lit(0)) for i in range(3)])
    floor = F.array(*[F.lit(n) for n in MIN_VERSION])
    return (numbers < floor) | ((numbers == floor) & F.contains(version, F.lit("-")))
