"""Color packing, unpacking and conversion as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the file formats.
NULL_COLOR = -100
TRANSPARENT_DENSE = 0
BLACK_DENSE = 255 * 256 * 256 * 256


def rgba_to_dense(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Pack RGBA with red in the lowest byte (needs 64 bits)."""
    return (
        r.cast("bigint")
        + g.cast("bigint") * 256
        + b.cast("bigint") * 65536
        + a.cast("bigint") * 16777216
    )


def dense_byte(dense: Column, k: int) -> Column:
    """Byte ``k`` with floor semantics, so negative sentinels unpack too."""
    return F.shiftright(dense.cast("bigint"), 8 * k).bitwiseAND(F.lit(255)).cast("int")


def dense_to_rgba(dense: Column) -> Column:
    return F.struct(
        *[dense_byte(dense, k).alias(n) for k, n in enumerate(("r", "g", "b", "a"))]
    )


def label_to_rgba(label: Column) -> Column:
    """Big-endian label bytes; the padding sentinel is all ones."""
    pad = label == NULL_COLOR
    return F.struct(
        *[
            F.when(pad, F.lit(255)).otherwise(dense_byte(label, k)).alias(n)
            for k, n in ((3, "r"), (2, "g"), (1, "b"), (0, "a"))
        ]
    )


def rgba_to_label(r: Column, g: Column, b: Column, a: Column) -> Column:
    return rgba_to_dense(a, b, g, r)


def _hex2(channel: Column) -> Column:
    return F.lower(F.lpad(F.hex(channel.cast("bigint")), 2, "0"))


def rgba_to_hex(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    parts = [r, g, b] + ([a] if a is not None else [])
    return F.concat(F.lit("#"), *[_hex2(p) for p in parts])


def hex_channel(hex_color: Column, k: int) -> Column:
    return F.conv(F.substring(hex_color, 2 + 2 * k, 2), 16, 10).cast("int")


def hex_to_rgb(hex_color: Column) -> Column:
    return F.struct(
        *[hex_channel(hex_color, k).alias(n) for k, n in enumerate(("r", "g", "b"))]
    )


def hex_to_u32(hex_color: Column, alpha: Column) -> Column:
    return rgba_to_dense(*[hex_channel(hex_color, k) for k in range(3)], alpha)


def grey_to_u32(v: Column) -> Column:
    return rgba_to_dense(v, v, v, F.lit(255))


def opaque(u32: Column) -> Column:
    """Same color with alpha 255."""
    return F.pmod(u32, F.lit(16777216)) + F.lit(BLACK_DENSE)


def white_if_transparent(channel: Column, a: Column) -> Column:
    return F.when(a == 0, F.lit(255)).otherwise(channel)


def matte(channel: Column, a: Column) -> Column:
    """Blend over white, fraction cut off."""
    alpha = a / F.lit(255.0)
    return F.floor(channel * alpha + F.lit(255.0) * (F.lit(1.0) - alpha)).cast("int")


def rgba_to_lab(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Whole-number Lab (a and b shifted by 128) with the alpha byte kept."""

    def linear(c: Column) -> Column:
        v = c / F.lit(256.0)
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(
            v / 12.92
        )

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(
            t * 7.787 + 4.0 / 29.0
        )

    lr, lg, lb = linear(r), linear(g), linear(b)
    # sRGB to XYZ matrix and the D65 white point (fixed values).
    fx = f((lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.95047)
    fy = f(lr * 0.212671 + lg * 0.715160 + lb * 0.072169)
    fz = f((lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.08883)
    return F.struct(
        (fy * 116.0 - 16.0).cast("int").alias("l"),
        ((fx - fy) * 500.0 + 128.0).cast("int").alias("a"),
        ((fy - fz) * 200.0 + 128.0).cast("int").alias("b"),
        a.cast("int").alias("alpha"),
    )


def lab_or_null(lab: Column, shown: Column) -> Column:
    """Hidden colors take the out-of-range Lab code (101, 256, 256, 256)."""
    null_code = F.struct(
        *[
            F.lit(v).alias(n)
            for n, v in (("l", 101), ("a", 256), ("b", 256), ("alpha", 256))
        ]
    )
    return F.when(shown, lab).otherwise(null_code)
