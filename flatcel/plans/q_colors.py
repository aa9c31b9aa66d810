"""Queries: segment colors, palettes, color functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.functions import color as C
from flatcel.operators import segments as S
from flatcel.plans.registry import query

LSEG = "SELECT * FROM lseg"


@query(
    "segment_colors",
    "SELECT frame_id, seg_id, color, status, num_pixels, round(peakiness, 6) AS peakiness FROM lseg",
)
def segment_colors(v):
    return S.segment_colors(v.lpix).withColumn("peakiness", F.round("peakiness", 6))


@query(
    "peakiness",
    """SELECT frame_id, seg_id, round(kurtosis_pop(n) + 3, 6) AS peak
       FROM (SELECT frame_id, seg_id, r, g, b, count(*) AS n FROM lpix GROUP BY ALL) GROUP BY ALL""",
)
def peakiness(v):
    counts = v.lpix.groupBy("frame_id", "seg_id", "r", "g", "b").agg(F.count("*").alias("n"))
    return counts.groupBy("frame_id", "seg_id").agg(F.round(S.peakiness(F.col("n")), 6).alias("peak"))


@query(
    "segment_stats",
    """SELECT frame_id, count(*) AS num_total_segs,
              count(*) FILTER (status = 'multi_color') AS num_multi_color_segs,
              count(*) FILTER (status = 'over_thresholded') AS num_over_thresholded_segs,
              count(*) FILTER (status = 'transparent') AS num_transparent_segs,
              count(*) FILTER (status = 'black') AS num_black_segs
       FROM lseg GROUP BY frame_id""",
)
def segment_stats(v):
    return S.segment_stats(v.segments)


@query(
    "drop_empty_keyframes",
    """SELECT frame_id, count(*) AS num_total_segs FROM (
         SELECT DISTINCT l_orderkey * 100 + l_linenumber AS frame_id, l_partkey % 5 AS seg_id FROM lineitem)
       GROUP BY frame_id HAVING count(*) > 1""",
)
def drop_empty_keyframes(v):
    segs = (
        v.table("lineitem")
        .selectExpr("l_orderkey * 100 + l_linenumber as frame_id", "l_partkey % 5 as seg_id", "'normal' as status")
        .distinct()
    )
    return S.drop_empty_keyframes(S.segment_stats(segs)).select("frame_id", "num_total_segs")


PALETTE = """
  SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY frame_idx, seg_id) - 1 AS INTEGER) AS color_id, color
  FROM (SELECT frame_id // 10 AS project_id, color, min(frame_id * 1000 + seg_id) // 1000 AS frame_idx,
               min(frame_id * 1000 + seg_id) % 1000 AS seg_id FROM lseg GROUP BY frame_id // 10, color)"""


def _project_segments(v):
    return v.segments.select(
        F.expr("frame_id div 10").alias("project_id"), F.col("frame_id").alias("frame_idx"), "seg_id", "color"
    )


@query("build_palette", PALETTE)
def build_palette(v):
    return S.build_palette(_project_segments(v))


@query(
    "frame_color_ids",
    f"""WITH pal AS ({PALETTE})
        SELECT p.project_id, frame_id AS frame_idx, seg_id,
               CASE WHEN s.color = -100 THEN -100 ELSE color_id END AS color_id
        FROM lseg s JOIN pal p ON p.project_id = frame_id // 10 AND p.color = s.color""",
)
def frame_color_ids(v):
    segs = _project_segments(v)
    return S.frame_color_ids(segs, S.build_palette(segs))


@query(
    "build_palette_unique",
    """SELECT frame_id // 10 AS project_id, frame_id AS frame_idx, seg_id,
              CAST(row_number() OVER (PARTITION BY frame_id // 10 ORDER BY frame_id, seg_id) - 1 AS INTEGER) AS slot,
              color, CASE WHEN color = -100 THEN -100 ELSE seg_id END AS color_id FROM lseg""",
)
def build_palette_unique(v):
    return S.build_palette_unique(_project_segments(v))


@query(
    "ids_to_colors",
    f"""WITH pal AS ({PALETTE}), ids AS (
          SELECT p.project_id, frame_id AS frame_idx, seg_id,
                 CASE WHEN s.color = -100 THEN -100 ELSE color_id END AS color_id
          FROM lseg s JOIN pal p ON p.project_id = frame_id // 10 AND p.color = s.color)
        SELECT i.*, CASE WHEN i.color_id = -100 THEN -100 ELSE color END AS dense,
               CASE WHEN i.color_id = -100 THEN -100 ELSE color & 255 END AS r,
               CASE WHEN i.color_id = -100 THEN -100 ELSE (color >> 8) & 255 END AS g,
               CASE WHEN i.color_id = -100 THEN -100 ELSE (color >> 16) & 255 END AS b,
               CASE WHEN i.color_id = -100 THEN -100 ELSE (color >> 24) & 255 END AS a
        FROM ids i LEFT JOIN pal p ON p.project_id = i.project_id AND p.color_id = i.color_id""",
)
def ids_to_colors(v):
    segs = _project_segments(v)
    palette = S.build_palette(segs)
    return S.ids_to_colors(S.frame_color_ids(segs, palette), palette)


@query(
    "render_segments",
    """SELECT frame_id, p.seg_id, CASE WHEN color = -100 THEN 0 ELSE color & 255 END AS r,
              CASE WHEN color = -100 THEN 0 ELSE (color >> 8) & 255 END AS g,
              CASE WHEN color = -100 THEN 0 ELSE (color >> 16) & 255 END AS b,
              CASE WHEN color = -100 THEN 0 ELSE (color >> 24) & 255 END AS a
       FROM lpix p JOIN lseg s USING (frame_id, seg_id)""",
)
def render_segments(v):
    return S.render_segments(v.lpix.select("frame_id", "seg_id"), v.segments, keys=("frame_id", "seg_id"))


@query(
    "segment_limit",
    """SELECT frame_id, count(DISTINCT l_partkey) AS num_segments, count(DISTINCT l_partkey) > 255 AS too_many
       FROM (SELECT l_suppkey AS frame_id, l_partkey FROM lineitem) GROUP BY frame_id""",
)
def segment_limit(v):
    return S.segment_limit(v.table("lineitem").selectExpr("l_suppkey as frame_id", "l_partkey as seg_id"))


@query(
    "check_contiguous",
    """SELECT frame_id, count(DISTINCT seg_id) = max(seg_id) - min(seg_id) + 1 AS contiguous
       FROM (SELECT l_suppkey * 10 + l_linenumber AS frame_id, l_partkey % 50 AS seg_id FROM lineitem)
       GROUP BY frame_id""",
)
def check_contiguous(v):
    return S.check_contiguous(
        v.table("lineitem").selectExpr("l_suppkey * 10 + l_linenumber as frame_id", "l_partkey % 50 as seg_id")
    )


@query(
    "mask_new_colors",
    """SELECT t.pair_id, t.seg_id, CASE WHEN s.color_id IS NULL THEN -100 ELSE t.color_id END AS color_id
       FROM (SELECT vec_id // 10 AS pair_id, vec_id AS seg_id, label AS color_id FROM embeddings WHERE vec_id % 2 = 1) t
       LEFT JOIN (SELECT DISTINCT vec_id // 10 AS pair_id, label AS color_id FROM embeddings WHERE vec_id % 2 = 0) s
         ON s.pair_id = t.pair_id AND s.color_id = t.color_id""",
)
def mask_new_colors(v):
    e = v.table("embeddings")
    cols = ["vec_id div 10 as pair_id", "vec_id as seg_id", "label as color_id"]
    return S.mask_new_colors(e.where("vec_id % 2 = 1").selectExpr(*cols), e.where("vec_id % 2 = 0").selectExpr(*cols))


@query(
    "new_ids",
    """SELECT DISTINCT vec_id // 10 AS pair_id, label AS color_id FROM embeddings WHERE vec_id % 2 = 1
       EXCEPT SELECT vec_id // 10, label FROM embeddings WHERE vec_id % 2 = 0""",
)
def new_ids(v):
    e = v.table("embeddings")
    cols = ["vec_id div 10 as pair_id", "label as color_id"]
    return S.new_ids(e.where("vec_id % 2 = 1").selectExpr(*cols), e.where("vec_id % 2 = 0").selectExpr(*cols))


@query(
    "mask_null_colors",
    """SELECT i.frame_id, i.seg_id, CASE WHEN p.seg_id IS NULL THEN -100 ELSE i.color_id END AS color_id
       FROM (SELECT s_suppkey AS frame_id, k AS seg_id, CASE WHEN k % 7 = 0 THEN -100 ELSE k % 5 END AS color_id
             FROM supplier, range(0, 60) t(k)) i
       LEFT JOIN (SELECT DISTINCT frame_id, seg_id FROM lpix) p ON p.frame_id = i.frame_id AND p.seg_id = i.seg_id""",
)
def mask_null_colors(v):
    ids = (
        v.table("supplier")
        .select(F.col("s_suppkey").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("seg_id"))
        .withColumn("color_id", F.when(F.col("seg_id") % 7 == 0, -100).otherwise(F.col("seg_id") % 5))
    )
    return S.mask_null_colors(ids, v.lpix)


@query(
    "color_packing",
    """SELECT frame_id, seg_id, r, g, b, a, count(*) AS n,
              CAST(r + 256 * g + 65536 * b + CAST(16777216 AS BIGINT) * a AS BIGINT) AS dense,
              CAST(a + 256 * b + 65536 * g + CAST(16777216 AS BIGINT) * r AS BIGINT) AS label,
              CAST(r + 256 * r + 65536 * r + 4278190080 AS BIGINT) AS grey_u32,
              CAST(r + 256 * g + 65536 * b + 4278190080 AS BIGINT) AS opaque,
              '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0')
                  || lpad(lower(to_hex(a)), 2, '0') AS hex
       FROM lpix GROUP BY frame_id, seg_id, r, g, b, a""",
)
def color_packing(v):
    r, g, b, a = (F.col(c) for c in "rgba")
    return (
        v.lpix.groupBy("frame_id", "seg_id", "r", "g", "b", "a")
        .agg(F.count("*").alias("n"))
        .withColumns(
            {
                "dense": C.rgba_to_dense(r, g, b, a),
                "label": C.rgba_to_label(r, g, b, a),
                "grey_u32": C.grey_to_u32(r),
                "opaque": C.opaque(C.rgba_to_dense(r, g, b, a)),
                "hex": C.rgba_to_hex(r, g, b, a),
            }
        )
    )


@query(
    "color_unpacking",
    """SELECT seg_id, frame_id, color, color & 255 AS r, (color >> 8) & 255 AS g, (color >> 16) & 255 AS b,
              (color >> 24) & 255 AS a,
              CASE WHEN color = -100 THEN 255 ELSE (color >> 24) & 255 END AS lr,
              CASE WHEN color = -100 THEN 255 ELSE (color >> 16) & 255 END AS lg,
              CASE WHEN color = -100 THEN 255 ELSE (color >> 8) & 255 END AS lb,
              CASE WHEN color = -100 THEN 255 ELSE color & 255 END AS la
       FROM lseg""",
)
def color_unpacking(v):
    d = F.col("color")
    out = v.segments.select("seg_id", "frame_id", "color", C.dense_to_rgba(d).alias("d"), C.label_to_rgba(d).alias("l"))
    return out.select(
        "seg_id", "frame_id", "color", "d.*", *[F.col(f"l.{c}").alias(f"l{c}") for c in "rgba"]
    )


@query(
    "hex_to_rgb",
    """SELECT project_id, pos, CAST('0x' || hex[2:3] AS INTEGER) AS r, CAST('0x' || hex[4:5] AS INTEGER) AS g,
              CAST('0x' || hex[6:7] AS INTEGER) AS b FROM swatches""",
)
def hex_to_rgb(v):
    return v.swatches.select("project_id", "pos", C.hex_to_rgb(F.col("hex")).alias("c")).select(
        "project_id", "pos", "c.*"
    )


@query(
    "matte_white",
    """SELECT image_id, y, x, CAST(floor(r * (a / 255.0::DOUBLE) + 255.0::DOUBLE * (1.0::DOUBLE - a / 255.0::DOUBLE)) AS INTEGER) AS matte_r,
              CAST(floor(g * (a / 255.0::DOUBLE) + 255.0::DOUBLE * (1.0::DOUBLE - a / 255.0::DOUBLE)) AS INTEGER) AS matte_g,
              CASE WHEN a = 0 THEN 255 ELSE r END AS white_r, CASE WHEN a = 0 THEN 255 ELSE b END AS white_b
       FROM grid""",
)
def matte_white(v):
    a = F.col("a")
    return v.grid.select(
        "image_id", "y", "x",
        C.matte(F.col("r"), a).alias("matte_r"), C.matte(F.col("g"), a).alias("matte_g"),
        C.white_if_transparent(F.col("r"), a).alias("white_r"),
        C.white_if_transparent(F.col("b"), a).alias("white_b"),
    )


def _lab_sql() -> str:
    lin = "CASE WHEN {c} / 256.0::DOUBLE > 0.04045 THEN pow(({c} / 256.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 256.0::DOUBLE / 12.92 END"
    f = "CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3.0) ELSE {t} * 7.787 + 4.0::DOUBLE / 29.0 END"
    return f"""
      WITH lin AS (SELECT image_id, y, x, a, is_line, {lin.format(c='r')} AS lr, {lin.format(c='g')} AS lg, {lin.format(c='b')} AS lb FROM grid),
      xyz AS (SELECT *, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.95047::DOUBLE AS tx,
                     lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE AS ty,
                     (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.08883::DOUBLE AS tz FROM lin),
      converted AS (SELECT image_id, y, x, a, is_line, {f.format(t='tx')} AS fx, {f.format(t='ty')} AS fy, {f.format(t='tz')} AS fz FROM xyz)
      SELECT image_id, y, x, CASE WHEN is_line THEN 101 ELSE CAST(trunc(fy * 116.0 - 16.0) AS INTEGER) END AS l,
             CASE WHEN is_line THEN 256 ELSE CAST(trunc((fx - fy) * 500.0 + 128.0) AS INTEGER) END AS a,
             CASE WHEN is_line THEN 256 ELSE CAST(trunc((fy - fz) * 200.0 + 128.0) AS INTEGER) END AS b,
             CASE WHEN is_line THEN 256 ELSE a END AS alpha FROM converted"""


@query("rgba_to_lab", _lab_sql())
def rgba_to_lab(v):
    lab = C.lab_or_null(C.rgba_to_lab(*[F.col(c) for c in "rgba"]), ~F.col("is_line"))
    return v.grid.select("image_id", "y", "x", lab.alias("lab")).select("image_id", "y", "x", "lab.*")
