"""Queries: timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.operators import timeline as T
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.registry import query

VIEW_SQL["blocks"] = """
  SELECT *, max(CASE WHEN is_start THEN frame_nr END) OVER (PARTITION BY project_id, layer ORDER BY frame_nr) AS block_start
  FROM (SELECT *, image_id IS NOT NULL AND NOT coalesce(
               lag(image_id) OVER w = image_id AND lag(frame_nr) OVER w = frame_nr - 1, false) AS is_start
        FROM frames WINDOW w AS (PARTITION BY project_id, layer ORDER BY frame_nr))"""
VIEW_SQL["dblocks"] = """
  SELECT * REPLACE (CASE WHEN drawing IS NOT NULL THEN block_start END AS block_start) FROM (
  SELECT *, max(CASE WHEN is_start THEN frame_nr END) OVER (PARTITION BY project_id, layer ORDER BY frame_nr) AS block_start
  FROM (SELECT *, drawing IS NOT NULL AND NOT coalesce(
               lag(drawing) OVER w = drawing AND lag(frame_nr) OVER w = frame_nr - 1, false) AS is_start
        FROM dkey WINDOW w AS (PARTITION BY project_id, layer ORDER BY frame_nr)))"""
VIEW_SQL["matched"] = """
  SELECT project_id, layer, frame_nr, is_original,
         CASE WHEN l IS NOT NULL AND r IS NOT NULL AND frame_nr - l > r - frame_nr THEN NULL ELSE w END AS ref_left,
         CASE WHEN l IS NOT NULL AND r IS NOT NULL AND frame_nr - l <= r - frame_nr THEN NULL ELSE r END AS ref_right,
         CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN frame_nr - l <= r - frame_nr THEN w ELSE r END
              ELSE coalesce(w, r) END AS ref_closest
  FROM (SELECT s.*, l.frame_nr AS l, coalesce(l.block_start, l.frame_nr) AS w,
               (SELECT min(frame_nr) FROM frames q WHERE q.layer = 'colorLayer1' AND q.is_original
                  AND q.project_id = s.project_id AND q.frame_nr >= s.frame_nr) AS r
        FROM (SELECT * FROM frames WHERE layer = 'colorLayer1' AND is_selected) s
        ASOF LEFT JOIN (SELECT * FROM dblocks WHERE layer = 'colorLayer1' AND is_original) l
          ON s.project_id = l.project_id AND s.frame_nr >= l.frame_nr)"""
VIEW_SQL["cels"] = """
  SELECT coalesce(l.project_id, c.project_id) AS project_id, coalesce(l.frame_nr, c.frame_nr) AS frame_nr,
         l.image_id AS line_id, c.image_id AS color_id
  FROM (SELECT * FROM frames WHERE layer = 'lineLayer1' AND image_id IS NOT NULL) l
  FULL JOIN (SELECT * FROM frames WHERE layer = 'colorLayer1' AND image_id IS NOT NULL) c
    ON l.project_id = c.project_id AND l.frame_nr = c.frame_nr"""
VIEW_SQL["ops"] = """
  SELECT project_id, frame_nr, is_original, ref_nr,
         CAST(row_number() OVER (PARTITION BY project_id ORDER BY coalesce(ref_nr, -1),
           CASE WHEN ref_nr IS NULL OR ref_nr = frame_nr THEN 0 WHEN ref_nr > frame_nr THEN 1 ELSE 2 END,
           CASE WHEN ref_nr IS NULL THEN frame_nr ELSE abs(ref_nr - frame_nr) END) - 1 AS INTEGER) AS ord
  FROM (SELECT *, CASE WHEN coalesce(ref_left, 0) <> 0 THEN ref_left ELSE ref_right END AS ref_nr FROM matched)"""
VIEW_SQL["stored"] = """
  SELECT DISTINCT image_id, image_id NOT LIKE '%signup%' AND image_id NOT LIKE '%_2' AS has_bytes
  FROM frames WHERE image_id IS NOT NULL"""
VIEW_SQL["reflines"] = """
  SELECT l.project_id, l.image_id AS line_id, arg_max(c.image_id, c.frame_nr) AS color_id
  FROM frames l JOIN frames c ON l.project_id = c.project_id AND l.frame_nr = c.frame_nr
  WHERE l.layer = 'lineLayer1' AND c.layer = 'colorLayer1' AND c.is_original
    AND l.image_id IS NOT NULL AND c.image_id IS NOT NULL GROUP BY ALL"""


def stored_images(v):
    name = F.col("image_id")
    return (
        v.frames.where("image_id is not null")
        .select("image_id", (~name.like("%signup%") & ~name.like("%_2")).alias("has_bytes"))
        .distinct()
    )


@query(
    "hold_blocks",
    """SELECT project_id, layer, block_start AS first_frame, min(image_id) AS image_id, max(frame_nr) AS last_frame,
              count(*) AS num_frames FROM blocks WHERE image_id IS NOT NULL GROUP BY project_id, layer, block_start""",
)
def hold_blocks(v):
    return T.hold_blocks(v.frames)


@query("block_start", "SELECT project_id, layer, frame_nr, drawing, block_start FROM dblocks")
def block_start(v):
    return T.block_start(T.with_drawing(v.frames), "drawing").select(
        "project_id", "layer", "frame_nr", "drawing", "block_start"
    )


@query("reference_frames", "SELECT project_id, frame_nr FROM frames WHERE layer = 'colorLayer1' AND is_original")
def reference_frames(v):
    return T.reference_frames(v.frames)


@query("match_references", "SELECT * FROM matched")
def match_references(v):
    return T.match_references(v.frames)


@query(
    "references_in_use",
    "SELECT project_id, ref_left AS ref_nr FROM matched UNION SELECT project_id, ref_right FROM matched",
)
def references_in_use(v):
    return T.references_in_use(T.match_references(v.frames))


@query("cel_at", "SELECT * FROM cels")
def cel_at(v):
    return T.cel_at(v.frames)


@query("ref_line_to_color", "SELECT * FROM reflines")
def ref_line_to_color(v):
    return T.ref_line_to_color(v.frames)


@query(
    "same_drawing",
    """SELECT project_id, layer, frame_nr, min(frame_nr) OVER w AS first_same, count(*) OVER w AS num_same
       FROM dkey WHERE drawing IS NOT NULL WINDOW w AS (PARTITION BY project_id, layer, drawing)""",
)
def same_drawing(v):
    return T.same_drawing(v.frames)


def _cuts(v):
    """One request per project and signup event: the frames at and after it."""
    marks = v.frames.where("layer = 'lineLayer1' and image_id = 'L_signup'")
    ask = F.concat_ws("/", "project_id", "frame_nr").alias("request_id")
    return marks.select(
        ask, "project_id", "layer", F.explode(F.array("frame_nr", F.col("frame_nr") + 1)).alias("frame_nr")
    )


@query(
    "frames_share_drawing",
    """SELECT request_id, count(*) = count(drawing) AND coalesce(min(drawing) = max(drawing), false) AS share
       FROM (SELECT concat_ws('/', m.project_id, m.frame_nr) AS request_id, d.drawing
             FROM frames m, (VALUES (0), (1)) t(k)
             LEFT JOIN dkey d ON d.project_id = m.project_id AND d.layer = m.layer AND d.frame_nr = m.frame_nr + k
             WHERE m.layer = 'lineLayer1' AND m.image_id = 'L_signup') GROUP BY request_id""",
)
def frames_share_drawing(v):
    return T.frames_share_drawing(v.frames, _cuts(v))


@query(
    "same_drawing_as",
    """SELECT q.project_id || '/' || q.layer AS request_id, d.project_id, d.layer, d.frame_nr
       FROM (SELECT project_id, layer, arg_min(drawing, frame_nr) AS drawing FROM (
               SELECT *, min(frame_nr) OVER (PARTITION BY project_id, layer) AS m FROM dkey) WHERE frame_nr = m GROUP BY ALL) q
       JOIN dkey d USING (project_id, layer, drawing)""",
)
def same_drawing_as(v):
    first = v.frames.groupBy("project_id", "layer").agg(F.min("frame_nr").alias("frame_nr"))
    wanted = first.withColumn("request_id", F.concat_ws("/", "project_id", "layer"))
    return T.same_drawing_as(v.frames, wanted)


@query(
    "correct_originality",
    """SELECT project_id, layer, frame_nr, image_id, is_selected,
              bool_or(is_original) OVER (PARTITION BY project_id, layer, image_id) AS is_original FROM frames""",
)
def correct_originality(v):
    return T.correct_originality(v.frames)


@query(
    "expand_selection",
    """WITH k AS (SELECT *, coalesce(drawing, 'frame:' || frame_nr) AS g FROM dkey),
       c AS (SELECT k.project_id, k.layer, k.g, arg_min(k.is_selected, e.seq) AS seen, count(*) AS n
             FROM k JOIN (SELECT event_id // 1000 AS project_id, 'lineLayer1' AS layer, event_id % 1000 + 1 AS frame_nr, event_id AS seq
                          FROM events WHERE value > 200) e
               ON k.project_id = e.project_id AND k.layer = e.layer AND k.frame_nr = e.frame_nr GROUP BY ALL)
       SELECT k.project_id, k.layer, k.frame_nr, k.image_id, k.is_original,
              CASE WHEN c.n IS NULL THEN k.is_selected WHEN c.n % 2 = 1 THEN NOT c.seen ELSE c.seen END AS is_selected
       FROM k LEFT JOIN c USING (project_id, layer, g)""",
)
def expand_selection(v):
    clicks = v.table("events").where("value > 200").selectExpr(
        "event_id div 1000 as project_id", "'lineLayer1' as layer",
        "cast(event_id % 1000 as int) + 1 as frame_nr", "event_id as seq",
    )
    return T.expand_selection(v.frames, clicks)


@query(
    "add_ghosts",
    """SELECT project_id, layer, frame_nr, image_id, is_original, is_selected FROM frames
       UNION ALL
       SELECT f.project_id, CASE f.layer WHEN 'lineLayer1' THEN 'colorLayer1' ELSE 'lineLayer1' END, f.frame_nr,
              f.image_id || CASE f.layer WHEN 'lineLayer1' THEN '_color' ELSE '_line' END, false, false
       FROM frames f LEFT JOIN frames o ON o.project_id = f.project_id AND o.frame_nr = f.frame_nr AND o.layer <> f.layer
       WHERE f.image_id IS NOT NULL AND o.frame_nr IS NULL""",
)
def add_ghosts(v):
    return T.add_ghosts(v.frames)


@query(
    "cel_changes",
    """WITH t AS (SELECT f.project_id, f.n AS frame_nr,
                  CASE WHEN c.frame_nr IS NULL THEN NULL ELSE coalesce(line_id, 'line-null') || '|' || coalesce(color_id, 'color-null') END AS id,
                  f.asked
             FROM (SELECT p.project_id, n, bool_or(f.frame_nr IS NOT NULL) AS asked
                   FROM (SELECT project_id, max(frame_nr) AS m FROM frames GROUP BY 1) p, range(0, p.m + 2) r(n)
                   LEFT JOIN frames f ON f.project_id = p.project_id AND f.frame_nr = n GROUP BY ALL) f
             LEFT JOIN cels c ON c.project_id = f.project_id AND c.frame_nr = f.n),
       u AS (SELECT *, CASE WHEN frame_nr > 0 AND id IS DISTINCT FROM lag(id) OVER (PARTITION BY project_id ORDER BY frame_nr) THEN frame_nr END AS chg FROM t)
       SELECT project_id, CAST(frame_nr AS INTEGER) AS frame_nr, CAST(prev AS INTEGER) AS prev_change, CAST(nxt AS INTEGER) AS next_change FROM (
         SELECT *, max(chg) OVER (PARTITION BY project_id ORDER BY frame_nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
                min(chg) OVER (PARTITION BY project_id ORDER BY frame_nr ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM u)
       WHERE asked""",
)
def cel_changes(v):
    return T.cel_changes(v.frames)


@query(
    "unique_drawings",
    """SELECT *, row_number() OVER (PARTITION BY project_id, layer ORDER BY first_frame) - 1 AS drawing_pos FROM (
         SELECT project_id, layer, image_id, min(frame_nr) AS first_frame, count(*) AS num_frames
         FROM frames WHERE image_id IS NOT NULL GROUP BY ALL)""",
)
def unique_drawings(v):
    return T.unique_drawings(v.frames)


@query(
    "is_unique_drawing",
    "SELECT project_id, layer, image_id, count(*) = 1 AS is_unique FROM frames WHERE image_id IS NOT NULL GROUP BY ALL",
)
def is_unique_drawing(v):
    return T.drawing_uses(v.frames)


@query(
    "frame_extent",
    """SELECT project_id, min(frame_nr) FILTER (image_id IS NOT NULL) AS first_real,
              max(frame_nr) FILTER (image_id IS NOT NULL) AS last_real FROM frames GROUP BY project_id""",
)
def frame_extent(v):
    return T.frame_extent(v.frames)


@query("order_ops", "SELECT * FROM ops")
def order_ops(v):
    return T.order_ops(T.match_references(v.frames))


@query(
    "in_between_ref",
    """SELECT o.project_id, o.frame_nr, o.ref_nr, o.ord, arg_max(d.frame_nr, abs(d.frame_nr - o.ref_nr) * 10000 - d.frame_nr) AS in_between
       FROM (SELECT * FROM ops WHERE NOT is_original AND ref_nr IS NOT NULL) o
       LEFT JOIN (SELECT * FROM ops WHERE NOT is_original) d ON d.project_id = o.project_id AND d.ord < o.ord
         AND d.frame_nr BETWEEN least(o.frame_nr, o.ref_nr) AND greatest(o.frame_nr, o.ref_nr)
       GROUP BY ALL""",
)
def in_between_ref(v):
    return T.in_between_ref(T.order_ops(T.match_references(v.frames)).where("not is_original"))


@query(
    "plan_colorize",
    """WITH c AS (SELECT o.*, CASE WHEN o.is_original THEN NULL WHEN coalesce(o.ref_nr, 0) = 0 THEN 'NO_REFERENCE'
                        WHEN l.frame_nr IS NULL THEN 'REF_LINE_MISSING' END AS bad
                  FROM ops o LEFT JOIN frames l ON l.layer = 'lineLayer1' AND l.project_id = o.project_id AND l.frame_nr = o.ref_nr),
       e AS (SELECT project_id, arg_min(bad, ord) AS error, arg_min(frame_nr, ord) AS error_frame FROM c WHERE bad IS NOT NULL GROUP BY 1)
       SELECT project_id, frame_nr, is_original, ref_nr, ord, NULL::VARCHAR AS error, NULL::INTEGER AS error_frame FROM c
       WHERE project_id NOT IN (SELECT project_id FROM e)
       UNION ALL SELECT project_id, NULL, NULL, NULL, NULL, error, error_frame FROM e""",
)
def plan_colorize(v):
    return T.plan_colorize(T.match_references(v.frames), v.frames)


@query(
    "dedupe_ops",
    """SELECT o.project_id, o.frame_nr, l.image_id AS line_id, r.color_id AS seeded_color,
              CASE WHEN r.color_id IS NULL THEN first_value(o.frame_nr) OVER w END AS run_frame,
              r.color_id IS NULL AND first_value(o.frame_nr) OVER w = o.frame_nr AS runs
       FROM ops o JOIN frames l ON l.project_id = o.project_id AND l.frame_nr = o.frame_nr AND l.layer = 'lineLayer1'
       LEFT JOIN reflines r ON r.project_id = o.project_id AND r.line_id = l.image_id
       WHERE l.image_id IS NOT NULL AND NOT o.is_original
       WINDOW w AS (PARTITION BY o.project_id, l.image_id ORDER BY o.ord)""",
)
def dedupe_ops(v):
    return T.dedupe_ops(T.order_ops(T.match_references(v.frames)), v.frames)


VIEW_SQL["bcels"] = """
  SELECT c.project_id, c.frame_nr, CASE WHEN sl.has_bytes THEN c.line_id END AS line_id,
         CASE WHEN sc.has_bytes THEN c.color_id END AS color_id, f.is_original
  FROM cels c LEFT JOIN stored sl ON sl.image_id = c.line_id LEFT JOIN stored sc ON sc.image_id = c.color_id
  LEFT JOIN frames f ON f.project_id = c.project_id AND f.frame_nr = c.frame_nr AND f.layer = 'colorLayer1'"""
VIEW_SQL["celnames"] = """
  SELECT project_id, 'c' || row_number() OVER (PARTITION BY project_id ORDER BY min(frame_nr)) AS cel_id, line_id, color_id,
         CASE WHEN color_id IS NULL THEN 'none' WHEN arg_min(is_original, frame_nr) THEN 'reference' ELSE 'colorized' END AS provenance
  FROM bcels GROUP BY project_id, line_id, color_id"""


@query("derive_cels", "SELECT * FROM celnames")
def derive_cels(v):
    return T.derive_cels(v.frames, stored_images(v))[0]


@query(
    "exposures",
    """SELECT b.project_id, b.frame_nr, n.cel_id, t.track FROM bcels b
       JOIN celnames n ON n.project_id = b.project_id AND n.line_id IS NOT DISTINCT FROM b.line_id AND n.color_id IS NOT DISTINCT FROM b.color_id
       JOIN (VALUES ('line'), ('color')) t(track) ON (track = 'line' AND b.line_id IS NOT NULL) OR (track = 'color' AND b.color_id IS NOT NULL)""",
)
def exposures(v):
    return T.derive_cels(v.frames, stored_images(v))[1]


VIEW_SQL["stored_after"] = """
  SELECT image_id, has_bytes AND image_id NOT IN (SELECT image_id FROM frames WHERE is_selected AND image_id IS NOT NULL AND frame_nr > 900) AS has_bytes
  FROM stored"""


def _late_selection(v):
    """Only late frames stay selected, so that some bytes survive the deletion."""
    return v.frames.withColumn("is_selected", F.col("is_selected") & (F.col("frame_nr") > 900))


@query(
    "delete_frames",
    """WITH f AS (SELECT * REPLACE (is_selected AND frame_nr > 900 AS is_selected) FROM frames),
       n AS (SELECT project_id, frame_nr, bool_or(is_selected) AS hit, bool_or(coalesce(s.has_bytes, false)) AS kept
             FROM f LEFT JOIN stored_after s USING (image_id) GROUP BY ALL)
       SELECT f.project_id, f.layer, f.frame_nr, f.image_id,
              f.is_original AND NOT (f.layer = 'colorLayer1' AND (f.is_selected OR (n.hit AND NOT coalesce(s.has_bytes, false)))) AS is_original,
              false AS is_selected
       FROM f JOIN n USING (project_id, frame_nr) LEFT JOIN stored_after s USING (image_id) WHERE NOT n.hit OR n.kept""",
)
def delete_frames(v):
    return T.delete_frames(_late_selection(v), stored_images(v))[0]


@query("delete_frames_images", "SELECT * FROM stored_after")
def delete_frames_images(v):
    return T.delete_frames(_late_selection(v), stored_images(v))[1]


def _changes(v):
    return v.table("events").selectExpr(
        "user_id % 7 as project_id", "if(event_type in ('view', 'click'), 'lineLayer1', 'colorLayer1') as layer",
        "cast(user_id div 7 as int) + 1 as frame_nr", "event_id as seq",
        "concat('N_', cast(event_id as string)) as image_id", "value > 90 as is_original",
        "event_type = 'error' and value < 12 as force",
    )


@query(
    "upsert_frames",
    """WITH RECURSIVE ch AS (
         SELECT user_id % 7 AS project_id, CASE WHEN event_type IN ('view', 'click') THEN 'lineLayer1' ELSE 'colorLayer1' END AS layer,
                CAST(user_id // 7 AS INTEGER) + 1 AS frame_nr, event_id AS seq, 'N_' || event_id AS image_id, value > 90 AS is_original,
                event_type = 'error' AND value < 12 AS force FROM events),
       q AS (SELECT *, row_number() OVER (PARTITION BY project_id, layer, frame_nr ORDER BY seq) AS k FROM ch),
       keys AS (SELECT DISTINCT project_id, layer, frame_nr FROM q UNION SELECT project_id, layer, frame_nr FROM frames),
       go AS (
         SELECT k.project_id, k.layer, k.frame_nr, 0::BIGINT AS k, f.image_id, coalesce(f.is_original, false) AS is_original, coalesce(f.is_selected, false) AS is_selected
         FROM keys k LEFT JOIN frames f USING (project_id, layer, frame_nr)
         UNION ALL
         SELECT g.project_id, g.layer, g.frame_nr, q.k,
                CASE WHEN g.is_original AND NOT q.force THEN g.image_id ELSE q.image_id END,
                CASE WHEN g.is_original AND NOT q.force THEN g.is_original ELSE q.is_original END, g.is_selected
         FROM go g JOIN q ON q.project_id = g.project_id AND q.layer = g.layer AND q.frame_nr = g.frame_nr AND q.k = g.k + 1)
       SELECT project_id, layer, frame_nr, arg_max(image_id, k) FILTER (image_id IS NOT NULL OR k = 0) AS image_id,
              arg_max(is_original, k) AS is_original, any_value(is_selected) AS is_selected FROM go GROUP BY project_id, layer, frame_nr""",
)
def upsert_frames(v):
    return T.upsert_frames(v.frames, _changes(v))


@query(
    "recolor_targets",
    """WITH seeds AS (SELECT project_id, max(image_id) AS image_id FROM frames WHERE layer = 'colorLayer1' AND image_id IS NOT NULL GROUP BY 1),
       b AS (SELECT image_id FROM stored WHERE has_bytes),
       t AS (SELECT project_id, image_id, -1 AS first_frame FROM seeds WHERE image_id IN (SELECT image_id FROM b)
             UNION ALL
             SELECT f.project_id, f.image_id, min(frame_nr) FROM frames f LEFT JOIN seeds s USING (project_id, image_id)
             WHERE layer = 'colorLayer1' AND f.image_id IN (SELECT image_id FROM b) AND s.image_id IS NULL GROUP BY ALL)
       SELECT project_id, image_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY first_frame) - 1 AS INTEGER) AS pos FROM t""",
)
def recolor_targets(v):
    seeds = v.frames.where("layer = 'colorLayer1' and image_id is not null").groupBy("project_id").agg(
        F.max("image_id").alias("image_id")
    )
    return T.recolor_targets(v.frames, stored_images(v), seeds)
