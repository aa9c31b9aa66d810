"""Queries: palettes, recoloring, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.functions.color import rgba_to_dense
from flatcel.operators import export as E
from flatcel.operators import palette as P
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.registry import query
from flatcel.session import cut_lineage


def _u32(hex_, alpha):
    return (
        f"CAST(CAST('0x' || {hex_}[2:3] AS BIGINT) + 256 * CAST('0x' || {hex_}[4:5] AS BIGINT)"
        f" + 65536 * CAST('0x' || {hex_}[6:7] AS BIGINT) + 16777216 * CAST({alpha} AS BIGINT) AS BIGINT)"
    )


VIEW_SQL["changed"] = """
  SELECT * REPLACE (CASE WHEN new_visible THEN new_opacity ELSE 0 END AS new_opacity) FROM nswatches
  WHERE hex <> new_hex OR opacity <> new_opacity OR visible <> new_visible"""
VIEW_SQL["mapping"] = f"""
  SELECT project_id, pos, {_u32('hex', 'opacity')} AS old_u32, {_u32('new_hex', 'new_opacity')} AS new_u32 FROM changed"""


@query("normalise_swatches", "SELECT * FROM nswatches")
def normalise_swatches(v):
    return P.normalise_swatches(v.swatches)


@query("changed_swatches", "SELECT * FROM changed WHERE selected")
def changed_swatches(v):
    return P.changed_swatches(v.swatches, all_frames=False)


@query("recolor_mapping", "SELECT * FROM mapping")
def recolor_mapping(v):
    return P.recolor_mapping(v.swatches)



@query(
    "compose_mapping",
    """WITH RECURSIVE m AS (
         SELECT p_partkey // 200 AS project_id, p_partkey AS pos, CAST(p_partkey % 60 AS BIGINT) AS old_u32, CAST(p_size AS BIGINT) AS new_u32 FROM part),
       walk AS (
         SELECT project_id, old_u32 AS start, min(pos) AS pos, arg_min(new_u32, pos) AS cur FROM m GROUP BY ALL
         UNION ALL
         SELECT w.project_id, w.start, n.pos, n.new_u32
         FROM walk w, LATERAL (SELECT pos, new_u32 FROM m WHERE m.project_id = w.project_id AND m.old_u32 = w.cur AND m.pos > w.pos ORDER BY pos LIMIT 1) n)
       SELECT project_id, start AS old_u32, arg_max(cur, pos) AS new_u32 FROM walk GROUP BY ALL""",
)
def compose_mapping(v):
    mapping = v.table("part").selectExpr(
        "p_partkey div 200 as project_id", "p_partkey as pos", "cast(p_partkey % 60 as bigint) as old_u32",
        "cast(p_size as bigint) as new_u32",
    )
    return P.compose_mapping(mapping)


@query(
    "recolor_pixels",
    """WITH RECURSIVE walk AS (
         SELECT project_id, old_u32 AS start, min(pos) AS pos, arg_min(new_u32, pos) AS cur FROM mapping GROUP BY ALL
         UNION ALL
         SELECT w.project_id, w.start, n.pos, n.new_u32
         FROM walk w, LATERAL (SELECT pos, new_u32 FROM mapping m WHERE m.project_id = w.project_id AND m.old_u32 = w.cur AND m.pos > w.pos ORDER BY pos LIMIT 1) n),
       fin AS (SELECT project_id, start, arg_max(cur, pos) AS cur FROM walk GROUP BY ALL),
       px AS (SELECT l_orderkey, l_linenumber, s.project_id, """
    + _u32("s.hex", "coalesce(s.opacity, 255)")
    + """ AS u32 FROM lineitem JOIN swatches s ON s.project_id = l_partkey // 100 AND s.pos = l_partkey % 100)
       SELECT l_orderkey, l_linenumber, px.project_id, coalesce(cur, u32) AS u32 FROM px
       LEFT JOIN fin ON fin.project_id = px.project_id AND fin.start = px.u32""",
)
def recolor_pixels(v):
    from flatcel.functions.color import hex_to_u32

    colors = v.swatches.select(
        "project_id", "pos", hex_to_u32(F.col("hex"), F.coalesce("opacity", F.lit(255))).alias("u32")
    )
    pixels = (
        v.table("lineitem")
        .selectExpr("l_orderkey", "l_linenumber", "l_partkey div 100 as project_id", "cast(l_partkey % 100 as int) as pos")
        .join(colors, ["project_id", "pos"])
        .drop("pos")
    )
    return P.recolor_pixels(pixels, P.compose_mapping(P.recolor_mapping(v.swatches)))


VIEW_SQL["responses"] = """
  SELECT p_partkey // 100 AS project_id, p_partkey AS seq,
         CASE p_size % 4
           WHEN 0 THEN '{"ref_palette_rgba":[[' || p_size || ',10,20,255],[1,2,3,0]],"palette":[[9,9,9,255]]}'
           WHEN 1 THEN '{"target_palette_rgba":null,"palette_rgba":[{"r":' || p_size || ',"g":1,"b":' || (p_partkey % 7) || '}]}'
           WHEN 2 THEN '{"colors_rgba":[[' || (p_partkey % 9) || ',0,0,128]]}'
           ELSE '{"status":"none"}' END AS response
  FROM part"""


def _responses(v):
    return v.table("part").select(
        F.expr("p_partkey div 100").alias("project_id"),
        F.col("p_partkey").alias("seq"),
        F.expr(
            """case p_size % 4
                 when 0 then concat('{"ref_palette_rgba":[[', p_size, ',10,20,255],[1,2,3,0]],"palette":[[9,9,9,255]]}')
                 when 1 then concat('{"target_palette_rgba":null,"palette_rgba":[{"r":', p_size, ',"g":1,"b":', p_partkey % 7, '}]}')
                 when 2 then concat('{"colors_rgba":[[', p_partkey % 9, ',0,0,128]]}')
                 else '{"status":"none"}' end"""
        ).alias("response"),
    )


VIEW_SQL["entries"] = """
  SELECT project_id, seq * 100 + i AS seq, CAST(coalesce(e->>'r', e->>0) AS INTEGER) AS r, CAST(coalesce(e->>'g', e->>1) AS INTEGER) AS g,
         CAST(coalesce(e->>'b', e->>2) AS INTEGER) AS b, CAST(coalesce(e->>'a', e->>3, '255') AS INTEGER) AS a
  FROM (SELECT project_id, seq, unnest(arr) AS e, unnest(range(len(arr))) AS i FROM (
    SELECT project_id, seq, CAST(coalesce(nullif(json_extract(response, '$.ref_palette_rgba'), 'null'), nullif(json_extract(response, '$.target_palette_rgba'), 'null'),
           nullif(json_extract(response, '$.palette_rgba'), 'null'), nullif(json_extract(response, '$.palette'), 'null'), nullif(json_extract(response, '$.colors_rgba'), 'null')) AS JSON[]) AS arr
    FROM responses))"""


def _entries(v):
    return (
        _responses(v)
        .select("project_id", "seq", F.posexplode(P.response_palette(F.col("response"))).alias("i", "e"))
        .select("project_id", (F.col("seq") * 100 + F.col("i")).alias("seq"), P.palette_entry(F.col("e")).alias("c"))
        .select("project_id", "seq", "c.*")
    )


@query("extract_palette", "SELECT * FROM entries")
def extract_palette(v):
    return _entries(v)


@query(
    "merge_palette",
    """SELECT project_id, min(seq) AS seq, hex, hex AS new_hex, true AS visible, true AS new_visible, false AS selected, 255 AS opacity, 255 AS new_opacity
       FROM (SELECT project_id, seq, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS hex FROM entries WHERE a <> 0) n
       WHERE NOT EXISTS (SELECT 1 FROM swatches s WHERE s.project_id = n.project_id AND s.hex = n.hex) GROUP BY project_id, hex""",
)
def merge_palette(v):
    return P.merge_palette(v.swatches, _entries(v))


@query(
    "commit_palette",
    """SELECT project_id, new_hex AS hex, min(pos) AS pos, arg_min(new_opacity, pos) AS opacity, true AS visible
       FROM nswatches WHERE new_visible GROUP BY project_id, new_hex""",
)
def commit_palette(v):
    return P.commit_palette(v.swatches)


@query(
    "palette_filter",
    """SELECT image_id, y, x, is_line, inside, CASE WHEN m THEN r ELSE 0 END AS r, CASE WHEN m THEN g ELSE 0 END AS g,
              CASE WHEN m THEN b ELSE 0 END AS b, CASE WHEN m THEN 200 ELSE 0 END AS a
       FROM (SELECT *, r = 220 AND g = 40 AND b = 60 AS m FROM grid)""",
)
def palette_filter(v):
    return P.palette_filter(v.grid, "#dc283c", opacity=200)


VIEW_SQL["gridpal"] = """
  SELECT image_id AS project_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS INTEGER) AS pos,
         '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS hex,
         r <> 30 AS visible, 100 + g AS opacity FROM (SELECT DISTINCT image_id, r, g, b FROM grid)"""


@query(
    "palette_passes",
    """SELECT g.image_id AS project_id, y, x, r, g, b, s.pos AS pass, s.opacity AS a FROM grid g JOIN gridpal s
         ON s.project_id = g.image_id AND s.visible AND s.opacity <> 0
        AND s.hex = '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0')""",
)
def palette_passes(v):
    from pyspark.sql import Window

    from flatcel.functions.color import rgba_to_hex

    rgb = [F.col(c) for c in "rgb"]
    # At most 16.7 million colors per image, in practice a few dozen.
    swatches = v.grid.select("image_id", "r", "g", "b").distinct().select(
        F.col("image_id").alias("project_id"),
        (F.row_number().over(Window.partitionBy("image_id").orderBy("r", "g", "b")) - 1).alias("pos"),
        rgba_to_hex(*rgb).alias("hex"),
        (F.col("r") != 30).alias("visible"),
        (F.col("g") + 100).alias("opacity"),
        F.lit(None).cast("boolean").alias("new_visible"),
        F.lit(None).cast("int").alias("new_opacity"),
    )
    pixels = v.grid.select(F.col("image_id").alias("project_id"), "y", "x", "r", "g", "b", "a")
    return P.palette_passes(pixels, swatches)


VIEW_SQL["xsettings"] = """
  SELECT DISTINCT event_id // 1000 AS project_id, event_id // 1000 % 4 <> 3 AS line_visible, event_id // 1000 % 2 = 0 AS color_visible,
         event_id // 1000 % 3 = 1 AS separated FROM events"""
VIEW_SQL["xplan"] = """
  SELECT n.project_id, CAST(n.frame_nr AS INTEGER) AS frame_nr, CASE WHEN separated THEN w.pos END AS pass, c.line_id, c.color_id, NULL::VARCHAR AS error
  FROM (SELECT s.*, unnest(range(f.a, f.b + 1)) AS frame_nr FROM xsettings s
        JOIN (SELECT project_id, min(frame_nr) AS a, max(frame_nr) AS b FROM frames WHERE image_id IS NOT NULL GROUP BY 1) f USING (project_id)
        WHERE line_visible OR color_visible) n
  LEFT JOIN swatches w ON n.separated AND w.project_id = n.project_id
  LEFT JOIN cels c ON c.project_id = n.project_id AND c.frame_nr = n.frame_nr
  UNION ALL SELECT project_id, NULL, NULL, NULL, NULL, 'NO_VISIBLE_LAYERS' FROM xsettings WHERE NOT line_visible AND NOT color_visible"""


def _plan(v):
    settings = (
        v.table("events")
        .select(F.expr("event_id div 1000").alias("project_id"))
        .distinct()
        .selectExpr(
            "project_id", "project_id % 4 <> 3 as line_visible", "project_id % 2 = 0 as color_visible",
            "project_id % 3 = 1 as separated",
        )
    )
    return E.plan_export(v.frames, settings, v.swatches)


@query("plan_export", "SELECT * FROM xplan")
def plan_export(v):
    return _plan(v)


@query(
    "export_paths",
    """SELECT project_id, frame_nr, pass,
              CASE WHEN pass IS NOT NULL THEN '/out/p' || project_id || '/color' || CASE WHEN pass + 1 < 10 THEN '0' ELSE '' END || (pass + 1) END AS sub_folder,
              CASE WHEN pass IS NULL THEN '/out/p' || project_id || '/shot' ELSE '/out/p' || project_id || '/color' || CASE WHEN pass + 1 < 10 THEN '0' ELSE '' END || (pass + 1)
                || '/shot_color' || CASE WHEN pass + 1 < 10 THEN '0' ELSE '' END || (pass + 1) END || '_' || lpad(CAST(frame_nr - 1 AS VARCHAR), 3, '0') AS stem
       FROM xplan WHERE error IS NULL""",
)
def export_paths(v):
    plan = _plan(v).where("error is null").select("project_id", "frame_nr", "pass")
    target = F.concat(F.lit("/out/p"), F.col("project_id").cast("string"), F.lit("/shot.png"))
    return E.export_paths(plan, target, F.lit(1000))


@query(
    "compose_plan",
    """SELECT project_id, frame_nr, pass, CASE WHEN len(l) = 0 THEN ['blank'] ELSE l END AS layers FROM (
         SELECT project_id, frame_nr, pass, list_filter([CASE WHEN project_id % 5 = 0 THEN 'background' END,
             CASE WHEN (project_id % 2 = 0 OR pass IS NOT NULL) AND color_id IS NOT NULL THEN 'color' END,
             CASE WHEN project_id % 4 <> 3 AND line_id IS NOT NULL AND pass IS NULL THEN 'line' END], lambda z: z IS NOT NULL) AS l
         FROM xplan WHERE error IS NULL)""",
)
def compose_plan(v):
    p = F.col("project_id")
    layers = E.compose_plan(
        F.col("color_id").isNotNull(), F.col("line_id").isNotNull(), F.col("pass"), p % 4 != 3, p % 2 == 0, p % 5 == 0
    )
    return _plan(v).where("error is null").select("project_id", "frame_nr", "pass", layers.alias("layers"))


@query(
    "distinct_renders",
    """SELECT project_id, line_id, color_id, pass, count(*) AS num_frames, min(frame_nr) AS first_frame
       FROM xplan WHERE error IS NULL GROUP BY ALL""",
)
def distinct_renders(v):
    return E.distinct_renders(_plan(v).where("error is null"))


@query(
    "fan_out_renders",
    """SELECT project_id, frame_nr, pass, line_id, color_id, min(frame_nr) OVER (PARTITION BY project_id, line_id, color_id, pass) AS first_frame
       FROM xplan WHERE error IS NULL""",
)
def fan_out_renders(v):
    # The plan is written before the renders are made from it.
    plan = cut_lineage(_plan(v).where("error is null").drop("error"))
    return E.fan_out(plan, E.distinct_renders(plan).drop("num_frames"))


@query(
    "composite",
    """WITH p AS (SELECT *, a / 255.0::DOUBLE AS ta, CASE WHEN inside THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ba FROM grid),
       q AS (SELECT *, ta + ba * (1.0 - ta) AS al FROM p)
       SELECT image_id, y, x,
              CAST(floor(CASE WHEN al = 0 THEN 0 ELSE (r * ta + 200 * (ba * (1.0 - ta))) / al END + 0.5) AS INTEGER) AS r,
              CAST(floor(CASE WHEN al = 0 THEN 0 ELSE (g * ta + 100 * (ba * (1.0 - ta))) / al END + 0.5) AS INTEGER) AS g,
              CAST(floor(CASE WHEN al = 0 THEN 0 ELSE (b * ta + 50 * (ba * (1.0 - ta))) / al END + 0.5) AS INTEGER) AS b,
              CAST(floor(al * 255.0 + 0.5) AS INTEGER) AS a FROM q""",
)
def composite(v):
    line = v.grid.select("image_id", "y", "x", F.lit(1).alias("z"), "r", "g", "b", "a")
    color = v.grid.select(
        "image_id", "y", "x", F.lit(0).alias("z"), F.lit(200).alias("r"), F.lit(100).alias("g"), F.lit(50).alias("b"),
        F.when(F.col("inside"), 255).otherwise(0).alias("a"),
    )
    return E.composite(color.unionByName(line))
