"""Queries: project files, image bytes, snapshots, vector paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.functions import names as N
from flatcel.operators import diff as D
from flatcel.operators import paths as V
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.registry import query
from flatcel.session import new_folder
from flatcel.sources import bitmaps as B
from flatcel.sources import images as I
from flatcel.sources import projects as P

# One project per 1000 consecutive events, the timeline limit.
VIEW_SQL["sections"] = """
  SELECT event_id // 1000 AS project_id, '[{"version":"0.' || (event_id // 1000 % 5) || '.1"}]' AS metadata,
         '{"layers":{"lineLayer1":{"frames":[' || string_agg(CASE WHEN value < 8 THEN 'null' ELSE
            '{"imageDataId":"L_' || event_type || '","isOriginal":' || CASE WHEN event_type = 'purchase' THEN 'true' ELSE 'false' END
            || ',"frameNr":' || (event_id % 1000) || '}' END, ',' ORDER BY event_id) || ']}},'
         || '"ImageStore":{"imageDataById":{"L_click":{"dataUri":"data:' || count(*) || '","hash":"h1","referenceCount":' || count(*) FILTER (event_type = 'click') || '},"L_view":{"dataUri":null}}},'
         || '"colorPalette":[{"hex":"#dc2828","opacity":255},{"hex":"#28b4' || lpad(CAST(event_id // 1000 % 100 AS VARCHAR), 2, '0') || '","visible":false}],"firstRealFrameNumber":1}' AS save_state,
         '[]' AS temp_images, CASE WHEN event_id // 1000 % 2 = 0 THEN '{"firstReal":1,"cels":' || count(*) || '}' END AS document
  FROM events GROUP BY event_id // 1000"""


def sections(v):
    frame = F.expr(
        """if(value < 8, 'null', concat('{"imageDataId":"L_', event_type, '","isOriginal":', if(event_type = 'purchase', 'true', 'false'),
           ',"frameNr":', event_id % 1000, '}'))"""
    )
    grouped = v.table("events").groupBy(F.expr("event_id div 1000").alias("project_id")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", frame.alias("j")))).alias("f"),
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
    )
    return grouped.select(
        "project_id",
        F.expr("""concat('[{"version":"0.', project_id % 5, '.1"}]')""").alias("metadata"),
        F.concat(
            F.lit('{"layers":{"lineLayer1":{"frames":['), F.array_join("f.j", ","), F.lit("]}},"),
            F.expr("""concat('"ImageStore":{"imageDataById":{"L_click":{"dataUri":"data:', n, '","hash":"h1","referenceCount":', clicks, '},"L_view":{"dataUri":null}}},')"""),
            F.expr("""concat('"colorPalette":[{"hex":"#dc2828","opacity":255},{"hex":"#28b4', lpad(project_id % 100, 2, '0'), '","visible":false}],"firstRealFrameNumber":1}')"""),
        ).alias("save_state"),
        F.lit("[]").alias("temp_images"),
        F.expr("""if(project_id % 2 = 0, concat('{"firstReal":1,"cels":', n, '}'), null)""").alias("document"),
    )


def parsed(v):
    return P.parse_projects(P.serialize_projects(sections(v)))


@query(
    "parse_projects",
    """SELECT project_id, metadata, '0.' || (project_id % 5) || '.1' AS version, save_state, temp_images, document, project_id % 5 < 3 AS too_old FROM sections""",
)
def parse_projects(v):
    return parsed(v).withColumn("too_old", N.is_too_old(F.col("version")))


@query(
    "serialize_projects",
    """SELECT project_id, metadata || 'BEGINSAVESTATE' || save_state || 'BEGINTEMPIMAGES' || temp_images
              || CASE WHEN document IS NULL THEN '' ELSE 'BEGINDOCUMENT' || document END AS text FROM sections""",
)
def serialize_projects(v):
    return P.serialize_projects(sections(v))


@query(
    "project_frames",
    """SELECT event_id // 1000 AS project_id, 'lineLayer1' AS layer, CAST(row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS INTEGER) AS frame_nr,
              'L_' || event_type AS image_id, event_type = 'purchase' AS is_original, false AS is_selected,
              NULL::INTEGER AS ref_left, NULL::INTEGER AS ref_right, NULL::INTEGER AS ref_closest
       FROM events QUALIFY value >= 8""",
)
def project_frames(v):
    return P.project_tables(parsed(v))[0]


@query(
    "project_images",
    """SELECT event_id // 1000 AS project_id, 'L_click' AS image_id, 'data:' || count(*) AS content, 'h1' AS hash, NULL::BOOLEAN AS hash_dirty,
              CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS reference_count, NULL::VARCHAR AS seg_path FROM events GROUP BY 1
       UNION ALL SELECT DISTINCT event_id // 1000, 'L_view', NULL, NULL, NULL, NULL, NULL FROM events""",
)
def project_images(v):
    return P.project_tables(parsed(v))[1]


@query(
    "project_swatches",
    """SELECT p.project_id, t.pos, CASE WHEN t.pos = 0 THEN '#dc2828' ELSE '#28b4' || lpad(CAST(p.project_id % 100 AS VARCHAR), 2, '0') END AS hex, NULL::VARCHAR AS new_hex,
              CASE WHEN t.pos = 1 THEN false END AS visible, NULL::BOOLEAN AS new_visible, CASE WHEN t.pos = 0 THEN 255 END AS opacity,
              NULL::INTEGER AS new_opacity, NULL::BOOLEAN AS selected
       FROM (SELECT DISTINCT event_id // 1000 AS project_id FROM events) p, (VALUES (0), (1)) t(pos)""",
)
def project_swatches(v):
    return P.project_tables(parsed(v))[2]


@query(
    "validate_document",
    """SELECT s_suppkey AS project_id, list_filter([CASE WHEN s_nationkey % 4 = 0 THEN 'canvas' END, CASE WHEN s_nationkey % 3 = 0 THEN 'palette' END], lambda z: z IS NOT NULL) AS mismatches,
              s_nationkey % 4 <> 0 AND s_nationkey % 3 <> 0 AS ok FROM supplier""",
)
def validate_document(v):
    s = v.table("supplier")
    derived = s.selectExpr("s_suppkey as project_id", "named_struct('w', 10, 'h', s_nationkey) as canvas", "array(s_name) as palette", "s_acctbal as last")
    stored = s.selectExpr(
        "s_suppkey as project_id", "named_struct('w', 10, 'h', if(s_nationkey % 4 = 0, s_nationkey + 1, s_nationkey)) as canvas",
        "if(s_nationkey % 3 = 0, array('x', s_name), array(s_name)) as palette", "s_acctbal as last",
    )
    return D.validate_document(derived, stored, ["canvas", "palette", "last"])


# --- image bytes: a document's text is one image row --------------------------------


def text_images(v, channels: int):
    """Zero bytes fill the last pixel of a text."""
    width = F.ceil(F.octet_length("text") / channels)
    data = F.expr(f"rpad(encode(text, 'UTF-8'), cast(ceil(octet_length(text) / {channels}) * {channels} as int), X'00')")
    return v.table("documents").select(
        F.col("doc_id").alias("image_id"), F.lit(1).alias("h"), width.cast("int").alias("w"),
        F.lit(channels).alias("n_channels"), data.alias("data"),
    )


BYTES = """SELECT doc_id AS image_id, CAST(i // {n} AS BIGINT) AS x, i % {n} AS k, b FROM (
  SELECT doc_id, unnest(l) AS b, unnest(range(0, len(l))) AS i FROM (
    SELECT doc_id, list_transform(regexp_extract_all(rpad(h, CAST(ceil(length(h) / (2.0 * {n})) * 2 * {n} AS INTEGER), '0'), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS l
    FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)))"""


@query(
    "to_pixels",
    f"""SELECT image_id, count(*) // 3 AS n, CAST(sum(b) FILTER (k = 2) AS BIGINT) AS r, CAST(sum(b * (x % 7)) FILTER (k = 1) AS BIGINT) AS g,
               CAST(sum(b * (x % 5)) FILTER (k = 0) AS BIGINT) AS b, 255 AS a FROM ({BYTES.format(n=3)}) GROUP BY image_id""",
)
def to_pixels(v):
    return I.to_pixels(text_images(v, 3)).groupBy("image_id").agg(
        F.count("*").alias("n"), F.sum("r").alias("r"), F.sum(F.col("g") * (F.col("x") % 7)).alias("g"),
        F.sum(F.col("b") * (F.col("x") % 5)).alias("b"), F.min("a").alias("a"),
    )


@query(
    "to_seg_pixels",
    f"""SELECT image_id, count(*) // 4 AS n, CAST(sum(b * CASE k WHEN 2 THEN 16777216 WHEN 1 THEN 65536 WHEN 0 THEN 256 ELSE 1 END) AS BIGINT) AS ids,
               CAST(max(b) FILTER (k = 2) AS BIGINT) AS top FROM ({BYTES.format(n=4)}) GROUP BY image_id""",
)
def to_seg_pixels(v):
    return I.to_seg_pixels(text_images(v, 4)).groupBy("image_id").agg(
        F.count("*").alias("n"), F.sum("seg_id").alias("ids"), F.max(F.shiftright("seg_id", 24)).alias("top")
    )


# --- round trips through files: texts as images of 16 pixels a row, projects as files ------


def image_folder(v) -> str:
    """Every text as a bitmap file named by its document; zero bytes fill the last row."""
    rows = F.ceil(F.octet_length("text") / 48).cast("int")
    folder = new_folder(v.spark)
    B.write_bitmaps(
        v.table("documents").where("octet_length(text) > 0").select(
            F.concat(F.lit("doc_"), "doc_id").alias("name"), rows.alias("h"), F.lit(16).alias("w"), F.lit(3).alias("n_channels"),
            F.expr("rpad(encode(text, 'UTF-8'), cast(ceil(octet_length(text) / 48) * 48 as int), X'00')").alias("data"),
        ),
        folder,
    )
    return folder


@query(
    "image_strips",
    f"""SELECT CAST(image_id AS INTEGER) AS frame_nr, (max(x) // 16 + 1) * 16 AS n, CAST(sum(b) FILTER (k = 2) AS BIGINT) AS r,
               CAST(sum(b * (x % 16)) FILTER (k = 1) AS BIGINT) AS g, CAST(sum(b * (x // 16)) FILTER (k = 0) AS BIGINT) AS b
        FROM ({BYTES.format(n=3)}) GROUP BY image_id""",
)
def image_strips(v):
    strips = B.read_strips(v.spark, image_folder(v), strip_bytes=1 << 16)
    return (
        I.to_pixels(strips.withColumn("image_id", F.col("frame_nr")))
        .groupBy(F.col("image_id").alias("frame_nr"))
        .agg(
            F.count("*").alias("n"), F.sum("r").alias("r"), F.sum(F.col("g") * F.col("x")).alias("g"),
            F.sum(F.col("b") * F.col("y")).alias("b"),
        )
    )


@query(
    "read_images",
    """SELECT doc_id, CAST(rows AS INTEGER) AS h, 16 AS w, 3 AS n_channels, rpad(hex(encode(text)), CAST(rows * 96 AS INTEGER), '0') AS content, false AS is_corrupt
       FROM (SELECT *, ceil(strlen(text) / 48.0) AS rows FROM documents) WHERE rows > 0""",
)
def read_images(v):
    return I.read_images(v.spark, image_folder(v)).select(
        F.regexp_extract("image_id", r"doc_(-?[0-9]+)\.bmp$", 1).cast("long").alias("doc_id"),
        "h", "w", "n_channels", F.hex("data").alias("content"), "is_corrupt",
    )


@query(
    "list_files",
    """SELECT 'doc_' || doc_id || '.bmp' AS name, CAST(54 + 48 * ceil(strlen(text) / 48.0) AS BIGINT) AS length
       FROM documents WHERE strlen(text) > 0 AND (doc_id % 10 = 7 OR doc_id % 100 = 17 OR doc_id % 10 = 3)""",
)
def list_files(v):
    found = I.list_files(v.spark, image_folder(v), ["*7.bmp", "*17.bmp", "doc_*3.bmp"])
    return found.select(N.basename(F.col("path")).alias("name"), "length")


@query(
    "read_projects",
    """SELECT project_id, metadata, '0.' || (project_id % 5) || '.1' AS version, save_state, temp_images, document FROM sections""",
)
def read_projects(v):
    folder = new_folder(v.spark) + "/projects"
    P.write_projects(sections(v), folder)
    return P.read_projects(v.spark, folder).select(
        F.regexp_extract("file", r"project_id=([0-9]+)/", 1).cast("long").alias("project_id"),
        "metadata", "version", "save_state", "temp_images", "document",
    )


# --- snapshots -----------------------------------------------------------------------

VIEW_SQL["slots"] = """
  SELECT o_custkey AS doc_id, CAST(o_orderkey % 16 AS INTEGER) AS i, max(o_orderkey) AS k, max(o_orderstatus) AS st FROM orders GROUP BY ALL"""
VIEW_SQL["snap_a"] = """
  SELECT c_custkey AS doc_id, ['segment'] AS path, c_mktsegment AS value FROM customer
  UNION ALL SELECT c_custkey, ['balance'], c_name FROM customer WHERE c_nationkey <> 4
  UNION ALL SELECT doc_id, ['frames', '[' || i || ']'], CAST(k AS VARCHAR) FROM slots"""
VIEW_SQL["snap_b"] = """
  SELECT c_custkey AS doc_id, ['segment'] AS path, CASE WHEN c_nationkey = 3 THEN 'NEW' ELSE c_mktsegment END AS value FROM customer
  UNION ALL SELECT c_custkey, ['balance'], c_name FROM customer WHERE c_nationkey <> 5
  UNION ALL SELECT doc_id, ['frames', '[' || i || ']'], CASE WHEN st = 'F' THEN k || '*' ELSE CAST(k AS VARCHAR) END FROM slots WHERE i < 12 OR st <> 'P'"""


def snapshots(v):
    c = v.table("customer")
    slots = v.table("orders").groupBy(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 16).cast("int").alias("i")).agg(
        F.max("o_orderkey").cast("string").alias("k"), F.max("o_orderstatus").alias("st")
    )
    path = "array('frames', concat('[', i, ']')) as path"
    before = (
        c.selectExpr("c_custkey as doc_id", "array('segment') as path", "c_mktsegment as value")
        .unionByName(c.where("c_nationkey <> 4").selectExpr("c_custkey as doc_id", "array('balance') as path", "c_name as value"))
        .unionByName(slots.selectExpr("doc_id", path, "k as value"))
    )
    after = (
        c.selectExpr("c_custkey as doc_id", "array('segment') as path", "if(c_nationkey = 3, 'NEW', c_mktsegment) as value")
        .unionByName(c.where("c_nationkey <> 5").selectExpr("c_custkey as doc_id", "array('balance') as path", "c_name as value"))
        .unionByName(slots.where("i < 12 or st <> 'P'").selectExpr("doc_id", path, "if(st = 'F', concat(k, '*'), k) as value"))
    )
    return before, after


@query(
    "diff_tables",
    """WITH f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.path, b.path) AS path, a.value AS av, b.value AS bv
                  FROM snap_a a FULL JOIN snap_b b ON a.doc_id = b.doc_id AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value),
       l AS (SELECT a.doc_id, a.n AS an, b.n AS bn FROM (SELECT doc_id, max(i) + 1 AS n FROM slots GROUP BY 1) a
             LEFT JOIN (SELECT doc_id, max(i) + 1 AS n FROM slots WHERE i < 12 OR st <> 'P' GROUP BY 1) b USING (doc_id) WHERE a.n IS DISTINCT FROM b.n)
       SELECT 'undo' AS side, doc_id, CASE WHEN av IS NULL AND len(path) = 1 THEN 'delete' ELSE 'set' END AS op, path, av AS value, NULL::INTEGER AS length FROM f
       UNION ALL SELECT 'redo', doc_id, CASE WHEN bv IS NULL AND len(path) = 1 THEN 'delete' ELSE 'set' END, path, bv, NULL FROM f
       UNION ALL SELECT 'undo', doc_id, 'setLength', ['frames'], NULL, an FROM l
       UNION ALL SELECT 'redo', doc_id, 'setLength', ['frames'], NULL, coalesce(bn, 0) FROM l""",
)
def diff_tables(v):
    undo, redo = D.diff_tables(*snapshots(v))
    return undo.withColumn("side", F.lit("undo")).unionByName(redo.withColumn("side", F.lit("redo")))


@query("apply_patch_redo", "SELECT * FROM snap_b")
def apply_patch_redo(v):
    before, after = snapshots(v)
    return D.apply_patch(before, D.diff_tables(before, after)[1])


@query("apply_patch_undo", "SELECT * FROM snap_a")
def apply_patch_undo(v):
    before, after = snapshots(v)
    return D.apply_patch(after, D.diff_tables(before, after)[0])


# Null leaves, empty containers and changes of shape, spread over the customers.
_SHAPES = {
    "before": [
        ("'note'", "if(c_nationkey % 3 = 0, null, c_name)", "c_nationkey % 4 <> 1"),
        ("'meta'", "'{}'", "c_nationkey % 2 = 0"),
        ("'meta', 'k'", "c_mktsegment", "c_nationkey % 2 = 1"),
        ("'tags', '[0]'", "c_mktsegment", "true"),
        ("'tags', '[1]'", "'[]'", "c_nationkey % 5 <> 2"),
        ("'tags', '[1]', 'k'", "c_name", "c_nationkey % 5 = 2"),
        ("'list'", "'[]'", "c_nationkey % 7 = 0"),
        ("'list', '[0]'", "null", "c_nationkey % 7 <> 0"),
        ("'list', '[1]'", "c_name", "c_nationkey % 7 = 1"),
    ],
    "after": [
        ("'note'", "if(c_nationkey % 2 = 0, null, c_name)", "c_nationkey % 4 <> 2"),
        ("'meta'", "'{}'", "c_nationkey % 3 = 0"),
        ("'meta', 'k'", "null", "c_nationkey % 3 <> 0"),
        ("'tags', '[0]'", "null", "true"),
        ("'tags', '[1]'", "'[]'", "c_nationkey % 3 <> 2"),
        ("'tags', '[1]', 'k'", "c_name", "c_nationkey % 3 = 2"),
        ("'list'", "'[]'", "c_nationkey % 5 = 0"),
        ("'list', '[0]'", "c_mktsegment", "c_nationkey % 5 <> 0"),
        ("'list', '[1]'", "c_name", "c_nationkey % 5 = 1"),
    ],
}


def _shapes_sql(before: bool) -> str:
    note, meta, tags, items = (3, "c_nationkey % 2 = 0", "c_nationkey % 5 <> 2", 7) if before else (2, "c_nationkey % 3 = 0", "c_nationkey % 3 <> 2", 5)
    return f"""
  SELECT c_custkey AS doc_id, ['note'] AS path, CASE WHEN c_nationkey % {note} <> 0 THEN c_name END AS value FROM customer
    WHERE c_nationkey % 4 <> {1 if before else 2}
  UNION ALL SELECT c_custkey, ['meta'], '{{}}' FROM customer WHERE {meta}
  UNION ALL SELECT c_custkey, ['meta', 'k'], {"c_mktsegment" if before else "NULL"} FROM customer WHERE NOT ({meta})
  UNION ALL SELECT c_custkey, ['tags', '[0]'], {"c_mktsegment" if before else "NULL"} FROM customer
  UNION ALL SELECT c_custkey, ['tags', '[1]'], '[]' FROM customer WHERE {tags}
  UNION ALL SELECT c_custkey, ['tags', '[1]', 'k'], c_name FROM customer WHERE NOT ({tags})
  UNION ALL SELECT c_custkey, ['list'], '[]' FROM customer WHERE c_nationkey % {items} = 0
  UNION ALL SELECT c_custkey, ['list', '[0]'], {"NULL" if before else "c_mktsegment"} FROM customer WHERE c_nationkey % {items} <> 0
  UNION ALL SELECT c_custkey, ['list', '[1]'], c_name FROM customer WHERE c_nationkey % {items} = 1"""


def _shapes(v):
    def leaves(side: str):
        made = [
            F.struct(F.expr(f"array({p})").alias("path"), F.expr(x).cast("string").alias("value"), F.expr(k).alias("kept"))
            for p, x, k in _SHAPES[side]
        ]
        rows = v.table("customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*made)).alias("leaf"))
        return rows.where("leaf.kept").select("doc_id", "leaf.path", "leaf.value")

    return leaves("before"), leaves("after")


@query("apply_patch_redo_shapes", _shapes_sql(False))
def apply_patch_redo_shapes(v):
    before, after = _shapes(v)
    return D.apply_patch(before, D.diff_tables(before, after)[1])


@query("apply_patch_undo_shapes", _shapes_sql(True))
def apply_patch_undo_shapes(v):
    before, after = _shapes(v)
    return D.apply_patch(after, D.diff_tables(before, after)[0])


# --- vector paths -----------------------------------------------------------------------


def svg(v):
    return v.table("part").select(
        F.expr("p_partkey div 100").alias("image_id"),
        F.col("p_partkey").alias("path_id"),
        F.expr("concat('M', p_size, ' ', p_partkey % 50, ' C1.5 2 3 4 5 ', p_size, ' 7 8 -9 10 11 ', p_partkey % 9, if(p_size % 2 = 0, ' Z', concat(' C1 1 2 2 ', p_size, ' ', p_partkey % 50)))").alias("d"),
        F.when(F.col("p_type") == "PROMO", "translate(2,3.5)").alias("transform"),
        F.lit(50.0).alias("vw"),
        F.lit(100.0).alias("vh"),
    )


VIEW_SQL["cmds"] = """
  WITH p AS (SELECT p_partkey // 100 AS image_id, p_partkey AS path_id, p_size AS s, p_partkey % 50 AS m, p_partkey % 9 AS n,
                    CASE WHEN p_type = 'PROMO' THEN 2.0 ELSE 0.0 END AS tx, CASE WHEN p_type = 'PROMO' THEN 3.5 ELSE 0.0 END AS ty FROM part),
  c AS (SELECT image_id, path_id, tx, ty, 0 AS cmd_idx, 'M' AS cmd, [s, m]::DOUBLE[] AS c FROM p
        UNION ALL SELECT image_id, path_id, tx, ty, 1, 'C', [1.5, 2, 3, 4, 5, s]::DOUBLE[] FROM p
        UNION ALL SELECT image_id, path_id, tx, ty, 2, 'C', [7, 8, -9, 10, 11, n]::DOUBLE[] FROM p
        UNION ALL SELECT image_id, path_id, tx, ty, 3, 'C', [1, 1, 2, 2, s, m]::DOUBLE[] FROM p WHERE s % 2 <> 0)
  SELECT image_id, path_id, cmd_idx, cmd, list_transform(range(0, 6), lambda i: CASE WHEN i >= len(c) THEN 0.0::DOUBLE
           WHEN i % 2 = 0 THEN (c[i + 1] + tx) / 50.0::DOUBLE ELSE (c[i + 1] + ty) / 100.0::DOUBLE END) AS pts FROM c"""


def _rounded_points(df):
    return df.withColumn("pts", F.transform("pts", lambda e: F.round(e, 6)))


@query("path_commands", "SELECT image_id, path_id, cmd_idx, cmd, list_transform(pts, lambda e: round(e, 6)) AS pts FROM cmds")
def path_commands(v):
    return _rounded_points(V.path_commands(svg(v)))


@query(
    "path_summary",
    """WITH e AS (SELECT *, CASE cmd WHEN 'M' THEN pts[1:2] ELSE pts END AS q FROM cmds),
       g AS (SELECT *, q[len(q) - 1] AS ex, q[len(q)] AS ey FROM e)
       SELECT image_id, path_id, round(min(list_min([q[1], q[3], q[5]])), 6) AS x1, round(min(list_min([q[2], q[4], q[6]])), 6) AS y1,
              round(max(list_max([q[1], q[3], q[5]])), 6) AS x2, round(max(list_max([q[2], q[4], q[6]])), 6) AS y2,
              abs(arg_min(ex, cmd_idx) - arg_max(ex, cmd_idx)) < 1e-8 AND abs(arg_min(ey, cmd_idx) - arg_max(ey, cmd_idx)) < 1e-8 AS is_closed,
              arg_min(cmd_idx, (ey, ex, cmd_idx)) AS top_left
       FROM g GROUP BY image_id, path_id""",
)
def path_summary(v):
    return V.path_summary(V.path_commands(svg(v))).select(
        "image_id", "path_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")], "is_closed", "top_left"
    )


@query(
    "stroke_properties",
    """WITH s AS (SELECT o_orderkey // 200 AS image_id, o_orderkey // 20 AS path_id, CAST(o_orderkey % 20 AS INTEGER) AS rn,
                         CAST(o_custkey % 100 AS DOUBLE) AS y, floor(o_totalprice / 5000) AS x FROM orders),
       d AS (SELECT *, count(*) OVER (PARTITION BY image_id, path_id) AS n, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy,
                    coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx FROM s WINDOW w AS (PARTITION BY image_id, path_id ORDER BY rn)),
       t AS (SELECT *, dy / greatest(sqrt(dy * dy + dx * dx), 1e-6) AS ty, dx / greatest(sqrt(dy * dy + dx * dx), 1e-6) AS tx FROM d),
       k AS (SELECT *, sqrt(power(lead(ty) OVER w - lag(ty) OVER w, 2) + power(lead(tx) OVER w - lag(tx) OVER w, 2)) AS k FROM t WINDOW w AS (PARTITION BY image_id, path_id ORDER BY rn))
       SELECT image_id, path_id, rn, round(rn / (n - 1)::DOUBLE, 6) AS position, round(ty, 6) + 0.0::DOUBLE AS ty, round(tx, 6) + 0.0::DOUBLE AS tx, round(-tx, 6) + 0.0::DOUBLE AS ny, round(ty, 6) + 0.0::DOUBLE AS nx,
              round(coalesce(k, CASE WHEN rn = 0 THEN lead(k) OVER w ELSE lag(k) OVER w END), 6) AS curvature
       FROM k WINDOW w AS (PARTITION BY image_id, path_id ORDER BY rn)""",
)
def stroke_properties(v):
    points = v.table("orders").selectExpr(
        "o_orderkey div 200 as image_id", "o_orderkey div 20 as path_id", "cast(o_orderkey % 20 as int) as rn",
        "cast(o_custkey % 100 as double) as y", "cast(floor(o_totalprice / 5000) as double) as x",
    )
    out = V.stroke_properties(points)
    # Adding 0.0 turns a negative zero into a plain one.
    return out.select(
        "image_id", "path_id", "rn",
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("position", "ty", "tx", "ny", "nx", "curvature")],
    )
