"""Queries: regions, tiles, boxes, points."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.operators import regions as R
from flatcel.operators import segmentation as SG
from flatcel.operators import tiles as TI
from flatcel.operators.graph import components as graph_components
from flatcel.operators.tile_forest import TileForest
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.q_pixels import im255, lines, sizes
from flatcel.plans.registry import query
from flatcel.session import new_folder

T = 16  # small tiles, so that every query crosses tile borders

LAB = "CASE WHEN is_line THEN 0 ELSE 1 + x // 8 + 7 * (y // 8) + CASE WHEN inside THEN 100 ELSE 0 END END"
VIEW_SQL["lab"] = f"SELECT image_id, y, x, {LAB} AS label FROM grid"
VIEW_SQL["around"] = "SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)"


def lab(v):
    return v.grid.selectExpr(
        "image_id", "y", "x",
        "if(is_line, 0, cast(1 + x div 8 + 7 * (y div 8) + if(inside, 100, 0) as int)) as label",
    )


def _cc(source: str, rest: str) -> str:
    """Regions of ``source`` (image_id, y, x, v) by repeated minimum, then ``rest``."""
    return f"""WITH RECURSIVE src AS ({source}),
      pr AS (SELECT *, max(s0) OVER (PARTITION BY image_id, y ORDER BY x) AS x0 FROM (
               SELECT *, CASE WHEN lag(v) OVER (PARTITION BY image_id, y ORDER BY x) IS DISTINCT FROM v THEN x END AS s0 FROM src)),
      runs AS (SELECT image_id, y, x0, v, max(x) AS x1, y * 50 + x0 AS id FROM pr GROUP BY ALL),
      e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.v = b.v
              AND a.x0 <= b.x1 AND b.x0 <= a.x1),
      s AS (SELECT * FROM e UNION ALL SELECT image_id, b, a FROM e),
      cc(image_id, id, r) USING KEY (image_id, id) AS (
        SELECT image_id, id, id FROM runs
        UNION
        SELECT p.image_id, p.id, min(q.r) FROM cc q JOIN s ON s.image_id = q.image_id AND s.a = q.id
        JOIN recurring.cc p ON p.image_id = s.image_id AND p.id = s.b WHERE q.r < p.r GROUP BY p.image_id, p.id),
      ccp AS (SELECT pr.image_id, pr.y, pr.x, pr.v, cc.r FROM pr JOIN cc ON cc.image_id = pr.image_id AND cc.id = pr.y * 50 + pr.x0)
      {rest}"""


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT o_custkey AS a, 10000000 + o_orderkey // 8 AS b FROM orders),
       s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
       cc(node, component) USING KEY (node) AS (
         SELECT DISTINCT a, a FROM s
         UNION
         SELECT p.node, min(q.component) FROM cc q JOIN s ON s.a = q.node JOIN recurring.cc p ON p.node = s.b WHERE q.component < p.component GROUP BY p.node)
       SELECT node, component FROM cc""",
)
def components(v):
    edges = v.table("orders").selectExpr(
        "o_custkey as src", "10000000 + o_orderkey div 8 as dst"
    )
    return graph_components(edges)


@query(
    "label_regions",
    _cc("SELECT * FROM mask", "SELECT image_id, y, x, v, r // 50 AS region_y, r % 50 AS region_x FROM ccp"),
)
def label_regions(v):
    return R.label_regions(v.mask, tile=T)


@query(
    "number_regions",
    _cc("SELECT * FROM mask", "SELECT image_id, y, x, v, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY r) - 1 AS INTEGER) AS label FROM ccp"),
)
def number_regions(v):
    return R.number_regions(R.label_regions(v.mask, tile=T))


@query(
    "fill_from",
    _cc("SELECT * FROM mask", """SELECT image_id, y, x, v, r // 50 AS region_y, r % 50 AS region_x FROM ccp
        WHERE (image_id, r) IN (SELECT image_id, r FROM ccp WHERE y = 15 AND x IN (4, 25))"""),
)
def fill_from(v):
    seeds = v.grid.where("y = 15 and x in (4, 25)").select("image_id", "y", "x")
    return R.fill_from(seeds, v.mask, tile=T)


@query(
    "relabel",
    "SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) - 1 AS INTEGER) AS label FROM lab",
)
def relabel(v):
    return R.relabel(lab(v))


PROPS = "SELECT image_id, label, count(*) AS area, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM lab GROUP BY ALL"


@query("region_props", PROPS)
def region_props(v):
    return R.region_props(lab(v))


@query(
    "filter_regions",
    f"""WITH p AS ({PROPS}), l AS (SELECT image_id, avg(area) AS a, quantile_cont(area, 0.5) AS m FROM p GROUP BY 1)
        SELECT 'mean' AS method, p.* FROM p JOIN l USING (image_id) WHERE area >= a
        UNION ALL SELECT 'median', p.* FROM p JOIN l USING (image_id) WHERE area >= m""",
)
def filter_regions(v):
    props = R.region_props(lab(v))
    mean, median = (R.filter_regions(props, m).withColumn("method", F.lit(m)) for m in ("mean", "median"))
    return mean.unionByName(median)


@query(
    "region_adjacency",
    """SELECT image_id, label, other, count(*) AS contact FROM (
         SELECT DISTINCT p.image_id, p.y, p.x, p.label AS other, q.label FROM lab p, around a
         JOIN lab q ON q.image_id = p.image_id AND q.y = p.y + a.dy AND q.x = p.x + a.dx WHERE q.label <> p.label) GROUP BY ALL""",
)
def region_adjacency(v):
    return R.region_adjacency(lab(v), tile=T)


@query("merge_small")
def merge_small(v):
    return SG.merge_small(lab(v), min_seg_size=3, tile=T)


@query("thin_lines")
def thin_lines(v):
    return R.thin_lines(lab(v), rounds_per_pass=4, tile=T)


@query("trapped_ball")
def trapped_ball(v):
    return SG.trapped_ball(im255(v), 1, tile=T)


@query("compute_seg")
def compute_seg(v):
    """The whole segmentation of a line drawing, up to labels without gaps."""
    return SG.compute_seg(im255(v), tile=T)


@query("trapped_ball_sequence")
def trapped_ball_sequence(v):
    return SG.trapped_ball_sequence(im255(v), (2, 1), tile=T)


FILLS = """SELECT l_suppkey % 10 AS image_id, CAST(l_linenumber AS INTEGER) AS fill_id, CAST(l_partkey % 30 AS INTEGER) AS y, CAST(l_orderkey % 50 AS INTEGER) AS x
           FROM lineitem"""


def _fills(v):
    return v.table("lineitem").selectExpr(
        "l_suppkey % 10 as image_id", "l_linenumber as fill_id", "cast(l_partkey % 30 as int) as y", "cast(l_orderkey % 50 as int) as x"
    )


@query(
    "fill_map",
    f"""SELECT g.image_id, g.y, g.x, CAST(coalesce(f.m, 0) AS INTEGER) AS label FROM grid g
        LEFT JOIN (SELECT image_id, y, x, max(fill_id) AS m FROM ({FILLS}) GROUP BY ALL) f USING (image_id, y, x)""",
)
def fill_map(v):
    return R.fill_map(_fills(v), v.grid)


@query(
    "mark_filled",
    f"""SELECT g.image_id, g.y, g.x, CASE WHEN f.y IS NOT NULL THEN 0 ELSE g.v END AS v FROM mask g
        LEFT JOIN (SELECT DISTINCT image_id, y, x FROM ({FILLS})) f USING (image_id, y, x)""",
)
def mark_filled(v):
    return R.mark_filled(v.mask, _fills(v))


BYTE = "CASE WHEN label = 0 THEN 0 ELSE CAST(CAST('0x' || substr(md5('3:{k}:' || label), 1, 8) AS BIGINT) % 255 AS INTEGER) END"


@query(
    "color_regions",
    f"SELECT image_id, y, x, label, {BYTE.format(k=0)} AS r, {BYTE.format(k=1)} AS g, {BYTE.format(k=2)} AS b FROM lab",
)
def color_regions(v):
    return R.color_regions(lab(v), seed=3)


SPANS = """
  SELECT m.image_id, m.y, m.x, m.v, a AS ty, b AS tx, m.y - a * 8 AS ly, m.x - b * 8 AS lx,
         greatest(1, CAST(ceil((s.h - 16) / 8.0) AS BIGINT) + 1) AS rows, greatest(1, CAST(ceil((s.w - 16) / 8.0) AS BIGINT) + 1) AS cols
  FROM mask m JOIN imgsize s USING (image_id), range(0, 10) i(a), range(0, 10) j(b)
  WHERE m.y BETWEEN a * 8 AND a * 8 + 15 AND m.x BETWEEN b * 8 AND b * 8 + 15
    AND a < greatest(1, CAST(ceil((s.h - 16) / 8.0) AS BIGINT) + 1) AND b < greatest(1, CAST(ceil((s.w - 16) / 8.0) AS BIGINT) + 1)"""
VIEW_SQL["tiled"] = SPANS


def sized_mask(v, mask=None):
    hw = sizes(v).select("image_id", "h", "w")
    return (v.mask if mask is None else mask).join(hw, "image_id")


def tiled(v, mask=None):
    return TI.tile(sized_mask(v, mask), 16, 0.5).drop("h", "w")


@query("tile", "SELECT * FROM tiled")
def tile(v):
    return tiled(v)


WITHIN = """(ly >= 4 OR ty = 0) AND (ly < 12 OR ty = rows - 1) AND (lx >= 4 OR tx = 0) AND (lx < 12 OR tx = cols - 1)"""


@query("merge_tiles", f"SELECT * FROM tiled WHERE {WITHIN}")
def merge_tiles(v):
    return TI.merge_tiles(tiled(v), 16, 0.5)


@query(
    "border_pairs",
    """WITH t AS (SELECT *, CAST(v * 10 + ty + tx AS INTEGER) AS label FROM tiled),
       p AS (SELECT DISTINCT a.image_id, a.ty AS aty, a.tx AS atx, a.label AS alabel, b.ty AS bty, b.tx AS btx, b.label AS blabel
             FROM t a JOIN t b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x AND b.ty = a.ty + 1 AND b.tx = a.tx AND a.ly = 12
             WHERE (a.lx >= 4 OR a.tx = 0) AND (a.lx < 12 OR a.tx = a.cols - 1)
             UNION ALL
             SELECT DISTINCT a.image_id, a.ty, a.tx, a.label, b.ty, b.tx, b.label
             FROM t a JOIN t b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x AND b.tx = a.tx + 1 AND b.ty = a.ty AND a.lx = 12
             WHERE (a.ly >= 4 OR a.ty = 0) AND (a.ly < 12 OR a.ty = a.rows - 1))
       SELECT * FROM p""",
)
def border_pairs(v):
    labelled = tiled(v).withColumn("label", (F.col("v") * 10 + F.col("ty") + F.col("tx")).cast("int"))
    return TI.border_pairs(labelled, 16, 0.5).select(
        "image_id", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in ("ty", "tx", "label")]
    )


NUMBERED = "SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY r) - 1 AS INTEGER) AS label FROM ccp"


@query("stitch", _cc("SELECT * FROM mask", NUMBERED))
def stitch(v):
    return R.stitch(R.label_tiles(tiled(v)), 16, 0.5)


REDRAWN = """SELECT image_id, y, x, CASE WHEN inside AND y BETWEEN 9 AND 12 AND x BETWEEN 20 AND 29 THEN 0 ELSE CASE WHEN is_line THEN 0 ELSE 1 END END AS v FROM grid"""
VIEW_SQL["redrawn"] = REDRAWN


def redrawn(v):
    patch = F.col("inside") & F.col("y").between(9, 12) & F.col("x").between(20, 29)
    return v.grid.select("image_id", "y", "x", F.when(patch | F.col("is_line"), 0).otherwise(1).alias("v"))


@query(
    "changed_tiles",
    """SELECT DISTINCT t.image_id, t.ty, t.tx FROM tiled t JOIN redrawn r USING (image_id, y, x) WHERE t.v <> r.v""",
)
def changed_tiles(v):
    return TI.changed_tiles(tiled(v), tiled(v, redrawn(v)))


@query("resegment", _cc("SELECT * FROM redrawn", NUMBERED))
def resegment(v):
    """Segment the first version, bring the changed tiles, read the labels of the second."""
    old, new = sized_mask(v), sized_mask(v, redrawn(v))
    forest = TileForest(v.spark, new_folder(v.spark), 16, 0.5)
    forest.create(tiled(v))
    changed = TI.tiles_of_changes(old, new, 16, 0.5)
    forest.update(tiled(v, redrawn(v)).join(changed, ["image_id", "ty", "tx"], "left_semi"))
    return forest.labels()


def _closure(source: str) -> str:
    """Every box of ``source`` (image_id, y1, x1, y2, x2) grows to the hull of what it meets until none does."""
    return f"""WITH RECURSIVE src AS (SELECT *, row_number() OVER () AS id FROM ({source})),
      hull(image_id, id, y1, x1, y2, x2) USING KEY (image_id, id) AS (
        SELECT image_id, id, y1, x1, y2, x2 FROM src
        UNION
        SELECT p.image_id, p.id, least(p.y1, min(q.y1)), least(p.x1, min(q.x1)), greatest(p.y2, max(q.y2)), greatest(p.x2, max(q.x2))
        FROM hull q JOIN recurring.hull p ON p.image_id = q.image_id AND p.y1 <= q.y2 AND p.y2 >= q.y1 AND p.x1 <= q.x2 AND p.x2 >= q.x1
        GROUP BY p.image_id, p.id, p.y1, p.x1, p.y2, p.x2
        HAVING min(q.y1) < p.y1 OR min(q.x1) < p.x1 OR max(q.y2) > p.y2 OR max(q.x2) > p.x2)
      SELECT DISTINCT image_id, y1, x1, y2, x2 FROM hull"""


# Around single changed pixels: neighbors' boxes meet, so their closure is that of whole changed places.
CHANGED = """SELECT m.image_id, greatest(m.y - 2, 0) AS y1, greatest(m.x - 2, 0) AS x1, CAST(least(m.y + 3, h) AS INTEGER) AS y2, CAST(least(m.x + 3, w) AS INTEGER) AS x2
             FROM mask m JOIN redrawn r USING (image_id, y, x) JOIN imgsize USING (image_id) WHERE m.v <> r.v"""


@query("diff_regions", _closure(CHANGED))
def diff_regions(v):
    return R.diff_regions(v.mask, redrawn(v), 2, tile=T)


VIEW_SQL["boxes"] = """
  SELECT DISTINCT o_orderkey // 100 AS image_id, CAST(o_custkey % 500 AS INTEGER) AS y1, CAST(o_orderkey * 37 % 500 AS INTEGER) AS x1,
         CAST(o_custkey % 500 + 5 + o_custkey % 40 AS INTEGER) AS y2, CAST(o_orderkey * 37 % 500 + 5 + o_orderkey % 40 AS INTEGER) AS x2 FROM orders"""


def boxes(v):
    return v.table("orders").selectExpr(
        "o_orderkey div 100 as image_id", "cast(o_custkey % 500 as int) as y1", "cast(o_orderkey * 37 % 500 as int) as x1",
        "cast(o_custkey % 500 + 5 + o_custkey % 40 as int) as y2", "cast(o_orderkey * 37 % 500 + 5 + o_orderkey % 40 as int) as x2",
    )


@query("merge_boxes", _closure("SELECT * FROM boxes"))
def merge_boxes(v):
    return R.merge_boxes(boxes(v))


def _walk(order: str, distance: int) -> str:
    """Points of each image in ``order``, kept one by one."""
    return f"""SELECT image_id, list_reduce(list(DISTINCT [{{'o': {order}, 'y': y, 'x': x}}] ORDER BY [{{'o': {order}, 'y': y, 'x': x}}]),
        lambda kept, p: CASE WHEN len(list_filter(kept, lambda q: (q.y - p[1].y) * (q.y - p[1].y) + (q.x - p[1].x) * (q.x - p[1].x) <= {distance * distance})) > 0
                             THEN kept ELSE kept || p END) AS kept, count(*) AS n FROM pts GROUP BY image_id"""


@query("dedupe_points", f"SELECT image_id, p.y AS y, p.x AS x FROM (SELECT image_id, unnest(kept) AS p FROM ({_walk('y', 3)}))")
def dedupe_points(v):
    return R.dedupe_points(v.pts, 3)


RANDOM = "md5('4:' || image_id || ':' || y || ':' || x)"


@query(
    "spaced_sample",
    f"""WITH w AS ({_walk(RANDOM, 8)})
        SELECT image_id, p.y AS y, p.x AS x FROM (SELECT image_id, unnest(kept[:50]) AS p FROM w WHERE n > 50)
        UNION ALL SELECT image_id, y, x FROM pts WHERE image_id IN (SELECT image_id FROM w WHERE n <= 50)""",
)
def spaced_sample(v):
    return R.spaced_sample(v.pts, 50, 8, seed=4)


LOST = f"""SELECT r.image_id, r.y, r.x, CASE WHEN r.x % 8 < 3 THEN 0 ELSE r.label END AS label FROM (
  SELECT z.image_id, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, g.label FROM imgsize z, range(0, 12) a(i), range(0, 20) b(j)
  JOIN lab g ON g.image_id = z.image_id AND g.y = CAST(floor((i + 0.5::DOUBLE) * (z.h / 12::DOUBLE)) AS INTEGER)
   AND g.x = CAST(floor((j + 0.5::DOUBLE) * (z.w / 20::DOUBLE)) AS INTEGER)) r"""
VIEW_SQL["lost"] = LOST


def lost(v):
    from flatcel.operators.pixels import resize_nearest

    small = resize_nearest(lab(v), sizes(v))
    return small.withColumn("label", F.when(F.col("x") % 8 < 3, 0).otherwise(F.col("label")))


@query(
    "restore_lost_segments",
    """WITH c AS (SELECT image_id, label, avg(y) AS my, avg(x) AS mx FROM lab l
                  WHERE NOT EXISTS (SELECT 1 FROM lost s WHERE s.image_id = l.image_id AND s.label = l.label) GROUP BY ALL),
       p AS (SELECT c.image_id, CAST(floor(my * 12 / h) AS INTEGER) AS y, CAST(floor(mx * 20 / w) AS INTEGER) AS x, max(label) AS label
             FROM c JOIN imgsize USING (image_id) GROUP BY ALL)
       SELECT s.image_id, s.y, s.x, coalesce(p.label, s.label) AS label FROM lost s LEFT JOIN p USING (image_id, y, x)""",
)
def restore_lost_segments(v):
    return R.restore_lost_segments(lab(v), lost(v), sizes(v))


IDMAP = """SELECT i.image_id, i.label, CASE WHEN s.label IS NOT NULL THEN CAST(count(s.label) OVER (PARTITION BY i.image_id ORDER BY i.label) - 1 AS INTEGER) END AS new_id
           FROM (SELECT DISTINCT image_id, label FROM lab) i LEFT JOIN (SELECT DISTINCT image_id, label FROM lost) s USING (image_id, label)"""


@query("id_offset_map", IDMAP)
def id_offset_map(v):
    return R.id_offset_map(lab(v), lost(v))


@query(
    "apply_id_map",
    f"SELECT l.image_id, y, x, coalesce(m.new_id, -100) AS label FROM lab l LEFT JOIN ({IDMAP}) m USING (image_id, label)",
)
def apply_id_map(v):
    return R.apply_id_map(lab(v), R.id_offset_map(lab(v), lost(v)))
