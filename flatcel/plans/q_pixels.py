"""Queries: pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.operators import pixels as X
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.registry import query

T = 16  # small tiles, so that every query crosses tile borders
VIEW_SQL["imgsize"] = "SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM grid GROUP BY image_id"


def im255(v):
    return v.grid.select("image_id", "y", "x", F.when(F.col("is_line"), 0).otherwise(255).alias("v"))


def lines(v):
    return v.grid.select("image_id", "y", "x", F.when(F.col("is_line"), 1).otherwise(0).alias("v"))


@query(
    "alpha_stats",
    "SELECT image_id, bool_or(a < 255) AS has_transparent, sum(a) = 0 AS is_empty FROM grid GROUP BY image_id",
)
def alpha_stats(v):
    return X.alpha_stats(v.grid)


@query("binarize_manual", "SELECT image_id, y, x, CASE WHEN 255 - a > 40 THEN 255 ELSE 0 END AS v FROM grid")
def binarize_manual(v):
    return X.binarize_manual(v.grid, 40)


OTSU = """
  SELECT image_id, arg_min(i, (-sb, i)) AS threshold FROM (
    SELECT image_id, i, CASE WHEN n > n1 THEN n1::DOUBLE * (n - n1) * power(s1 / n1::DOUBLE - (s - s1) / (n - n1)::DOUBLE, 2) ELSE -1 END AS sb FROM (
      SELECT image_id, i, sum(n) OVER w AS n1, sum(n * i) OVER w AS s1, sum(n) OVER (PARTITION BY image_id) AS n, sum(n * i) OVER (PARTITION BY image_id) AS s
      FROM (SELECT image_id, 255 - a AS i, count(*) AS n FROM grid GROUP BY ALL) WINDOW w AS (PARTITION BY image_id ORDER BY i)))
  GROUP BY image_id"""


@query("otsu", OTSU)
def otsu(v):
    return X.otsu(v.grid)


@query(
    "binarize_otsu",
    f"SELECT g.image_id, y, x, CASE WHEN 255 - a > threshold THEN 255 ELSE 0 END AS v FROM grid g JOIN ({OTSU}) o USING (image_id)",
)
def binarize_otsu(v):
    return X.binarize_otsu(v.grid)


@query(
    "binarize_adaptive",
    """WITH p AS (SELECT g.*, h, w, 255 - a AS im FROM grid g JOIN imgsize USING (image_id)),
       r AS (SELECT p.image_id, p.y, p.x, p.h, sum(q.im * CASE WHEN q.x = 0 AND p.x < 25 THEN 26 - p.x
                     WHEN q.x = p.w - 1 AND p.x + 25 > p.w - 1 THEN p.x + 26 - (p.w - 1) ELSE 1 END) AS s
             FROM p JOIN p q ON q.image_id = p.image_id AND q.y = p.y AND q.x BETWEEN p.x - 25 AND p.x + 25 GROUP BY ALL),
       b AS (SELECT r.image_id, r.y, r.x, sum(q.s * CASE WHEN q.y = 0 AND r.y < 25 AND q.y = r.h - 1 THEN 51 WHEN q.y = 0 AND r.y < 25 THEN 26 - r.y
                     WHEN q.y = r.h - 1 AND r.y + 25 > r.h - 1 THEN r.y + 26 - (r.h - 1) ELSE 1 END) AS s
             FROM r JOIN r q ON q.image_id = r.image_id AND q.x = r.x AND q.y BETWEEN r.y - 25 AND r.y + 25 GROUP BY ALL)
       SELECT p.image_id, p.y, p.x, CASE WHEN im - round_even(b.s / 2601.0::DOUBLE, 0) > -2 THEN 255 ELSE 0 END AS v
       FROM p JOIN b USING (image_id, y, x)""",
)
def binarize_adaptive(v):
    return X.binarize_adaptive(v.grid, tile=T)


@query(
    "binarize_gaussian",
    """WITH k AS (SELECT i, exp(-(i * i) / 128.0::DOUBLE) AS e FROM range(-25, 26) t(i)),
       kw AS (SELECT i, e / (SELECT sum(e) FROM k) AS wt FROM k),
       p AS (SELECT g.*, h, w, 255 - a AS im FROM grid g JOIN imgsize USING (image_id)),
       r AS (SELECT p.image_id, p.y, p.x, p.h, sum(q.im * wt) AS s FROM p, kw JOIN p q ON q.image_id = p.image_id AND q.y = p.y
              AND q.x = least(greatest(p.x + i, 0), p.w - 1) GROUP BY ALL),
       b AS (SELECT r.image_id, r.y, r.x, sum(q.s * wt) AS s FROM r, kw JOIN r q ON q.image_id = r.image_id AND q.x = r.x
              AND q.y = least(greatest(r.y + i, 0), r.h - 1) GROUP BY ALL)
       SELECT p.image_id, p.y, p.x, CASE WHEN im - round_even(b.s, 0) > -2 THEN 255 ELSE 0 END AS v FROM p JOIN b USING (image_id, y, x)""",
)
def binarize_gaussian(v):
    return X.binarize_adaptive(v.grid, method="gaussian", tile=T)


def _morph(kernel: str, agg: str) -> str:
    return f"""SELECT p.image_id, p.y, p.x, {agg}(q.v) AS v FROM mask p, ({kernel}) k(dy, dx)
               JOIN mask q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.image_id, p.y, p.x"""


BALL2 = "SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE abs(dy) < 2 OR dx = 0"
CROSS = "SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy = 0 OR dx = 0"


@query("erode", _morph(BALL2, "min"))
def erode(v):
    return X.erode(v.mask, X.ball(2), tile=T)


@query("dilate", _morph(CROSS, "max"))
def dilate(v):
    return X.dilate(v.mask, X.CROSS, tile=T)


BOX = """
  SELECT image_id, coalesce(CASE WHEN t > 4 THEN t - 5 ELSE t END, 0) AS top, coalesce(CASE WHEN b < h - 4 THEN b + 5 ELSE b END, h) AS bottom,
         coalesce(CASE WHEN l > 4 THEN l - 5 ELSE l END, 0) AS "left", coalesce(CASE WHEN r < w - 4 THEN r + 5 ELSE r END, w) AS "right", h, w
  FROM (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, min(y) FILTER (vis) AS t, max(y) FILTER (vis) + 1 AS b,
               min(x) FILTER (vis) AS l, max(x) FILTER (vis) + 1 AS r
        FROM (SELECT *, is_line AND y BETWEEN 8 AND 22 AND x BETWEEN 10 AND 40 AS vis FROM grid) GROUP BY image_id)"""


def _inked(v):
    middle = F.col("is_line") & F.col("y").between(8, 22) & F.col("x").between(10, 40)
    return v.grid.withColumn("a", F.when(middle, 255).otherwise(0))


@query("content_bbox", BOX)
def content_bbox(v):
    return X.content_bbox(_inked(v), padding=4)


@query(
    "crop",
    f"""SELECT g.image_id, y - b.top AS y, x - b."left" AS x, is_line FROM grid g JOIN ({BOX}) b USING (image_id)
        WHERE y >= top AND y < bottom AND x >= b."left" AND x < b."right\"""",
)
def crop(v):
    return X.crop(v.grid.select("image_id", "y", "x", "is_line"), X.content_bbox(_inked(v), padding=4))


@query(
    "uncrop",
    f"""SELECT g.image_id, g.y, g.x, s.is_line FROM grid g JOIN ({BOX}) b USING (image_id)
        JOIN grid s ON s.image_id = g.image_id AND s.y = greatest(greatest(b.top, 0), least(g.y, least(b.bottom, b.h) - 1))
         AND s.x = greatest(greatest(b."left", 0), least(g.x, least(b."right", b.w) - 1))""",
)
def uncrop(v):
    boxes = X.content_bbox(_inked(v), padding=4)
    return X.uncrop(X.crop(v.grid.select("image_id", "y", "x", "is_line"), boxes), boxes)


RESIZED = """
  SELECT z.image_id, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, g.v FROM imgsize z, range(0, 12) a(i), range(0, 20) b(j)
  JOIN mask g ON g.image_id = z.image_id AND g.y = CAST(floor((i + 0.5::DOUBLE) * (z.h / 12::DOUBLE)) AS INTEGER)
   AND g.x = CAST(floor((j + 0.5::DOUBLE) * (z.w / 20::DOUBLE)) AS INTEGER)"""


def sizes(v):
    base = v.grid.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    out_h, out_w = X.fit_size(F.col("h"), F.col("w"), 20, 20)
    return base.withColumns({"out_h": out_h, "out_w": out_w})


@query("resize_nearest", RESIZED)
def resize_nearest(v):
    return X.resize_nearest(v.mask, sizes(v))


@query(
    "pad_center",
    f"""SELECT z.image_id, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, coalesce(r.v, -100) AS v FROM imgsize z, range(0, 20) a(i), range(0, 20) b(j)
        LEFT JOIN ({RESIZED}) r ON r.image_id = z.image_id AND r.y = i - 4 AND r.x = j""",
)
def pad_center(v):
    small = X.resize_nearest(v.mask, sizes(v))
    placed = sizes(v).select("image_id", F.col("out_h").alias("h"), F.col("out_w").alias("w"))
    return X.pad_center(small, placed, 20, 20, -100, "v")


EDT = """
  SELECT p.image_id, p.y, p.x, round(sqrt(min((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))), 6) AS dist
  FROM mask p JOIN mask q ON q.image_id = p.image_id AND q.v = {v} GROUP BY ALL"""


@query("distance_transform", EDT.format(v=0))
def distance_transform(v):
    return X.distance_transform(v.mask).withColumn("dist", F.round("dist", 6))


@query(
    "signed_distance",
    f"""WITH i AS ({EDT.format(v=0).replace('round(', '(').replace(', 6)', ')')}), o AS ({EDT.format(v=1).replace('round(', '(').replace(', 6)', ')')}),
        s AS (SELECT i.image_id, i.y, i.x, i.dist - o.dist AS sdf FROM i JOIN o USING (image_id, y, x))
        SELECT image_id, y, x, round((sdf - min(sdf) OVER w) / (max(sdf) OVER w - min(sdf) OVER w), 6) AS sdf FROM s WINDOW w AS (PARTITION BY image_id)""",
)
def signed_distance(v):
    return X.signed_distance(v.mask).withColumn("sdf", F.round("sdf", 6))


NEIGHBORS = """
  SELECT p.image_id, p.y, p.x, p.is_line AS line, count(q.y) AS neighbors FROM grid p
  LEFT JOIN grid q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1
    AND NOT (q.y = p.y AND q.x = p.x) AND q.is_line GROUP BY ALL"""


@query("neighbor_count", f"SELECT image_id, y, x, line, CAST(neighbors AS INTEGER) AS neighbors FROM ({NEIGHBORS})")
def neighbor_count(v):
    return X.neighbor_count(lines(v), tile=T)


def _up_left(flag: str, source: str) -> str:
    return f"""SELECT p.image_id, p.y, p.x, coalesce({flag}(q.f), false) AS f FROM {source} p JOIN {source} q ON q.image_id = p.image_id
               AND q.y BETWEEN p.y - 1 AND p.y AND q.x BETWEEN p.x - 1 AND p.x GROUP BY ALL"""


@query(
    "keypoints",
    f"""WITH n AS ({NEIGHBORS}), j AS (SELECT image_id, y, x, line AND neighbors BETWEEN 3 AND 6 AS f FROM n),
        worn AS ({_up_left('bool_and', 'j')}), opened AS ({_up_left('bool_or', 'worn')}),
        c AS (SELECT image_id, (SELECT count(*) FROM opened o WHERE o.image_id = j.image_id AND o.f) > 0.3 * count(*) FILTER (f) AS clean FROM j GROUP BY image_id)
        SELECT image_id, y, x, 'endpoint' AS kind FROM n WHERE line AND neighbors = 1
        UNION ALL SELECT j.image_id, j.y, j.x, 'junction' FROM j JOIN opened o USING (image_id, y, x) JOIN c USING (image_id)
        WHERE CASE WHEN clean THEN o.f ELSE j.f END""",
)
def keypoints(v):
    return X.keypoints(lines(v), tile=T).where("kind <> 'corner'")


@query("corners")
def corners(v):
    return X.keypoints(lines(v), tile=T).where("kind = 'corner'")


@query(
    "combine_boundary",
    """SELECT image_id, y, x, greatest(CASE WHEN (a / 255.0::DOUBLE) * 10 < 0.9 THEN 1.0 ELSE 0.0 END, CASE WHEN is_line THEN 1.0 ELSE 0.0 END)::DOUBLE AS boundary FROM grid""",
)
def combine_boundary(v):
    udf = v.grid.select("image_id", "y", "x", (F.col("a") / 255.0).alias("udf"))
    return X.combine_boundary(udf, im255(v), 0.9)


@query(
    "combine_edges",
    """WITH p AS (SELECT image_id, y, x, CASE WHEN is_line THEN 0 ELSE 255 END AS b, CASE WHEN r = 220 AND g = 41 THEN 255 ELSE a END AS e, CASE WHEN inside THEN 255 ELSE 0 END AS m FROM grid),
       i AS (SELECT p.image_id, p.y, p.x, min(q.m) AS inn FROM p JOIN p q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL)
       SELECT p.image_id, p.y, p.x, CASE WHEN m <> 0 AND least(255, round_even(b * 0.8::DOUBLE + e, 0)) = 255 THEN 255 ELSE 0 END AS combined,
              CASE WHEN inn <> 0 THEN e ELSE 0 END AS masked_edges FROM p JOIN i USING (image_id, y, x)""",
)
def combine_edges(v):
    px = v.grid.select(
        "image_id", "y", "x", F.when(F.col("is_line"), 0).otherwise(255).alias("binary"),
        F.when((F.col("r") == 220) & (F.col("g") == 41), 255).otherwise(F.col("a")).alias("edges"),
        F.when(F.col("inside"), 255).otherwise(0).alias("mask"),
    )
    return X.combine_edges(px, tile=T)


def _farthest(chosen: list[str], source: str) -> str:
    """The color of each project farthest from the ``chosen`` tables, of equal ones the smallest."""
    gap = ", ".join(f"power(t.r - {c}.r, 2) + power(t.g - {c}.g, 2) + power(t.b - {c}.b, 2)" for c in chosen)
    joins = " ".join(f"JOIN {c} ON {c}.p = t.p" for c in chosen)
    return f"""SELECT p, r, g, b FROM (SELECT t.*, least({gap}) AS gap, row_number() OVER (PARTITION BY t.p ORDER BY least({gap}) DESC, t.r, t.g, t.b) AS k
               FROM {source} t {joins}) WHERE k = 1 AND gap > 0"""


@query(
    "quantize_colors",
    f"""WITH px AS (SELECT image_id // 3 AS p, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, a FROM grid),
        t AS (SELECT p, r, g, b, count(*) AS n FROM px GROUP BY ALL),
        c1 AS (SELECT p, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, r, g, b) AS k FROM t) WHERE k = 1),
        c2 AS ({_farthest(["c1"], "t")}), c3 AS ({_farthest(["c1", "c2"], "t")}),
        c AS (SELECT 1 AS i, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3),
        m AS (SELECT t.p, t.r, t.g, t.b, arg_min(c, (power(t.r - c.r, 2) + power(t.g - c.g, 2) + power(t.b - c.b, 2)) * 10 + c.i) AS c
              FROM t JOIN c ON c.p = t.p GROUP BY ALL)
        SELECT px.p AS project_id, px.a, m.c.r AS r, m.c.g AS g, m.c.b AS b FROM px JOIN m ON m.p = px.p AND m.r = px.r AND m.g = px.g AND m.b = px.b""",
)
def quantize_colors(v):
    px = v.grid.select(F.expr("image_id div 3").alias("project_id"), "r", "g", "b", "a")
    return X.quantize_colors(px, 3)
