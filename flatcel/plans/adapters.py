"""Frame, pixel, palette and file tables derived from the driver tables.

Every view is a projection of a whole table (no sampling, no row caps), stated
twice: as a DataFrame here and as SQL for the oracle.

* ``frames``: 1000 consecutive events make one project's timeline, the limit a
  timeline has; the event type is the drawing, so holds arise by chance.
* ``lpix``: one line item is one colored pixel of a segment.
* ``grid``: one order is one pixel of a 50 x 30 image (square, circle or
  triangle outline with specks).
* ``feats``: 50 consecutive embeddings make a reference and a target frame.
* ``seqs``: conversations as frame sequences; ``swatches``: parts as palette
  entries; ``images``: documents as image bytes; ``files``: orders as files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LINE, COLOR = "lineLayer1", "colorLayer1"

VIEW_SQL: dict[str, str] = {
    "lpix": """
      SELECT l_suppkey AS frame_id, l_partkey % 50 AS seg_id,
             CASE WHEN l_quantity > 45 THEN 200 ELSE 40 END AS r,
             CASE WHEN l_linenumber = 1 THEN 180 ELSE 90 END AS g,
             CAST(l_suppkey % 5 AS INTEGER) * 20 AS b,
             CASE WHEN l_discount <= 0.03 THEN 0 ELSE 255 END AS a,
             l_returnflag = 'R' OR l_partkey % 50 = 11 AS is_line,
             l_partkey % 50 IN (7, 13) AS is_black
      FROM lineitem""",
    "lseg": """
      WITH by_color AS (
        SELECT frame_id, seg_id, r, g, b, count(*) AS n,
               count(*) FILTER (NOT is_line) AS n_open,
               count(*) FILTER (NOT is_line AND a = 0) AS n_clear,
               count(*) FILTER (NOT is_black) AS n_not_black,
               count(*) FILTER (NOT is_line AND a <> 0) AS n_vote
        FROM lpix GROUP BY ALL),
      s AS (
        SELECT frame_id, seg_id, sum(n) AS num_pixels, sum(n_open) AS op, sum(n_clear) AS cl,
               sum(n_not_black) AS nb, count(*) FILTER (n_vote > 0) AS k,
               kurtosis_pop(n_vote) FILTER (n_vote > 0) + 3 AS peak,
               arg_max(r + 256 * g + 65536 * b, n_vote * 100000000 - (r * 65536 + g * 256 + b))
                 FILTER (n_vote > 0) AS top
        FROM by_color GROUP BY ALL),
      t AS (
        SELECT *, CASE WHEN k > 1 THEN peak / k END AS score,
               CASE WHEN op = 0 THEN 'over_thresholded' WHEN cl > op * 0.5 THEN 'transparent'
                    WHEN nb = 0 THEN 'black'
                    WHEN k = 1 OR coalesce(peak / k >= 0.49, false) THEN 'normal'
                    ELSE 'multi_color' END AS status
        FROM s)
      SELECT frame_id, seg_id,
             CAST(CASE status WHEN 'transparent' THEN 0 WHEN 'black' THEN 4278190080
                  WHEN 'normal' THEN top + 4278190080 ELSE -100 END AS BIGINT) AS color,
             status, CAST(num_pixels AS BIGINT) AS num_pixels,
             CASE WHEN status IN ('normal', 'multi_color') THEN score END AS peakiness
      FROM t""",
    "frames": """
      SELECT event_id // 1000 AS project_id, 'lineLayer1' AS layer,
             CAST(event_id % 1000 AS INTEGER) + 1 AS frame_nr,
             CASE WHEN event_type = 'error' AND value < 20 THEN NULL
                  ELSE 'L_' || event_type END AS image_id,
             event_type = 'purchase' AS is_original, value > 69 AS is_selected
      FROM events WHERE NOT (event_type = 'signup' AND value < 10)
      UNION ALL
      SELECT event_id // 1000, 'colorLayer1', CAST(event_id % 1000 AS INTEGER) + 1,
             CASE WHEN event_type = 'view' AND value < 60 THEN NULL
                  ELSE 'C_' || event_type || '_' || CAST(user_id % 4 AS VARCHAR) END,
             value > 150, value BETWEEN 40 AND 160
      FROM events WHERE value > 30""",
    "dkey": """
      SELECT f.*, CASE WHEN f.image_id IS NOT NULL THEN 'own:' || f.image_id
                       WHEN o.image_id IS NOT NULL THEN 'linked:' || o.image_id END AS drawing
      FROM frames f LEFT JOIN frames o
        ON o.project_id = f.project_id AND o.frame_nr = f.frame_nr AND o.layer <> f.layer""",
    "grid": """
      SELECT image_id, y, x,
             CASE WHEN is_line THEN 255 - CAST(o_custkey % 56 AS INTEGER) ELSE
                  CASE WHEN o_totalprice > 430000 THEN CAST(o_custkey % 56 AS INTEGER) ELSE 0 END
             END AS a,
             is_line, inside,
             CASE WHEN is_line THEN 0 WHEN inside THEN 220 ELSE 30 END AS r,
             CASE WHEN is_line THEN 0 WHEN o_orderstatus = 'F' THEN 40 ELSE 41 END AS g,
             CASE WHEN is_line THEN 0 ELSE CAST(image_id % 3 AS INTEGER) * 60 END AS b
      FROM (
        SELECT *, o_totalprice > 485000 OR CASE image_id % 3
            WHEN 0 THEN (x IN (6, 43) AND y BETWEEN 5 AND 24) OR (y IN (5, 24) AND x BETWEEN 6 AND 43)
            WHEN 1 THEN (x - 25) * (x - 25) + (y - 15) * (y - 15) BETWEEN 81 AND 121
            ELSE (y = 25 AND x BETWEEN 7 AND 43) OR (y BETWEEN 4 AND 25 AND abs(21 * (x - 25)) - 18 * (y - 4) BETWEEN -36 AND 0)
          END AS is_line,
          CASE image_id % 3
            WHEN 0 THEN x BETWEEN 7 AND 42 AND y BETWEEN 6 AND 23
            WHEN 1 THEN (x - 25) * (x - 25) + (y - 15) * (y - 15) < 81
            ELSE y BETWEEN 5 AND 24 AND abs(21 * (x - 25)) - 18 * (y - 4) < -36
          END AS inside
        FROM (SELECT o_orderkey // 1500 AS image_id, CAST((o_orderkey // 50) % 30 AS INTEGER) AS y,
                     CAST(o_orderkey % 50 AS INTEGER) AS x, * FROM orders))""",
    "mask": """SELECT image_id, y, x, CASE WHEN is_line THEN 0 ELSE 1 END AS v FROM grid""",
    "feats": """
      SELECT vec_id // 50 AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'ref' ELSE 'tgt' END AS side,
             CAST((vec_id % 50) // 2 AS INTEGER) AS seg_id,
             CASE WHEN label = 9 THEN -100 ELSE label END AS color_id,
             CAST(embedding AS DOUBLE[]) AS features
      FROM embeddings""",
    "nfeats": """
      SELECT pair_id, side, seg_id, color_id,
             list_transform(c, lambda z: z / (sqrt(list_sum(list_transform(c, lambda w: w * w))) + 1e-10)) AS f
      FROM (SELECT *, list_transform(features, lambda z: z - list_avg(features)) AS c FROM feats)""",
    "sims": """
      SELECT r.pair_id, r.seg_id AS ref_seg, t.seg_id AS tgt_seg, r.color_id AS ref_color,
             t.color_id AS tgt_color, list_inner_product(r.f, t.f) / 0.1 AS sim
      FROM nfeats r JOIN nfeats t ON r.pair_id = t.pair_id AND r.side = 'ref' AND t.side = 'tgt'""",
    "votes": """
      SELECT pair_id, tgt_seg, CASE WHEN ref_color = -100 THEN 0 ELSE ref_color END AS color_id,
             sum(w) AS vote
      FROM (SELECT *, CASE WHEN ref_color = -100 THEN 0 ELSE
                    exp(sim - 10) / sum(CASE WHEN ref_color = -100 THEN 0 ELSE exp(sim - 10) END)
                      OVER (PARTITION BY pair_id, tgt_seg) END AS w FROM sims)
      WHERE ref_color <> -100 GROUP BY ALL""",
    "swatches": """
      SELECT p_partkey // 100 AS project_id, CAST(p_partkey % 100 AS INTEGER) AS pos,
             '#' || lpad(lower(to_hex((p_partkey * 2654435) % 256)), 2, '0')
                 || lpad(lower(to_hex((p_size * 5) % 256)), 2, '0')
                 || lpad(lower(to_hex(p_partkey % 4 * 60)), 2, '0') AS hex,
             CASE WHEN p_size > 40 THEN NULL ELSE
               '#' || lpad(lower(to_hex((p_size % 7) * 30)), 2, '0') || '28b4' END AS new_hex,
             CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN false ELSE true END AS visible,
             CASE WHEN p_type = 'LARGE' THEN false WHEN p_type = 'ECONOMY' THEN NULL ELSE true END AS new_visible,
             CASE WHEN p_size % 5 = 0 THEN NULL ELSE 255 - p_size END AS opacity,
             CASE WHEN p_size % 3 = 0 THEN NULL ELSE 200 + p_size END AS new_opacity,
             p_size > 25 AS selected
      FROM part""",
    "nswatches": """
      SELECT project_id, pos, hex, coalesce(new_hex, hex) AS new_hex, coalesce(visible, true) AS visible,
             coalesce(opacity, 255) AS opacity, coalesce(new_opacity, opacity, 255) AS new_opacity,
             coalesce(new_visible, visible, true) AS new_visible, selected
      FROM swatches""",
    "images": """
      SELECT doc_id AS seq, 'img_' || CAST(doc_id AS VARCHAR) AS image_id, text AS content,
             md5(text) AS hash, lang, source, n_chars FROM documents""",
    "seqs": """
      SELECT conv_id AS project_id, CAST(turn AS INTEGER) AS frame_idx,
             CAST(length(text) % 64 + 1 AS INTEGER) AS length, md5(CAST(length(text) // 300 AS VARCHAR)) AS hash
      FROM conversations""",
    "files": """
      SELECT o_orderkey AS seq, o_custkey AS scene,
             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'line'
                  WHEN o_orderpriority = '3-MEDIUM' THEN 'seg' ELSE 'color' END AS kind,
             (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'lineLayer1' ELSE 'colorLayer1' END)
               || '_f' || lpad(CAST(o_orderkey // 3 % 1200 AS VARCHAR), 4, '0') || '_' ||
               (CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey % 30 AS VARCHAR) || 'A' WHEN 'O' THEN CAST(o_orderkey % 1100 AS VARCHAR) ELSE 'x' END)
               || (CASE WHEN o_orderpriority = '5-LOW' THEN '.PNG' WHEN o_orderpriority = '2-HIGH' THEN '.jpg' ELSE '.png' END) AS name,
             CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderstatus AS flag
      FROM orders""",
    "pts": """
      SELECT DISTINCT o_orderkey // 4096 AS image_id, CAST(o_custkey % 256 AS INTEGER) AS y,
             CAST(o_orderkey * 7 % 256 AS INTEGER) AS x FROM orders""",
}


class Views:
    """The adapter views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lpix(self) -> DataFrame:
        seg = F.col("l_partkey") % 50
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("frame_id"),
            seg.alias("seg_id"),
            F.when(F.col("l_quantity") > 45, 200).otherwise(40).alias("r"),
            F.when(F.col("l_linenumber") == 1, 180).otherwise(90).alias("g"),
            ((F.col("l_suppkey") % 5).cast("int") * 20).alias("b"),
            F.when(F.col("l_discount") <= 0.03, 0).otherwise(255).alias("a"),
            ((F.col("l_returnflag") == "R") | (seg == 11)).alias("is_line"),
            seg.isin(7, 13).alias("is_black"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        e = self.table("events")
        project = F.expr("event_id div 1000").alias("project_id")
        nr = ((F.col("event_id") % 1000).cast("int") + 1).alias("frame_nr")
        kind, value = F.col("event_type"), F.col("value")
        line = e.where(~((kind == "signup") & (value < 10))).select(
            project,
            F.lit(LINE).alias("layer"),
            nr,
            F.when((kind == "error") & (value < 20), None)
            .otherwise(F.concat(F.lit("L_"), kind))
            .alias("image_id"),
            (kind == "purchase").alias("is_original"),
            (value > 69).alias("is_selected"),
        )
        color = e.where(value > 30).select(
            project,
            F.lit(COLOR).alias("layer"),
            nr,
            F.when((kind == "view") & (value < 60), None)
            .otherwise(F.concat(F.lit("C_"), kind, F.lit("_"), (F.col("user_id") % 4).cast("string")))
            .alias("image_id"),
            (value > 150).alias("is_original"),
            value.between(40, 160).alias("is_selected"),
        )
        return line.unionByName(color)

    @cached_property
    def grid(self) -> DataFrame:
        o = self.table("orders").withColumns(
            {
                "image_id": F.expr("o_orderkey div 1500"),
                "y": F.expr("cast((o_orderkey div 50) % 30 as int)"),
                "x": F.expr("cast(o_orderkey % 50 as int)"),
            }
        )
        line = """o_totalprice > 485000 or case image_id % 3
            when 0 then (x in (6, 43) and y between 5 and 24) or (y in (5, 24) and x between 6 and 43)
            when 1 then (x - 25) * (x - 25) + (y - 15) * (y - 15) between 81 and 121
            else (y = 25 and x between 7 and 43)
              or (y between 4 and 25 and abs(21 * (x - 25)) - 18 * (y - 4) between -36 and 0) end"""
        inside = """case image_id % 3
            when 0 then x between 7 and 42 and y between 6 and 23
            when 1 then (x - 25) * (x - 25) + (y - 15) * (y - 15) < 81
            else y between 5 and 24 and abs(21 * (x - 25)) - 18 * (y - 4) < -36 end"""
        o = o.withColumn("is_line", F.expr(line)).withColumn("inside", F.expr(inside))
        return o.selectExpr(
            "image_id",
            "y",
            "x",
            """case when is_line then 255 - cast(o_custkey % 56 as int)
                    when o_totalprice > 430000 then cast(o_custkey % 56 as int) else 0 end as a""",
            "is_line",
            "inside",
            "case when is_line then 0 when inside then 220 else 30 end as r",
            "case when is_line then 0 when o_orderstatus = 'F' then 40 else 41 end as g",
            "case when is_line then 0 else cast(image_id % 3 as int) * 60 end as b",
        )

    @cached_property
    def mask(self) -> DataFrame:
        return self.grid.select("image_id", "y", "x", F.when(F.col("is_line"), 0).otherwise(1).alias("v"))

    @cached_property
    def feats(self) -> DataFrame:
        return self.table("embeddings").select(
            F.expr("vec_id div 50").alias("pair_id"),
            F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("tgt").alias("side"),
            F.expr("cast((vec_id % 50) div 2 as int)").alias("seg_id"),
            F.when(F.col("label") == 9, -100).otherwise(F.col("label")).alias("color_id"),
            F.col("embedding").alias("features"),
        )

    @property
    def refs(self) -> DataFrame:
        return self.feats.where("side = 'ref'").drop("side")

    @property
    def tgts(self) -> DataFrame:
        return self.feats.where("side = 'tgt'").drop("side")

    @cached_property
    def swatches(self) -> DataFrame:
        def two(expr: str) -> Column:
            return F.lpad(F.lower(F.hex(F.expr(expr))), 2, "0")

        size, kind = F.col("p_size"), F.col("p_type")
        return self.table("part").select(
            F.expr("p_partkey div 100").alias("project_id"),
            (F.col("p_partkey") % 100).cast("int").alias("pos"),
            F.concat(
                F.lit("#"), two("(p_partkey * 2654435) % 256"), two("(p_size * 5) % 256"), two("p_partkey % 4 * 60")
            ).alias("hex"),
            F.when(size > 40, None)
            .otherwise(F.concat(F.lit("#"), two("(p_size % 7) * 30"), F.lit("28b4")))
            .alias("new_hex"),
            F.when(kind == "PROMO", None).when(kind == "SMALL", False).otherwise(True).alias("visible"),
            F.when(kind == "LARGE", False).when(kind == "ECONOMY", None).otherwise(True).alias("new_visible"),
            F.when(size % 5 == 0, None).otherwise(255 - size).alias("opacity"),
            F.when(size % 3 == 0, None).otherwise(size + 200).alias("new_opacity"),
            (size > 25).alias("selected"),
        )

    @cached_property
    def images(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("seq"),
            F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("image_id"),
            F.col("text").alias("content"),
            F.md5("text").alias("hash"),
            "lang",
            "source",
            "n_chars",
        )

    @cached_property
    def seqs(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("project_id"),
            F.col("turn").cast("int").alias("frame_idx"),
            (F.length("text") % 64 + 1).alias("length"),
            F.md5(F.expr("cast(length(text) div 300 as string)")).alias("hash"),
        )

    @cached_property
    def files(self) -> DataFrame:
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        return self.table("orders").select(
            F.col("o_orderkey").alias("seq"),
            F.col("o_custkey").alias("scene"),
            F.when(urgent, "line").when(F.col("o_orderpriority") == "3-MEDIUM", "seg").otherwise("color").alias("kind"),
            F.concat(
                F.when(urgent, F.lit(LINE)).otherwise(F.lit(COLOR)),
                F.lit("_f"),
                F.lpad(F.expr("cast(o_orderkey div 3 % 1200 as string)"), 4, "0"),
                F.lit("_"),
                F.when(F.col("o_orderstatus") == "F", F.expr("concat(cast(o_orderkey % 30 as string), 'A')"))
                .when(F.col("o_orderstatus") == "O", F.expr("cast(o_orderkey % 1100 as string)"))
                .otherwise("x"),
                F.when(F.col("o_orderpriority") == "5-LOW", ".PNG")
                .when(F.col("o_orderpriority") == "2-HIGH", ".jpg")
                .otherwise(".png"),
            ).alias("name"),
            F.floor("o_totalprice").alias("size"),
            F.col("o_orderstatus").alias("flag"),
        )

    @cached_property
    def pts(self) -> DataFrame:
        return (
            self.table("orders")
            .select(
                F.expr("o_orderkey div 4096").alias("image_id"),
                F.expr("cast(o_custkey % 256 as int)").alias("y"),
                F.expr("cast(o_orderkey * 7 % 256 as int)").alias("x"),
            )
            .distinct()
        )

    @cached_property
    def segments(self) -> DataFrame:
        from flatcel.operators.segments import segment_colors

        return segment_colors(self.lpix)
