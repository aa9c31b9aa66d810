"""Queries: segment matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.functions import arrays as AR
from flatcel.operators import matching as M
from flatcel.operators.top_matches import top_matches as top
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.registry import query

VIEW_SQL["preds"] = """
  SELECT t.pair_id, t.seg_id AS tgt_seg, t.color_id AS tgt_color,
         CASE WHEN t.color_id = -100 THEN 0 ELSE coalesce(v.best, 0) END AS predicted
  FROM (SELECT * FROM feats WHERE side = 'tgt') t
  LEFT JOIN (SELECT pair_id, tgt_seg, arg_max(color_id, vote) AS best FROM votes GROUP BY ALL) v
    ON v.pair_id = t.pair_id AND v.tgt_seg = t.seg_id"""


def rounded(name, digits=6):
    return F.transform(name, lambda e: AR.rounded(e, digits)).alias(name)


@query(
    "norm_features",
    "SELECT pair_id, side, seg_id, list_transform(f, lambda z: round(z, 6)) AS f FROM nfeats",
)
def norm_features(v):
    return v.feats.select("pair_id", "side", "seg_id", AR.norm_features(F.col("features")).alias("f")).select(
        "pair_id", "side", "seg_id", rounded("f")
    )


@query(
    "similarity",
    """SELECT pair_id, tgt_seg, CAST(ref_seg // 128 AS BIGINT) AS ref_block, list(ref_seg ORDER BY ref_seg) AS ref_segs,
              list(round(sim, 4) ORDER BY ref_seg) AS sims FROM sims GROUP BY ALL""",
)
def similarity(v):
    return M.similarity(v.refs, v.tgts).select("pair_id", "tgt_seg", "ref_block", "ref_segs", rounded("sims", 4))


@query(
    "top_matches",
    """SELECT pair_id, tgt_seg, CAST(rank AS INTEGER) AS rank, ref_seg, round(sim, 4) AS sim FROM (
         SELECT *, row_number() OVER (PARTITION BY pair_id, tgt_seg ORDER BY sim DESC, ref_seg) AS rank FROM sims) WHERE rank <= 3""",
)
def top_matches(v):
    return top(v.refs, v.tgts, 3).select("pair_id", "tgt_seg", "rank", "ref_seg", AR.rounded(F.col("sim"), 4).alias("sim"))


@query(
    "masked_softmax",
    """SELECT pair_id, tgt_seg, CAST(ref_seg // 128 AS BIGINT) AS ref_block, list(ref_seg ORDER BY ref_seg) AS ref_segs,
              list(round(w, 6) ORDER BY ref_seg) AS weights FROM (
         SELECT *, e / sum(e) OVER (PARTITION BY pair_id, tgt_seg) AS w FROM (
           SELECT *, CASE WHEN ref_color = -100 THEN 0.0 ELSE exp(sim - 10) END AS e FROM sims)) GROUP BY ALL""",
)
def masked_softmax(v):
    return M.masked_softmax(M.similarity(v.refs, v.tgts)).select(
        "pair_id", "tgt_seg", "ref_block", "ref_segs", rounded("weights")
    )


@query("color_votes", "SELECT pair_id, tgt_seg, color_id, round(vote, 6) AS vote FROM votes")
def color_votes(v):
    return M.color_votes(v.refs, v.tgts).withColumn("vote", F.round("vote", 6))


@query("predict_colors", "SELECT * FROM preds")
def predict_colors(v):
    return M.predict_colors(M.color_votes(v.refs, v.tgts), v.tgts)


@query(
    "cycle_consistency",
    """WITH fwd AS (SELECT pair_id, tgt_seg, arg_max(ref_seg, sim) AS place FROM sims WHERE ref_color <> -100 GROUP BY ALL),
       send AS (SELECT p.pair_id, p.tgt_seg, coalesce(f.place, 0) AS place FROM preds p LEFT JOIN fwd f USING (pair_id, tgt_seg)
                WHERE p.tgt_color <> -100 AND p.predicted = p.tgt_color),
       bv AS (SELECT s.pair_id, s.ref_seg, d.place, sum(exp(s.sim - 10)) AS vote FROM sims s JOIN send d USING (pair_id, tgt_seg) GROUP BY ALL),
       back AS (SELECT pair_id, ref_seg, arg_max(place, vote) AS place FROM bv GROUP BY ALL)
       SELECT r.pair_id, count(*) FILTER (r.color_id <> -100) AS active,
              count(*) FILTER (r.color_id <> -100 AND coalesce(b.place, 0) = r.seg_id) AS returned
       FROM feats r LEFT JOIN back b ON b.pair_id = r.pair_id AND b.ref_seg = r.seg_id WHERE r.side = 'ref' GROUP BY r.pair_id""",
)
def cycle_consistency(v):
    return M.cycle_consistency(v.refs, v.tgts)


@query(
    "mean_cosine",
    """SELECT r.pair_id, round(avg(list_inner_product(r.features, t.features)
              / (sqrt(list_inner_product(r.features, r.features)) * sqrt(list_inner_product(t.features, t.features)))), 6) AS mean_cosine
       FROM feats r JOIN feats t ON r.pair_id = t.pair_id AND r.seg_id = t.seg_id AND r.side = 'ref' AND t.side = 'tgt'
       WHERE r.color_id <> -100 GROUP BY r.pair_id""",
)
def mean_cosine(v):
    a = v.refs.select("pair_id", "seg_id", F.col("features").alias("a"), (F.col("color_id") == -100).alias("is_padding"))
    b = v.tgts.select("pair_id", "seg_id", F.col("features").alias("b"))
    return M.mean_cosine(a.join(b, ["pair_id", "seg_id"])).withColumn("mean_cosine", AR.rounded(F.col("mean_cosine"), 6))


@query(
    "masked_logits",
    """WITH l AS (SELECT pair_id, seg_id, i - 1 AS i, features[i] + CASE WHEN s.color_id IS NULL THEN -10000 ELSE 0 END AS z
                  FROM feats, range(1, 65) t(i) LEFT JOIN (SELECT DISTINCT pair_id AS p, color_id FROM feats WHERE side = 'ref' AND color_id <> -100) s
                    ON s.p = pair_id AND s.color_id = i - 1 WHERE side = 'tgt'),
       p AS (SELECT *, exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w AS pr FROM (SELECT *, max(z) OVER (PARTITION BY pair_id, seg_id) AS m FROM l)
             WINDOW w AS (PARTITION BY pair_id, seg_id))
       SELECT pair_id, seg_id, list(round(pr, 6) ORDER BY i) AS probs, CAST(arg_max(i, pr) AS INTEGER) AS predicted FROM p GROUP BY ALL""",
)
def masked_logits(v):
    logits = v.tgts.select("pair_id", "seg_id", F.col("features").alias("logits"))
    return M.masked_logits(logits, v.refs.select("pair_id", "color_id")).select(
        "pair_id", "seg_id", rounded("probs"), "predicted"
    )


@query(
    "clamp_predictions",
    """SELECT p.pair_id AS project_id, tgt_seg, CASE WHEN predicted < coalesce(n, 0) THEN predicted ELSE -100 END AS color_id
       FROM preds p LEFT JOIN (SELECT pair_id, count(DISTINCT color_id) AS n FROM feats WHERE side = 'ref' GROUP BY 1) k USING (pair_id)""",
)
def clamp_predictions(v):
    ids = M.predict_colors(M.color_votes(v.refs, v.tgts), v.tgts).select(
        F.col("pair_id").alias("project_id"), "tgt_seg", F.col("predicted").alias("color_id")
    )
    palette = v.refs.select(F.col("pair_id").alias("project_id"), "color_id").distinct()
    return M.clamp_predictions(ids, palette)


@query(
    "confidence",
    """WITH l AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])[1:greatest(label, 1)]) AS z FROM embeddings),
       s AS (SELECT vec_id, label, ln(sum(exp(z))) - sum(exp(z) * z) / sum(exp(z)) AS h FROM l GROUP BY ALL)
       SELECT vec_id, round(CASE WHEN label <= 1 THEN 1.0 ELSE 1 - h / ln(CASE WHEN label <= 1 THEN 2 ELSE label END) END, 6) AS confidence FROM s""",
)
def confidence(v):
    return v.table("embeddings").select(
        "vec_id", F.round(AR.confidence(F.col("embedding"), F.col("label")), 6).alias("confidence")
    )


@query(
    "agreement",
    """WITH l AS (SELECT pair_id, side, seg_id, i, features[i] AS a, round(features[i], 1) AS b FROM feats, range(1, 65) t(i)),
       m AS (SELECT pair_id, side, seg_id, arg_min(i, (-a, i)) AS ia, arg_min(i, (-b, i)) AS ib, max(abs(a - b)) AS d FROM l GROUP BY ALL)
       SELECT m.pair_id, round(avg(CASE WHEN ia = ib THEN 1.0 ELSE 0.0 END) * 100, 6) AS agree_pct, round(max(d), 6) AS max_diff,
              round(coalesce(max(CASE WHEN ia <> ib THEN f.features[ia] - f.features[ib] END), 0), 6) AS flip_margin
       FROM m JOIN feats f USING (pair_id, side, seg_id) GROUP BY m.pair_id""",
)
def agreement(v):
    both = v.feats.select(
        "pair_id",
        F.transform("features", lambda e: e.cast("double")).alias("a"),
        F.transform("features", lambda e: F.round(e.cast("double"), 1)).alias("b"),
    )
    return M.agreement(both).select(
        "pair_id", *[F.round(c, 6).alias(c) for c in ("agree_pct", "max_diff", "flip_margin")]
    )


@query(
    "flip_report",
    """SELECT frame_id, count(*) AS total, count(*) FILTER ((a < 0.33) <> (b < 0.33)) AS flips,
              round(avg(CASE WHEN (a < 0.33) <> (b < 0.33) THEN 1.0 ELSE 0.0 END) * 100, 6) AS flip_pct, round(max(abs(a - b)), 6) AS max_diff
       FROM (SELECT l_suppkey AS frame_id, l_quantity / 50 AS a, round(l_quantity / 50, 1) AS b FROM lineitem) GROUP BY frame_id""",
)
def flip_report(v):
    values = v.table("lineitem").selectExpr(
        "l_suppkey as frame_id", "l_quantity / 50 as a", "round(l_quantity / 50, 1) as b"
    )
    return M.flip_report(values, 0.33).select(
        "frame_id", "total", "flips", F.round("flip_pct", 6).alias("flip_pct"), F.round("max_diff", 6).alias("max_diff")
    )


@query(
    "pool_features",
    """SELECT image_id, seg_id, list(round(m, 6) ORDER BY i) AS features FROM (
         SELECT vec_id // 100 AS image_id, label AS seg_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
         FROM embeddings, range(1, 65) t(i) WHERE label <> 3 GROUP BY ALL) GROUP BY ALL""",
)
def pool_features(v):
    pixels = v.table("embeddings").select(
        F.expr("vec_id div 100").alias("image_id"),
        F.when(F.col("label") == 3, -100).otherwise(F.col("label")).alias("seg_id"),
        F.col("embedding").alias("features"),
    )
    return M.pool_features(pixels).select("image_id", "seg_id", rounded("features"))
