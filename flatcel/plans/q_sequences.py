"""Queries: sequences, packing, padding, corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.operators import sequences as Q
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.registry import query

VIEW_SQL["scenefiles"] = """
  SELECT o_custkey AS scene, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'line' WHEN o_orderpriority = '3-MEDIUM' THEN 'seg' ELSE 'color' END AS kind,
         CAST(o_orderkey % 3 AS INTEGER) AS frame_idx, o_orderkey AS seq, o_totalprice < 60000 AS is_empty, o_orderstatus = 'P' AS is_corrupt FROM orders"""
VIEW_SQL["byidx"] = """
  SELECT scene, frame_idx, min(seq) FILTER (kind = 'seg') AS seg_seq, min(seq) FILTER (kind = 'color') AS color_seq, min(seq) FILTER (kind = 'line') AS line_seq
  FROM scenefiles GROUP BY ALL"""
VIEW_SQL["sharing"] = """
  SELECT scene, count(*) FILTER (seg_seq IS NOT NULL AND color_seq IS NOT NULL AND line_seq IS NOT NULL) AS n FROM byidx GROUP BY scene"""


def scene_files(v):
    o = v.table("orders")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.select(
        F.col("o_custkey").alias("scene"),
        F.when(urgent, "line").when(F.col("o_orderpriority") == "3-MEDIUM", "seg").otherwise("color").alias("kind"),
        (F.col("o_orderkey") % 3).cast("int").alias("frame_idx"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_totalprice") < 60000).alias("is_empty"),
        (F.col("o_orderstatus") == "P").alias("is_corrupt"),
    )


@query(
    "align_frames",
    """SELECT b.* FROM byidx b JOIN sharing s USING (scene)
       WHERE n >= 2 AND seg_seq IS NOT NULL AND color_seq IS NOT NULL AND line_seq IS NOT NULL""",
)
def align_frames(v):
    return Q.align_frames(scene_files(v))[0]


@query(
    "align_frames_errors",
    "SELECT scene, CASE WHEN n = 0 THEN 'NO_SHARED_FRAMES' ELSE 'ONE_SHARED_FRAME' END AS error FROM sharing WHERE n < 2",
)
def align_frames_errors(v):
    return Q.align_frames(scene_files(v))[1]


@query("filter_empty", "SELECT * FROM scenefiles WHERE NOT is_empty")
def filter_empty(v):
    return Q.filter_empty(scene_files(v))[0]


@query(
    "filter_empty_stats",
    """SELECT scene, kind, count(*) FILTER (is_empty) AS num_empty, count(*) FILTER (is_empty AND is_corrupt) AS num_corrupt
       FROM scenefiles GROUP BY ALL""",
)
def filter_empty_stats(v):
    return Q.filter_empty(scene_files(v))[1]


@query(
    "drop_repeats",
    """SELECT project_id, frame_idx, length, hash FROM (
         SELECT *, lag(hash) OVER (PARTITION BY project_id ORDER BY frame_idx) AS p FROM seqs) WHERE p IS NULL OR p <> hash""",
)
def drop_repeats(v):
    return Q.drop_repeats(v.seqs)


@query(
    "chunk",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY frame_idx) - 1 AS pos FROM seqs)
       SELECT project_id, frame_idx, length, hash, c AS chunk, pos - c * 2 AS chunk_pos FROM n, range(0, 100) t(c)
       WHERE pos BETWEEN c * 2 AND c * 2 + 2""",
)
def chunk(v):
    return Q.chunk(v.seqs, 3, 1)


@query(
    "take_frames",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY frame_idx) - 1 AS pos FROM seqs)
       SELECT project_id, pick, pos, frame_idx, length, hash FROM n
       JOIN (SELECT project_id, frame_idx AS pick, CAST(length % 4 AS BIGINT) AS pos FROM seqs) p USING (project_id, pos)""",
)
def take_frames(v):
    picks = v.seqs.select("project_id", F.col("frame_idx").alias("pick"), (F.col("length") % 4).cast("long").alias("pos"))
    return Q.take(v.seqs, picks)


@query(
    "reverse_frames",
    "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY frame_idx DESC) - 1 AS pos FROM seqs",
)
def reverse_frames(v):
    return Q.reverse(v.seqs)


@query(
    "frame_combos",
    """SELECT a.project_id, [a.frame_idx, b.frame_idx, c.frame_idx] AS frames FROM seqs a
       JOIN seqs b ON a.project_id = b.project_id AND a.frame_idx <> b.frame_idx AND abs(a.frame_idx - b.frame_idx) <= 2
       JOIN seqs c ON a.project_id = c.project_id AND a.frame_idx <> c.frame_idx AND b.frame_idx <> c.frame_idx
        AND abs(a.frame_idx - c.frame_idx) <= 2 AND abs(b.frame_idx - c.frame_idx) <= 2""",
)
def frame_combos(v):
    return Q.frame_combos(v.seqs, 3, 2)


@query(
    "sample_subsequences",
    """WITH s AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS n FROM seqs),
       c AS (SELECT a.project_id, count(*) AS k FROM s a JOIN s b ON a.project_id = b.project_id AND a.frame_idx <> b.frame_idx
               AND abs(a.frame_idx - b.frame_idx) <= CASE WHEN a.n < 5 THEN 10000 ELSE 2 END GROUP BY 1)
       SELECT project_id, greatest(5, least(12, k)) AS num_subseqs FROM c""",
)
def sample_subsequences(v):
    picked = Q.sample_subsequences(v.seqs, 2, 2, max_subseqs=12, min_subseqs=5, seed=7)
    return picked.groupBy("project_id").agg(F.count("*").alias("num_subseqs"))


# With lengths 1 to 3 no sequence has fewer than min_subseqs tuples.
@query(
    "subsequence_rows",
    """WITH s AS (SELECT project_id, frame_idx AS f, CASE WHEN count(*) OVER w < 5 THEN 10000 ELSE 2 END AS d, count(*) OVER w AS n
                  FROM seqs WINDOW w AS (PARTITION BY project_id)),
       c AS (SELECT project_id, [f] AS frames FROM s WHERE n >= 3
             UNION ALL SELECT a.project_id, [a.f, b.f] FROM s a JOIN s b ON a.project_id = b.project_id AND a.f <> b.f AND abs(a.f - b.f) <= a.d WHERE a.n >= 3
             UNION ALL SELECT a.project_id, [a.f, b.f, c.f] FROM s a JOIN s b ON a.project_id = b.project_id AND a.f <> b.f AND abs(a.f - b.f) <= a.d
               JOIN s c ON a.project_id = c.project_id AND a.f <> c.f AND b.f <> c.f AND abs(a.f - c.f) <= a.d AND abs(b.f - c.f) <= a.d WHERE a.n >= 3)
       SELECT project_id, frames FROM c
       QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY md5('7:' || array_to_string(frames, ',')), frames) <= 20""",
)
def subsequence_rows(v):
    return Q.sample_subsequences(v.seqs, 3, 2, max_subseqs=20, min_subseqs=4, seed=7)


# Tuples listed and ranked, one rank drawn in each of equal parts, repeats for projects with few.
DRAWN = """r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY len(frames), list_min(frames), list_reverse_sort(frames), frames) - 1 AS rank,
                   count(*) OVER (PARTITION BY project_id) AS total FROM c),
       t AS (SELECT DISTINCT project_id, total, least(total, {most}) AS m FROM r),
       j AS (SELECT *, unnest(range(greatest(m, {least}))) AS draw FROM t),
       d AS (SELECT project_id, draw, CASE WHEN draw < m
               THEN draw * total // m + CAST('0x' || substr(md5('7:' || project_id || ':' || draw), 1, 15) AS BIGINT) % greatest((draw + 1) * total // m - draw * total // m, 1)
               ELSE CAST('0x' || substr(md5('8:' || project_id || ':' || draw), 1, 15) AS BIGINT) % total END AS rank FROM j)
       SELECT d.project_id, d.draw, r.frames FROM d JOIN r ON d.project_id = r.project_id AND d.rank = r.rank"""


@query(
    "draw_subsequences",
    """WITH s AS (SELECT project_id, frame_idx AS f, CASE WHEN count(*) OVER w < 5 THEN 10000 ELSE 4 END AS d, count(*) OVER w AS n
                  FROM seqs WINDOW w AS (PARTITION BY project_id)),
       c AS (SELECT project_id, [f] AS frames FROM s WHERE n >= 3
             UNION ALL SELECT a.project_id, [a.f, b.f] FROM s a JOIN s b ON a.project_id = b.project_id AND a.f <> b.f AND abs(a.f - b.f) <= a.d WHERE a.n >= 3
             UNION ALL SELECT a.project_id, [a.f, b.f, c.f] FROM s a JOIN s b ON a.project_id = b.project_id AND a.f <> b.f AND abs(a.f - b.f) <= a.d
               JOIN s c ON a.project_id = c.project_id AND a.f <> c.f AND b.f <> c.f AND abs(a.f - c.f) <= a.d AND abs(b.f - c.f) <= a.d WHERE a.n >= 3),
       """ + DRAWN.format(most=30, least=4),
)
def draw_subsequences(v):
    return Q.draw_subsequences(v.seqs, 3, 4, max_subseqs=30, min_subseqs=4, seed=7)


@query(
    "draw_pairs",
    """WITH s AS (SELECT project_id, frame_idx AS f, CASE WHEN count(*) OVER w < 5 THEN 10000 ELSE 2 END AS d
                  FROM seqs WINDOW w AS (PARTITION BY project_id)),
       c AS (SELECT a.project_id, [a.f, b.f] AS frames FROM s a JOIN s b ON a.project_id = b.project_id AND a.f <> b.f AND abs(a.f - b.f) <= a.d),
       """ + DRAWN.format(most=12, least=5),
)
def draw_pairs(v):
    return Q.draw_subsequences(v.seqs, 2, 2, max_subseqs=12, min_subseqs=5, seed=7)


BYTE = "CAST('0x' || substr(md5('11:{k}:' || project_id || ':' || pos), 1, 8) AS BIGINT) % 256"


@query(
    "random_palette",
    f"""SELECT project_id, pos AS color_id, {BYTE.format(k=0)} + {BYTE.format(k=1)} * 256 + {BYTE.format(k=2)} * 65536 + 255 * 16777216::BIGINT AS color
        FROM swatches""",
)
def random_palette(v):
    palette = v.swatches.select("project_id", F.col("pos").alias("color_id"))
    return Q.random_palette(palette, seed=11)


@query(
    "shuffle_roundtrip",
    """SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY frame_idx) - 1 AS pos, length FROM seqs""",
)
def shuffle_roundtrip(v):
    rows = Q.numbered_frames(v.seqs).select("project_id", "pos", "length")
    mixed = Q.shuffle(rows, seed=5)
    return Q.unshuffle(mixed, mixed.select("project_id", "shuffled", "length")).select("project_id", "pos", "length")


VIEW_SQL["packed"] = """
  WITH RECURSIVE i AS (SELECT project_id AS image_id, frame_idx AS item, length FROM seqs),
  p AS (SELECT image_id, item, 0::BIGINT AS row_nr, 0::BIGINT AS s, length::BIGINT AS e FROM i WHERE item = 0
        UNION ALL
        SELECT i.image_id, i.item, CASE WHEN p.e + i.length > 96 THEN p.row_nr + 1 ELSE p.row_nr END,
               CASE WHEN p.e + i.length > 96 THEN 0 ELSE p.e END, CASE WHEN p.e + i.length > 96 THEN 0 ELSE p.e END + i.length
        FROM p JOIN i ON i.image_id = p.image_id AND i.item = p.item + 1)
  SELECT image_id, item, row_nr, s AS "start", e AS "end" FROM p"""


def _items(v):
    return v.seqs.select(F.col("project_id").alias("image_id"), F.col("frame_idx").alias("item"), "length")


@query("pack", "SELECT * FROM packed")
def pack(v):
    return Q.pack(_items(v), 96)


@query("pack_large", "SELECT * FROM packed")
def pack_large(v):
    return Q.pack(_items(v), 96, small_group=4)


def _values():
    return F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: k * 7 + F.col("frame_idx"))


@query(
    "pack_values",
    """SELECT p.image_id, row_nr, p."start" + k AS slot, CAST(k * 7 + p.item AS INTEGER) AS value
       FROM packed p, range(0, 64) t(k) WHERE k < p."end" - p."start\"""",
)
def pack_values(v):
    values = v.seqs.select(F.col("project_id").alias("image_id"), F.col("frame_idx").alias("item"), _values().alias("values"))
    return Q.pack_values(values, Q.pack(_items(v), 96))


@query(
    "unpack_values",
    """SELECT project_id AS image_id, frame_idx AS item, k AS place, CAST(k * 7 + frame_idx AS INTEGER) AS value
       FROM seqs, range(0, 64) t(k) WHERE k < length""",
)
def unpack_values(v):
    values = v.seqs.select(F.col("project_id").alias("image_id"), F.col("frame_idx").alias("item"), _values().alias("values"))
    packed = Q.pack(_items(v), 96)
    return Q.unpack_values(Q.pack_values(values, packed), packed)


@query(
    "block_mask",
    """SELECT p.image_id, row_nr, p."start" + k AS slot, p."start" AS lo, p."end" AS hi
       FROM packed p, range(0, 64) t(k) WHERE k < p."end" - p."start\"""",
)
def block_mask(v):
    return Q.block_mask(Q.pack(_items(v), 96))


@query(
    "collate",
    """SELECT project_id, frame_idx, list_concat(list_transform(range(0, length), lambda k: CAST(k * 7 + frame_idx AS INTEGER)),
              list_transform(range(0, m - length), lambda k: -100)) AS ids
       FROM (SELECT *, max(length) OVER (PARTITION BY project_id) AS m FROM seqs)""",
)
def collate(v):
    return Q.collate(v.seqs.select("project_id", "frame_idx", _values().alias("ids")), ["ids"], "project_id")


@query(
    "pad_to_bucket",
    """SELECT project_id, frame_idx, list_concat(list_transform(range(0, length), lambda k: CAST(k * 7 + frame_idx AS INTEGER)),
              list_transform(range(0, 64 - length), lambda k: -100)) AS ids FROM seqs""",
)
def pad_to_bucket(v):
    return Q.pad_to_bucket(v.seqs.select("project_id", "frame_idx", _values().alias("ids")), "ids", 64)


@query(
    "pack_pair",
    """SELECT pair_id, part, seg_id, color_id, count(*) OVER (PARTITION BY pair_id) AS attn_length,
              row_number() OVER (PARTITION BY pair_id ORDER BY part, seg_id) - 1 AS slot
       FROM (SELECT *, CASE WHEN side = 'ref' THEN 0 ELSE 1 END AS part FROM feats)""",
)
def pack_pair(v):
    return Q.pack_pair(v.refs, v.tgts)


VIEW_SQL["corpusv"] = r"""
  WITH n AS (SELECT scene // 50 AS corpus, name, regexp_extract(name, '^(lineLayer|colorLayer)[0-9]*_f([0-9]+)_.*\.png$', 1) AS l,
                    TRY_CAST(nullif(regexp_extract(name, '^(lineLayer|colorLayer)[0-9]*_f([0-9]+)_.*\.png$', 2), '') AS INTEGER) AS frame_nr FROM files)
  SELECT corpus, frame_nr, max(name) FILTER (l = 'lineLayer') AS line_name, max(name) FILTER (l = 'colorLayer') AS color_name,
         min(frame_nr) FILTER (max(name) FILTER (l = 'colorLayer') IS NOT NULL) OVER (PARTITION BY corpus) AS ref_nr
  FROM n WHERE frame_nr IS NOT NULL GROUP BY corpus, frame_nr"""


def _corpus(v):
    return v.files.select(F.expr("scene div 50").alias("corpus"), "name")


@query(
    "scan_corpus",
    """SELECT corpus, frame_nr, CASE WHEN frame_nr = ref_nr THEN 'reference' ELSE 'target' END AS role, line_name,
              CASE WHEN frame_nr = ref_nr THEN color_name END AS color_name
       FROM corpusv c WHERE line_name IS NOT NULL AND EXISTS (SELECT 1 FROM corpusv d WHERE d.corpus = c.corpus AND d.frame_nr = d.ref_nr AND d.line_name IS NOT NULL)""",
)
def scan_corpus(v):
    return Q.scan_corpus(_corpus(v))[0]


@query(
    "scan_corpus_at",
    """SELECT corpus, frame_nr, CASE WHEN frame_nr = 5 THEN 'reference' ELSE 'target' END AS role, line_name,
              CASE WHEN frame_nr = 5 THEN color_name END AS color_name
       FROM corpusv c WHERE line_name IS NOT NULL AND EXISTS (SELECT 1 FROM corpusv d
         WHERE d.corpus = c.corpus AND d.frame_nr = 5 AND d.line_name IS NOT NULL AND d.color_name IS NOT NULL)""",
)
def scan_corpus_at(v):
    return Q.scan_corpus(_corpus(v), ref_frame=5)[0]


@query(
    "scan_corpus_errors",
    """SELECT corpus, CASE WHEN min(ref_nr) IS NULL THEN 'NO_COLOR' ELSE 'REFERENCE_WITHOUT_LINE' END AS error FROM corpusv
       GROUP BY corpus HAVING count(*) FILTER (frame_nr = ref_nr AND line_name IS NOT NULL) = 0""",
)
def scan_corpus_errors(v):
    return Q.scan_corpus(_corpus(v))[1]
