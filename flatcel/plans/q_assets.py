"""Queries: image store, caches, model files, file names, imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatcel.functions import names as N
from flatcel.operators import assets as A
from flatcel.plans.adapters import VIEW_SQL
from flatcel.plans.registry import query

VIEW_SQL["oldimages"] = """
  SELECT 'old_' || d.doc_id AS image_id, md5(text) AS hash, CAST(d.doc_id % 4 AS BIGINT) AS reference_count, true AS has_bytes
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1"""
VIEW_SQL["owned"] = """
  SELECT i.seq, i.hash, CASE WHEN i.lang = 'es' THEN i.image_id
         ELSE coalesce(o.image_id, first_value(i.image_id) OVER (PARTITION BY i.hash ORDER BY i.seq)) END AS image_id
  FROM images i LEFT JOIN (SELECT hash, min(image_id) AS image_id FROM oldimages GROUP BY hash) o ON o.hash = i.hash"""
VIEW_SQL["disk"] = """
  SELECT s_name AS file, CASE WHEN s_nationkey % 6 = 1 THEN 1 ELSE CAST(floor(s_acctbal) AS BIGINT) END AS size,
         CAST(s_suppkey * 1000 AS BIGINT) AS mtime_ms, s_nationkey = 3 AS is_symlink, s_nationkey = 5 AS is_directory
  FROM supplier WHERE s_nationkey <> 7
  UNION ALL SELECT CASE WHEN n_regionkey = 1 THEN '.' ELSE '' END || n_name || '.part', 10, 0, n_regionkey = 2, n_regionkey = 3 FROM nation"""
VIEW_SQL["manifest"] = """
  SELECT s_name AS file, CAST(floor(s_acctbal) AS BIGINT) AS bytes, md5(s_name) AS sha256,
         CASE WHEN s_nationkey % 2 = 0 THEN 'mac' ELSE 'win' END AS platform FROM supplier"""


def old_images(v):
    labels = v.table("labels").where("quality = 1").select("doc_id")
    return v.table("documents").join(labels, "doc_id").select(
        F.concat(F.lit("old_"), F.col("doc_id").cast("string")).alias("image_id"),
        F.md5("text").alias("hash"),
        (F.col("doc_id") % 4).cast("bigint").alias("reference_count"),
        F.lit(True).alias("has_bytes"),
    )


def incoming(v):
    return v.images.select("seq", "image_id", "content", (F.col("lang") == "es").alias("force_new"))


@query("store_images", "SELECT seq, image_id FROM owned")
def store_images(v):
    return A.store_images(incoming(v), old_images(v))[0]


@query(
    "store_images_records",
    """SELECT u.image_id, coalesce(o.hash, u.hash) AS hash, CAST(coalesce(o.reference_count, 0) + u.n AS BIGINT) AS reference_count
       FROM (SELECT image_id, min(hash) AS hash, count(*) AS n FROM owned GROUP BY image_id) u LEFT JOIN oldimages o USING (image_id)""",
)
def store_images_records(v):
    return A.store_images(incoming(v), old_images(v))[1]


@query(
    "release_images",
    """SELECT image_id, CASE WHEN NOT gone THEN hash END AS hash,
              greatest(reference_count - n, least(reference_count, 1)) AS reference_count, has_bytes AND NOT gone AS has_bytes
       FROM (SELECT o.*, coalesce(r.n, 0) AS n, coalesce(r.n, 0) > 0 AND r.n >= greatest(reference_count, 1) AS gone
             FROM oldimages o LEFT JOIN (SELECT 'old_' || conv_id AS image_id, count(*) AS n FROM conversations GROUP BY 1) r USING (image_id))""",
)
def release_images(v):
    releases = v.table("conversations").selectExpr(
        "concat('old_', cast(conv_id as string)) as image_id"
    )
    return A.release_images(old_images(v), releases)


@query(
    "resolve_assets",
    """SELECT d.image_id, CASE WHEN m.kept THEN m.content WHEN m.hash = md5(k.disk_content) THEN k.disk_content END AS bytes,
              CASE WHEN m.kept THEN 'memory' WHEN m.hash = md5(k.disk_content) THEN 'disk'
                   WHEN m.image_id IS NOT NULL THEN 'evicted-no-disk-copy' ELSE 'never-existed' END AS source
       FROM images d
       LEFT JOIN (SELECT image_id, hash, content, lang = 'en' AS kept FROM images WHERE lang <> 'fr') m ON m.image_id = d.image_id
       LEFT JOIN (SELECT image_id, CASE WHEN lang = 'de' AND n_chars % 2 = 0 THEN content || '!' ELSE content END AS disk_content
                  FROM images WHERE n_chars % 3 <> 0) k ON k.image_id = d.image_id""",
)
def resolve_assets(v):
    i = v.images
    records = i.where("lang <> 'fr'").select(
        "image_id", F.when(F.col("lang") == "en", F.col("content")).alias("content"), "hash"
    )
    disk = i.where("n_chars % 3 <> 0").select(
        "image_id",
        F.when((F.col("lang") == "de") & (F.col("n_chars") % 2 == 0), F.concat("content", F.lit("!")))
        .otherwise(F.col("content"))
        .alias("disk_content"),
    )
    return A.resolve_assets(i.select("image_id"), records, disk)


KEY = """hash || '_line_threshold_' || CASE WHEN lang = 'en' THEN 'auto' ELSE CAST(n_chars % 250 AS VARCHAR) END ||
   '_tbDilate_' || CASE WHEN n_chars % 120 < 10 THEN '0' ELSE '' END || CAST(n_chars % 120 AS VARCHAR) ||
   '_aiDilate_' || CASE WHEN n_chars % 7 < 10 THEN '0' ELSE '' END || CAST(n_chars % 7 AS VARCHAR) || '_minSegSize_' || CAST(n_chars % 30 AS VARCHAR) || '.png'"""


def _keys(v):
    n = F.col("n_chars")
    return v.images.select(
        "image_id",
        "source",
        N.seg_cache_key(F.col("hash"), n % 250, F.col("lang") == "en", n % 120, n % 7, n % 30).alias("cache_key"),
    )


@query("seg_cache_key", f"SELECT image_id, 'segMap_' || {KEY} AS cache_key FROM images")
def seg_cache_key(v):
    return _keys(v).select("image_id", "cache_key")


@query(
    "missing_segmaps",
    f"""SELECT DISTINCT 'segMap_' || {KEY} AS cache_key FROM images
        EXCEPT SELECT 'segMap_' || {KEY} FROM images WHERE source IN ('src1', 'src3', 'src5', 'src7', 'src9')""",
)
def missing_segmaps(v):
    keys = _keys(v)
    return A.missing_segmaps(keys, keys.where(F.col("source").isin("src1", "src3", "src5", "src7", "src9")))


def manifest(v):
    return v.table("supplier").select(
        F.col("s_name").alias("file"),
        F.floor("s_acctbal").alias("bytes"),
        F.md5("s_name").alias("sha256"),
        F.when(F.col("s_nationkey") % 2 == 0, "mac").otherwise("win").alias("platform"),
    )


def disk(v):
    nation = F.col("s_nationkey")
    stored = v.table("supplier").where(nation != 7).select(
        F.col("s_name").alias("file"),
        F.when(nation % 6 == 1, F.lit(1)).otherwise(F.floor("s_acctbal")).cast("bigint").alias("size"),
        (F.col("s_suppkey") * 1000).cast("bigint").alias("mtime_ms"),
        (nation == 3).alias("is_symlink"),
        (nation == 5).alias("is_directory"),
    )
    region = F.col("n_regionkey")
    junk = v.table("nation").select(
        F.concat(F.when(region == 1, F.lit(".")).otherwise(F.lit("")), F.col("n_name"), F.lit(".part")).alias("file"),
        F.lit(10).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime_ms"),
        (region == 2).alias("is_symlink"),
        (region == 3).alias("is_directory"),
    )
    return stored.unionByName(junk)


@query(
    "plan_downloads",
    """SELECT m.* FROM manifest m LEFT JOIN disk d ON d.file = m.file AND d.size = m.bytes
       WHERE m.platform = 'win' AND d.file IS NULL""",
)
def plan_downloads(v):
    return A.plan_downloads(manifest(v), disk(v), "win").select("file", "bytes", "sha256", "platform")


@query(
    "plan_quarantine",
    """SELECT d.file FROM disk d LEFT JOIN manifest m ON m.file = d.file
       WHERE NOT d.is_directory AND NOT starts_with(d.file, '.') AND (m.file IS NULL OR (NOT d.is_symlink AND d.size <> m.bytes))""",
)
def plan_quarantine(v):
    return A.plan_quarantine(disk(v), manifest(v))


@query(
    "need_verification",
    """SELECT d.file, d.size, d.mtime_ms, m.sha256 FROM disk d JOIN manifest m ON m.file = d.file AND m.bytes = d.size
       LEFT JOIN (SELECT s_name AS file, CAST(floor(s_acctbal) AS BIGINT) AS size, s_suppkey * 1000 AS mtime_ms FROM supplier WHERE s_nationkey BETWEEN 10 AND 15) k
         ON k.file = d.file AND k.size = d.size AND k.mtime_ms = d.mtime_ms
       WHERE NOT d.is_symlink AND k.file IS NULL""",
)
def need_verification(v):
    memo = v.table("supplier").where("s_nationkey between 10 and 15").select(
        F.col("s_name").alias("file"), F.floor("s_acctbal").alias("size"),
        (F.col("s_suppkey") * 1000).cast("bigint").alias("mtime_ms"),
    )
    return A.need_verification(disk(v), manifest(v), memo)


@query(
    "manifest_hash",
    "SELECT platform, string_agg(file || ':' || sha256, '|' ORDER BY file || ':' || sha256) AS fingerprint FROM manifest GROUP BY platform",
)
def manifest_hash(v):
    return A.manifest_hash(manifest(v))


# A file per order, sets by order status.
VIEW_SQL["shipped"] = """
  SELECT 'order_' || o_orderkey || '.bin' AS file, md5(o_orderpriority || o_orderkey) AS sha256, o_orderstatus AS platform, o_orderkey % 900 AS bytes FROM orders"""


def shipped(v):
    return v.table("orders").selectExpr(
        "concat('order_', o_orderkey, '.bin') as file", "md5(concat(o_orderpriority, o_orderkey)) as sha256",
        "o_orderstatus as platform", "o_orderkey % 900 as bytes",
    )


# Leaves as deep as the set needs, then one level of parents after the other.
TREE = """e AS (SELECT platform, sha256(file) AS name, sha256(file || ':' || sha256) AS entry, count(*) AS copies FROM {files} GROUP BY ALL),
       g AS (SELECT *, {depth} AS depth FROM (SELECT *, (count(*) OVER (PARTITION BY platform) - 1) // 16 AS above FROM e)),
       l AS (SELECT platform, left(name, depth) AS prefix, depth, CAST(sum(copies) AS BIGINT) AS files,
                    sha256(string_agg(entry || ':' || copies, ',' ORDER BY entry || ':' || copies)) AS digest FROM g GROUP BY ALL),
       n6 AS (SELECT platform, prefix, files, digest FROM l WHERE depth >= 6),
       """ + ",\n       ".join(
    f"""n{d} AS (SELECT platform, prefix, files, digest FROM l WHERE depth = {d} UNION ALL
               SELECT platform, left(prefix, {d}), CAST(sum(files) AS BIGINT), sha256(string_agg(right(prefix, 1) || digest, ',' ORDER BY prefix)) FROM n{d + 1} GROUP BY ALL)"""
    for d in range(5, -1, -1)
)


@query(
    "manifest_tree",
    "WITH " + TREE.format(files="shipped", depth="CASE WHEN above > 0 THEN len(format('{:x}', above)) ELSE 0 END")
    + " SELECT * FROM (" + " UNION ALL ".join(f"FROM n{d}" for d in range(7)) + ")",
)
def manifest_tree(v):
    return A.manifest_tree(shipped(v))


@query(
    "manifest_changes",
    """WITH a AS (SELECT platform, left(sha256(file), 3) AS prefix, list_sort(list(file || sha256)) AS x FROM shipped GROUP BY ALL),
            b AS (SELECT platform, left(sha256(file), 3) AS prefix, list_sort(list(file || CASE WHEN bytes % 290 = 3 THEN sha256 || 'x' ELSE sha256 END)) AS x
                  FROM shipped WHERE bytes % 310 <> 5 GROUP BY ALL)
       SELECT platform, prefix FROM a FULL JOIN b USING (platform, prefix) WHERE a.x IS DISTINCT FROM b.x""",
)
def manifest_changes(v):
    new = shipped(v).where("bytes % 310 <> 5").withColumn("sha256", F.expr("if(bytes % 290 = 3, sha256 || 'x', sha256)"))
    return A.changed_ranges(A.manifest_tree(shipped(v), depth=3), A.manifest_tree(new, depth=3))


@query(
    "frame_numbers",
    r"""SELECT seq, name, TRY_CAST(nullif(regexp_extract(name, '([0-9]+)[a-zA-Z]?\.png', 1), '') AS INTEGER) AS frame_idx,
               nr AS timeline_nr, CASE WHEN nr IS NULL THEN 'MISSING' WHEN nr > 1000 THEN 'TOO_HIGH' ELSE 'OK' END AS verdict
        FROM (SELECT seq, name, TRY_CAST(nullif(regexp_extract(regexp_replace(name, '\.[^.]*$', ''), '([0-9]+)$', 1), '') AS INTEGER) + 1 AS nr FROM files)""",
)
def frame_numbers(v):
    nr = N.timeline_frame_nr(F.col("name"))
    return v.files.select(
        "seq", "name", N.frame_idx(F.col("name")).alias("frame_idx"), nr.alias("timeline_nr"),
        N.frame_verdict(nr).alias("verdict"),
    )


@query(
    "importable",
    "SELECT seq, name FROM files WHERE lower(regexp_extract(name, '[^.]*$')) = 'png' ORDER BY upper(name), seq",
)
def importable(v):
    return A.importable(v.files).select("seq", "name")


@query(
    "is_too_old",
    """SELECT p_partkey, version, (maj, mi, pa) < (0, 3, 0) OR ((maj, mi, pa) = (0, 3, 0) AND version LIKE '%-%') AS too_old FROM (
         SELECT p_partkey, CAST(p_size % 2 AS INTEGER) AS maj, CAST(p_size % 5 AS INTEGER) AS mi, CAST(p_partkey % 11 AS INTEGER) AS pa,
                (p_size % 2) || '.' || (p_size % 5) || '.' || (p_partkey % 11) || CASE WHEN p_type = 'PROMO' THEN '-beta.1' ELSE '' END AS version FROM part)""",
)
def is_too_old(v):
    version = F.expr(
        "concat(p_size % 2, '.', p_size % 5, '.', p_partkey % 11, if(p_type = 'PROMO', '-beta.1', ''))"
    )
    return v.table("part").select("p_partkey", version.alias("version")).withColumn(
        "too_old", N.is_too_old(F.col("version"))
    )


@query(
    "dimension_mismatch",
    """SELECT o_orderkey AS image_id, o_custkey AS project_id, CASE WHEN o_orderstatus = 'P' THEN 512 ELSE 1024 END AS w, 384 AS h
       FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE (CASE WHEN o_orderstatus = 'P' THEN 512 ELSE 1024 END) <> (CASE WHEN c_mktsegment = 'BUILDING' THEN 512 ELSE 1024 END)""",
)
def dimension_mismatch(v):
    images = v.table("orders").selectExpr(
        "o_orderkey as image_id", "o_custkey as project_id", "if(o_orderstatus = 'P', 512, 1024) as w", "384 as h"
    )
    canvas = v.table("customer").selectExpr(
        "c_custkey as project_id", "if(c_mktsegment = 'BUILDING', 512, 1024) as canvas_w", "384 as canvas_h"
    )
    return A.dimension_mismatch(images, canvas)


VIEW_SQL["imports"] = r"""
  WITH f AS (SELECT scene AS project_id, seq, name, CASE WHEN size > 490000 THEN 512 ELSE 1024 END AS w, 384 AS h, size > 5000 AS has_transparent,
                    TRY_CAST(nullif(regexp_extract(regexp_replace(name, '\.[^.]*$', ''), '([0-9]+)$', 1), '') AS INTEGER) + 1 AS frame_nr
             FROM files),
  s AS (SELECT f.*, coalesce(c.w, first_value(f.w) OVER (PARTITION BY f.project_id ORDER BY seq)) AS cw
        FROM f LEFT JOIN (SELECT c_custkey AS project_id, 1024 AS w FROM customer WHERE c_mktsegment = 'BUILDING') c USING (project_id)),
  j AS (SELECT *, CASE WHEN NOT has_transparent THEN 'NO_ALPHA' WHEN w <> cw THEN 'DIMENSIONS'
                       WHEN frame_nr IS NULL THEN 'MISSING' WHEN frame_nr > 1000 THEN 'TOO_HIGH' ELSE 'OK' END AS verdict FROM s)
  SELECT project_id, seq, name, frame_nr, verdict FROM (
    SELECT *, min(CASE WHEN verdict <> 'OK' THEN seq END) OVER (PARTITION BY project_id) AS stop FROM j)
  WHERE stop IS NULL OR seq <= stop"""


@query("import_frames", "SELECT * FROM imports")
def import_frames(v):
    files = v.files.selectExpr(
        "scene as project_id", "seq", "name", "if(size > 490000, 512, 1024) as w", "384 as h",
        "size > 5000 as has_transparent",
    )
    canvas = v.table("customer").where("c_mktsegment = 'BUILDING'").selectExpr(
        "c_custkey as project_id", "1024 as canvas_w", "384 as canvas_h"
    )
    return A.import_frames(files, canvas)
