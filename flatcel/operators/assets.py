"""Image store, caches and model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flatcel.functions.names import extension, frame_verdict, timeline_frame_nr, IMAGE_EXTENSIONS
from flatcel.operators.skew import join_lookup, join_unique, with_group_facts
from flatcel.session import cut_lineage

# Files per leaf of a manifest tree; a node has sixteen children.
LEAF_FILES = 16


def store_images(incoming: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content-addressed store.

    ``incoming``: seq, image_id (used if a record must be made), content,
    force_new. ``existing``: image_id, hash, reference_count. An image whose
    bytes are known joins the known record; of new bytes the first image makes
    the record; ``force_new`` always makes one. Returns (seq -> image_id,
    changed and new records). Only hashes travel, never the bytes; copies of one
    image may be a third of the input, hence the hot-key split in the join back.
    """
    hashed = incoming.select("seq", "image_id", F.md5("content").alias("hash"), "force_new")
    known = existing.where("hash is not null").groupBy("hash").agg(F.min("image_id").alias("__known"))
    copies = hashed.groupBy("hash").agg(F.min_by("image_id", "seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    owner = copies.join(known, "hash", "left").select("hash", F.coalesce("__known", "__first").alias("__owner"), "__n")
    owned = join_unique(hashed, owner, ["hash"], "__n").withColumn(
        "owner", F.when(F.col("force_new"), F.col("image_id")).otherwise(F.col("__owner"))
    )
    assigned = owned.select("seq", F.col("owner").alias("image_id"))
    uses = owned.groupBy(F.col("owner").alias("image_id")).agg(
        F.count(F.lit(1)).alias("__uses"), F.first("hash").alias("__hash")
    )
    records = uses.join(existing, "image_id", "left").select(
        "image_id",
        F.coalesce("hash", "__hash").alias("hash"),
        (F.coalesce(F.col("reference_count"), F.lit(0)) + F.col("__uses")).cast("bigint").alias("reference_count"),
    )
    return assigned, records


def release_images(images: DataFrame, releases: DataFrame) -> DataFrame:
    """Give back uses (``releases``: image_id, one row per use). The last use
    drops bytes and hash, earlier ones lower the count. ``images``: image_id,
    hash, reference_count, has_bytes."""
    given = releases.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n"))
    n, count = F.coalesce("__n", F.lit(0)), F.col("reference_count")
    gone = (n > 0) & (n >= F.greatest(count, F.lit(1)))
    return images.join(given, "image_id", "left").select(
        "image_id",
        F.when(~gone, F.col("hash")).alias("hash"),
        F.greatest(count - n, F.least(count, F.lit(1))).alias("reference_count"),
        (F.col("has_bytes") & ~gone).alias("has_bytes"),
    )


def resolve_assets(ids: DataFrame, images: DataFrame, disk: DataFrame) -> DataFrame:
    """Bytes of each image: from the record, else from disk if they still hash
    to the record's hash, else the reason of the miss. ``images``: image_id,
    content, hash; ``disk``: image_id, disk_content."""
    records = images.select("image_id", "content", "hash", F.lit(True).alias("__record"))
    valid = F.md5("disk_content") == F.col("hash")
    found = ids.join(records, "image_id", "left").join(disk, "image_id", "left")
    return found.select(
        "image_id",
        F.coalesce(F.nullif(F.col("content"), F.lit("")), F.when(valid, F.col("disk_content"))).alias("bytes"),
        F.when(F.nullif(F.col("content"), F.lit("")).isNotNull(), "memory")
        .when(valid, "disk")
        .when(F.col("__record"), "evicted-no-disk-copy")
        .otherwise("never-existed")
        .alias("source"),
    )


def missing_segmaps(needed: DataFrame, cache: DataFrame) -> DataFrame:
    """Needed cache keys without a stored segmentation (one row per key)."""
    return needed.select("cache_key").distinct().join(cache.select("cache_key"), "cache_key", "left_anti")


def plan_downloads(manifest: DataFrame, disk: DataFrame, platform: str) -> DataFrame:
    """Wanted files that are missing or have another size on disk."""
    wanted = manifest.where(F.col("platform") == platform)
    present = disk.select("file", F.col("size").alias("bytes"))
    return wanted.join(present, ["file", "bytes"], "left_anti")


def plan_quarantine(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files to move away: unknown ones and wrong sizes, but never folders, dot
    files, or symlinks standing in for a known file."""
    known = manifest.select("file", F.col("bytes").alias("__want"))
    rows = disk.where(~F.col("is_directory") & ~F.startswith(F.col("file"), F.lit("."))).join(known, "file", "left")
    unknown = F.col("__want").isNull()
    return rows.where(unknown | (~F.col("is_symlink") & (F.col("size") != F.col("__want")))).select("file")


def need_verification(disk: DataFrame, manifest: DataFrame, memo: DataFrame) -> DataFrame:
    """Files of the right size whose checksum is not remembered for the same
    size and time (symlinks are trusted)."""
    sized = disk.where(~F.col("is_symlink")).join(
        manifest.select("file", F.col("bytes").alias("size"), "sha256"), ["file", "size"]
    )
    return sized.join(memo, ["file", "size", "mtime_ms"], "left_anti").select("file", "size", "mtime_ms", "sha256")


def manifest_hash(manifest: DataFrame, key: str = "platform") -> DataFrame:
    """Order-free fingerprint of a file set. The result is one text cell per
    set, so it serves sets that fit a cell; ``manifest_tree`` has no such bound."""
    entry = F.concat_ws(":", "file", "sha256")
    return manifest.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(entry)), "|").alias("fingerprint"))


def manifest_tree(manifest: DataFrame, key: str = "platform", depth: int | None = None) -> DataFrame:
    """A hash tree over each file set: (key, prefix, files, digest), the root having the prefix "".

    Files are dealt to leaves by the first digits of their hashed names, so a leaf holds some
    ``LEAF_FILES`` of them at any size of the set; a node's digest is that of its up to sixteen
    children. Order and placement of the rows do not matter, equal rows count as one entry with its
    number, nulls count as empty text. ``depth`` (digits of a leaf's prefix) follows the number of
    entries of a set unless given; sets to be compared should be built with the same.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    entries = manifest.groupBy(
        F.col(key), F.sha2(text("file"), 256).alias("__name"), F.sha2(F.concat_ws(":", text("file"), text("sha256")), 256).alias("__entry")
    ).agg(F.count(F.lit(1)).alias("__copies"))
    if depth is None:
        crowd = with_group_facts(entries, [key], {"__entries": F.count(F.lit(1))})
        above = F.expr(f"(__entries - 1) div {LEAF_FILES}")
        crowd = crowd.withColumn("__depth", F.when(above > 0, F.length(F.hex(above))).otherwise(0))
    else:
        crowd = entries.withColumn("__depth", F.lit(depth))
    leaves = cut_lineage(
        crowd.groupBy(key, F.expr("substring(__name, 1, __depth)").alias("prefix")).agg(
            F.sum("__copies").alias("files"),
            # Names are hashes: a leaf's entries are as few as the depth makes them.
            F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "__entry", "__copies"))), ","), 256).alias("digest"),
        )
    )
    level = leaves.agg(F.max(F.length("prefix"))).first()[0] or 0
    nodes = leaves
    children = leaves.where(F.length("prefix") == level)
    for d in range(level - 1, -1, -1):
        child = F.struct(F.col("prefix"), F.concat(F.substring("prefix", -1, 1), "digest").alias("line"))
        parents = children.groupBy(key, F.substring("prefix", 1, d).alias("__p")).agg(
            F.sum("files").alias("files"), F.sha2(F.array_join(F.sort_array(F.collect_list(child))["line"], ","), 256).alias("digest")
        ).withColumnRenamed("__p", "prefix")
        nodes = nodes.unionByName(parents)
        children = parents.unionByName(leaves.where(F.length("prefix") == d))
    return nodes.select(key, "prefix", "files", "digest")


def changed_ranges(before: DataFrame, after: DataFrame, key: str = "platform") -> DataFrame:
    """The deepest nodes of two trees of one depth that differ: (key, prefix). Only the files whose
    hashed names begin with such a prefix need to be compared; equal sets give no row."""
    a, b = (t.select(key, "prefix", F.col("digest").alias(n)) for t, n in ((before, "__a"), (after, "__b")))
    same = a[key].eqNullSafe(b[key]) & (a["prefix"] == b["prefix"])
    unlike = a.join(b, same, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(
        F.coalesce(a["prefix"], b["prefix"]).alias("prefix"), F.when(a["prefix"].isNull(), b[key]).otherwise(a[key]).alias(key)
    )
    depth = before.unionByName(after).groupBy(key).agg(F.max(F.length("prefix")).alias("__depth"))
    return join_lookup(unlike, depth, [key], "inner", null_safe=True).where(F.length("prefix") == F.col("__depth")).select(key, "prefix")


def importable(files: DataFrame) -> DataFrame:
    """Readable image files in name order, ignoring case."""
    return files.where(extension(F.col("name")).isin(*IMAGE_EXTENSIONS)).orderBy(F.upper("name"), "seq")


def dimension_mismatch(images: DataFrame, canvas: DataFrame) -> DataFrame:
    """Images that do not fit the canvas of their project."""
    return join_lookup(images, canvas, ["project_id"], "inner").where(
        (F.col("w") != F.col("canvas_w")) | (F.col("h") != F.col("canvas_h"))
    ).select(*images.columns)


def import_frames(files: DataFrame, canvas: DataFrame) -> DataFrame:
    """Which files of an import enter the timeline, and why it stops.

    ``files``: project_id, seq, name, w, h, has_transparent; ``canvas``: sizes
    of projects that already have frames. A project without canvas takes the
    size of its first file. The import ends at the first bad file, so a file is
    kept iff it precedes the first bad one of its project.
    """
    nr = timeline_frame_nr(F.col("name"))
    first = files.groupBy("project_id").agg(
        F.min_by(F.struct("w", "h"), "seq").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    sizes = first.join(canvas, "project_id", "left").select(
        "project_id",
        "__n",
        F.coalesce("canvas_w", F.col("__first.w")).alias("__w"),
        F.coalesce("canvas_h", F.col("__first.h")).alias("__h"),
    )
    judged = (
        join_unique(files, sizes, ["project_id"], "__n").drop("__n")
        .withColumn("frame_nr", nr)
        .withColumn(
            "verdict",
            F.when(~F.col("has_transparent"), "NO_ALPHA")
            .when((F.col("w") != F.col("__w")) | (F.col("h") != F.col("__h")), "DIMENSIONS")
            .otherwise(frame_verdict(F.col("frame_nr"))),
        )
    )
    stop = F.min(F.when(F.col("verdict") != "OK", F.col("seq")))
    return (
        with_group_facts(judged, ["project_id"], {"__stop": stop})
        .where("__stop is null or seq <= __stop")
        .select("project_id", "seq", "name", "frame_nr", "verdict")
    )
