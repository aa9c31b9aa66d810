"""Image folders and their pixels."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from flatcel.functions.names import basename, frame_idx
from flatcel.session import cut_lineage
from flatcel.sources.bitmaps import HEAD, plain_layout

# Rows of a batch of listed names.
LISTED_ROWS = 10_000
# Bytes of files that a task decodes, and of those that make a batch of images; tasks for each core at least.
TASK_BYTES, OUT_BYTES, TASKS_PER_CORE = 1 << 26, 1 << 22, 4
# Characters that stand for themselves in an address; others beyond ASCII do if they can be seen.
ADDRESS = frozenset(string.ascii_letters + string.digits + "/;:@&=+$,_-!.~'()*")
# Names that do not end in .bmp, as a glob.
NO_BITMAP = "{?,??,???,*[!pP],*[!mM]?,*[!bB]??,*[!.]???}"


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's store and path of a qualified path."""
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest)}")


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length, millis, is_folder) of what lies right in the folders of the rows."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, root = _opened(folder)
            found = [i for i in store.get_file_info(fs.FileSelector(root)) if not _hidden(i.base_name)]
            for start in range(0, len(found), LISTED_ROWS):
                part = found[start : start + LISTED_ROWS]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in part], pa.string()),
                        "length": pa.array([i.size for i in part], pa.int64()),
                        "millis": pa.array([i.mtime_ns and i.mtime_ns // 1_000_000 for i in part], pa.int64()),
                        "is_folder": pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_()),
                    }
                )


def list_files(spark: SparkSession, folder: str, patterns: list[str]) -> DataFrame:
    """Files below a folder whose names match any glob, each once.

    Tasks list the folders, level by level; the driver never holds the names. That takes a store
    that pyarrow can open (local and shared folders, HDFS, object stores). Others are listed by
    Spark's file source, which does keep all names in the driver."""
    jvm, path = spark._jvm, _qualified(spark, folder)
    regex = "|".join(f"(?:{jvm.org.apache.hadoop.fs.GlobPattern(p).compiled().pattern()})" for p in patterns)
    wanted = basename(F.col("path")).rlike(f"^(?:{regex})$")
    try:
        _opened(path)
    except (pa.ArrowInvalid, OSError):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return found.select("path", "length", "modificationTime").where(wanted)
    tasks, levels = spark.sparkContext.defaultParallelism, []
    open_ = spark.createDataFrame([(path,)], "path string")
    while not levels or not open_.isEmpty():
        listed = open_.repartition(tasks).mapInArrow(_contents, "path string, length long, millis long, is_folder boolean")
        level = cut_lineage(listed)
        open_ = level.where("is_folder").select("path")
        levels.append(level.where(~F.col("is_folder") & wanted))
    return reduce(DataFrame.unionByName, levels).select(
        "path", "length", F.timestamp_millis("millis").alias("modificationTime")
    )


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length, kind) of files: ``plain`` bitmaps, which ``_decoded`` reads as the image source
    does, ``rare`` for what else is called a bitmap, ``other`` names."""
    for batch in batches:
        kinds = []
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not path.lower().endswith(".bmp"):
                kinds.append("other")
                continue
            store, name = _opened(path)
            with store.open_input_file(name) as f:
                kinds.append("plain" if plain_layout(f.read_at(min(HEAD, size), 0), size) else "rare")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string())], names=["path", "length", "kind"])


def _origin(path: str) -> str:
    """A qualified path as the image source writes it, an address."""
    scheme, rest = path.split(":", 1)
    held = "".join(c if c in ADDRESS or (ord(c) > 127 and c.isprintable()) else quote(c, "") for c in rest)
    return f"{scheme}:{held if held.startswith('//') else '//' + held}"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(origin, height, width, nChannels, data) of plain bitmaps, some megabytes at a time."""
    names = ["origin", "height", "width", "nChannels", "data"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows, held = [], 0
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, name = _opened(path)
            with store.open_input_file(name) as f:
                raw = f.read()
            at = plain_layout(raw[:HEAD], size)
            rows.append((_origin(path), at.h, at.w, at.n, at.rows(raw).tobytes()))
            held += size
            if held >= OUT_BYTES:
                yield out(rows)
                rows, held = [], 0
    if rows:
        yield out(rows)


def _image_source(spark: SparkSession, paths: str | list[str], names: str = "*") -> DataFrame:
    """Files whose names match a glob, listed and decoded by Spark's image source."""
    reader = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return reader.load(paths).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def _raw_images(spark: SparkSession, path: str) -> DataFrame:
    path = _qualified(spark, path)
    try:
        _opened(path)
    except (pa.ArrowInvalid, OSError):
        return _image_source(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (store.exists(folder) and store.getFileStatus(folder).isDirectory()):  # a file, a glob or nothing
        return _image_source(spark, path)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    listed = list_files(spark, path, ["*"]).select("path", "length").repartition(tasks)
    found = cut_lineage(listed.mapInArrow(_kinds, "path string, length long, kind string"))
    sums = {r.kind: r.length for r in found.groupBy("kind").agg(F.sum("length").alias("length")).collect()}
    plain = found.where("kind = 'plain'").select("path", "length").repartition(max(tasks, sums.get("plain", 0) // TASK_BYTES))
    parts = [plain.mapInArrow(_decoded, "origin string, height int, width int, nChannels int, data binary")]
    if "rare" in sums:  # a path must not be taken for a glob
        rare = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in found.where("kind = 'rare'").select("path").collect()]
        parts.append(_image_source(spark, rare))
    if "other" in sums:
        parts.append(_image_source(spark, path, NO_BITMAP))
    return reduce(DataFrame.unionByName, parts)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images with their frame number; files that cannot be decoded, or hold
    only zeros, are marked corrupt.

    Plain bitmaps (24 bits a pixel, not packed) are listed and read by tasks, as long as pyarrow
    can open their store; the driver does not hold their names. All other files are left to Spark's
    image source, which takes some milliseconds for any file."""
    raw = _raw_images(spark, path)
    data, height = F.col("data"), F.col("height")
    blank = F.length(F.ltrim(F.hex(data), F.lit("0"))) == 0
    return raw.select(
        F.col("origin").alias("image_id"),
        frame_idx(basename(F.col("origin"))).alias("frame_nr"),
        height.alias("h"),
        F.col("width").alias("w"),
        F.col("nChannels").alias("n_channels"),
        data.alias("data"),
        ((height == -1) | F.coalesce(blank, F.lit(True))).alias("is_corrupt"),
    )


def _unpack(images: DataFrame, channels: dict[int, int]) -> DataFrame:
    """One row per pixel with its bytes c0..c3 in stored order. Byte buffers are
    turned into Arrow columns image by image; nothing is looped over per pixel.
    Strips of images (``strip_h`` rows from row ``y0`` on) are unpacked like images."""
    image_type = images.schema["image_id"].dataType.simpleString()
    schema = f"image_id {image_type}, y int, x int, n int, c0 int, c1 int, c2 int, c3 int"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("image_id")
            for i, (y0, h, w, n, data) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("y0", "h", "w", "n_channels", "data")))
            ):
                if n not in channels:
                    raise ValueError(f"image with {n} channels")
                flat = np.frombuffer(data, dtype=np.uint8).reshape(h * w, n).astype(np.int32)
                place = np.arange(h * w, dtype=np.int32)
                full = np.full((h * w, 4), 255, dtype=np.int32)
                full[:, :n] = flat
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i].as_py()] * (h * w), type=ids.type), pa.array(place // w + np.int32(y0)), pa.array(place % w),
                        pa.array(np.full(h * w, n, dtype=np.int32)), *[pa.array(full[:, k]) for k in range(4)],
                    ],
                    names=["image_id", "y", "x", "n", "c0", "c1", "c2", "c3"],
                )

    rows_of = ("y0", F.col("strip_h").alias("h")) if "strip_h" in images.columns else (F.lit(0).alias("y0"), "h")
    return images.select("image_id", *rows_of, "w", "n_channels", "data").mapInArrow(rows, schema)


def to_pixels(images: DataFrame) -> DataFrame:
    """RGBA pixels; three-channel images get alpha 255, other channel counts are
    errors. Spark stores channels as BGR(A)."""
    return _unpack(images, {3: 3, 4: 4}).select(
        "image_id", "y", "x", F.col("c2").alias("r"), F.col("c1").alias("g"), F.col("c0").alias("b"), F.col("c3").alias("a")
    )


def to_seg_pixels(images: DataFrame) -> DataFrame:
    """Segment labels: one-channel images hold them directly, four-channel ones
    as big-endian RGBA."""
    packed = F.col("c2").cast("bigint") * 16777216 + F.col("c1") * 65536 + F.col("c0") * 256 + F.col("c3")
    return _unpack(images, {1: 1, 4: 4}).select(
        "image_id", "y", "x", F.when(F.col("n") == 1, F.col("c0").cast("bigint")).otherwise(packed).alias("seg_id")
    )
