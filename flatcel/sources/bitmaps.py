"""Folders of uncompressed bitmaps as a data source: read in row strips, written with a commit.

``spark.read.format("bitmaps").load(folder)`` cuts every file into strips of rows of about
``strip_bytes`` each, so that a giant image is read by many tasks and no row of the table holds
more than a strip. ``df.write.format("bitmaps").save(folder)`` writes one file per image. Tasks
write into folders of their own attempt; the commit names the folders that count in one small
file, so a lost executor, a retried task or a failed job leaves nothing that a reader sees.

Paths are those of pyarrow's file systems (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS

STRIP_BYTES = 1 << 20
# Bytes that a task reads at most, if a strip is not larger, and the tasks of less than that each.
TASK_BYTES, TASKS = 1 << 24, 64
READ_SCHEMA = """path string, name string, frame_nr int, h int, w int, n_channels int, y0 int, strip_h int,
    data binary, is_corrupt boolean"""
WRITE_COLUMNS = ("name", "h", "w", "n_channels", "data")

# Fixed values of the file format: magic, size of both headers, 24 and 32 bits a pixel.
_MAGIC, HEAD, _BITS = b"BM", 54, {24: 3, 32: 4}
_COMMITTED = "_committed-"


def _stride(w: int, n: int) -> int:
    """Bytes of a row in a file: rows fill whole words."""
    return (w * n + 3) // 4 * 4


def encode(h: int, w: int, n: int, data: bytes) -> bytes:
    """A bitmap file, top row first, of ``data`` in stored order (blue, green, red, alpha)."""
    if n not in _BITS.values() or len(data) != h * w * n:
        raise ValueError(f"{len(data)} bytes are no image of {h} x {w} x {n}")
    rows = np.zeros((h, _stride(w, n)), dtype=np.uint8)
    rows[:, : w * n] = np.frombuffer(data, dtype=np.uint8).reshape(h, w * n)
    size = rows.size
    head = _MAGIC + struct.pack("<IHHI", HEAD + size, 0, 0, HEAD)
    return head + struct.pack("<IiiHHIIiiII", 40, w, -h, 1, 8 * n, 0, size, 0, 0, 0, 0) + rows.tobytes()


@dataclass(frozen=True)
class Layout:
    offset: int
    w: int
    h: int
    n: int
    top_down: bool

    def rows(self, raw: bytes) -> np.ndarray:
        """The rows of pixels in the bytes of a whole file, top row first."""
        stride = _stride(self.w, self.n)
        rows = np.frombuffer(raw, np.uint8, self.h * stride, self.offset).reshape(self.h, stride)
        return rows[:: 1 if self.top_down else -1, : self.w * self.n]


def layout(head: bytes, size: int) -> Layout | None:
    """Where the pixels of a file of ``size`` bytes are; None if it is no readable bitmap."""
    if len(head) < HEAD or head[:2] != _MAGIC:
        return None
    (offset,) = struct.unpack_from("<I", head, 10)
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", head, 18)
    found = Layout(offset, w, abs(h), _BITS.get(bits, 0), h < 0)
    if packed or not found.n or w <= 0 or h == 0 or size < offset + found.h * _stride(w, found.n):
        return None
    return found


def plain_layout(head: bytes, size: int) -> Layout | None:
    """The layout of a bitmap of the most common kind: short header, 24 bits a pixel, not packed."""
    found = layout(head, size)
    if found is None or found.n != 3 or found.offset < HEAD or struct.unpack_from("<I", head, 14)[0] != HEAD - 14:
        return None
    return found


def frame_number(name: str) -> int | None:
    """Digits, and an optional letter, right before the extension."""
    digits = re.search(r"([0-9]+)[a-zA-Z]?\.[^.]*$", name)
    return int(digits[1]) if digits and int(digits[1]) < 1 << 31 else None


@dataclass
class Pieces(DS.InputPartition):
    """(path, file size, first and last byte of the pixels) of the strips of one task."""

    pieces: list[tuple[str, int, int, int]]


class BitmapReader(DS.DataSourceReader):
    def __init__(self, folder: str, strip_bytes: int):
        self.folder, self.strip_bytes = folder, strip_bytes
        self.tests: list[tuple[str, str, object]] = []

    def _wanted(self, name: str) -> bool:
        holds = {
            "eq": lambda a, b: a == b, "in": lambda a, b: a in b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
            "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
        }
        values = {"name": name, "frame_nr": frame_number(name)}
        return all(values[c] is not None and holds[op](values[c], x) for c, op, x in self.tests)

    def _files(self) -> Iterator[tuple[str, int]]:
        """Files of all commits; those of a folder without commits are all that lie below it."""
        store, root = fs.FileSystem.from_uri(self.folder)
        top = store.get_file_info(fs.FileSelector(root))
        commits = [i.path for i in top if i.base_name.startswith(_COMMITTED)]
        folders = [root]
        if commits:
            folders = []
            for path in commits:
                with store.open_input_stream(path) as f:
                    folders += [f"{root}/{x}" for x in json.loads(f.read())]
        for folder in folders:
            for info in store.get_file_info(fs.FileSelector(folder, recursive=not commits)):
                if info.is_file and info.extension == "bmp":
                    yield info.path, info.size

    def partitions(self):
        # Strips of a large file go to many tasks, small files share one. A task has one strip or a
        # share of all bytes, up to a bound: single strips as tasks would drown in their fixed cost.
        files = sorted(f for f in self._files() if self._wanted(f[0].rsplit("/", 1)[-1]))
        share = max(self.strip_bytes, min(TASK_BYTES, sum(size for _, size in files) // TASKS))
        out, room = [Pieces([])], share
        for path, size in files:
            for start in range(0, max(size - HEAD, 1), self.strip_bytes):
                stop = start + self.strip_bytes
                used = min(size, stop) - start
                if room < used and out[-1].pieces:
                    out.append(Pieces([]))
                    room = share
                out[-1].pieces.append((path, size, start, stop))
                room -= used
        return out

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.folder)
        for path, size, start, stop in partition.pieces:
            with store.open_input_file(path) as f:
                row = self._strip(f, size, start, stop)
            if row is not None:
                name = path.rsplit("/", 1)[-1]
                yield (path, name, frame_number(name), *row)

    @staticmethod
    def _strip(f, size: int, start: int, stop: int):
        """The rows that begin in these bytes of the pixels."""
        at = layout(f.read_at(min(HEAD, size), 0), size)
        if at is None:
            return (None,) * 6 + (True,) if start == 0 else None
        stride = _stride(at.w, at.n)
        first, last = -(-start // stride), min(-(-stop // stride), at.h)
        if first >= last:
            return None
        raw = np.frombuffer(f.read_at((last - first) * stride, at.offset + first * stride), dtype=np.uint8)
        rows = raw.reshape(last - first, stride)[:, : at.w * at.n]
        y0 = first
        if not at.top_down:
            rows, y0 = rows[::-1], at.h - last
        return at.h, at.w, at.n, y0, last - first, rows.tobytes(), False


class ChoosyReader(BitmapReader):
    """Equalities and ranges of ``frame_nr`` and ``name`` choose files before anything is opened.
    Spark takes such a reader only while its filter pushdown for Python sources is on."""

    def pushFilters(self, filters):
        kinds = {
            DS.EqualTo: "eq", DS.In: "in", DS.GreaterThan: "gt", DS.GreaterThanOrEqual: "ge",
            DS.LessThan: "lt", DS.LessThanOrEqual: "le",
        }
        for f in filters:
            if type(f) in kinds and f.attribute in (("frame_nr",), ("name",)):
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f


@dataclass
class Written(DS.WriterCommitMessage):
    folder: str


class BitmapWriter(DS.DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.job = f"job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.folder)
        context = TaskContext.get()
        part = f"{self.job}/part-{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{part}", recursive=True)
        for batch in batches:
            columns = [batch.column(c) for c in WRITE_COLUMNS]
            for i in range(batch.num_rows):
                name, h, w, n, data = (c[i].as_py() for c in columns)
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"no file can have the name {name!r}")
                with store.open_output_stream(f"{root}/{part}/{name}.bmp") as f:
                    f.write(encode(h, w, n, data))
        return Written(part)

    def commit(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        before = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(_COMMITTED)]
        kept = sorted(m.folder for m in messages if m is not None)
        with store.open_output_stream(f"{root}/{_COMMITTED}{self.job}") as f:
            f.write(json.dumps(kept).encode())
        if self.overwrite:
            for path in before:
                store.delete_file(path)

    def abort(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class Bitmaps(DS.DataSource):
    """Options: ``path``; for reading ``strip_bytes`` and ``pushdown`` (true or false). Writes take the columns name, h, w,
    n_channels, data (others are not looked at); names should be unique, equal ones are all kept."""

    @classmethod
    def name(cls) -> str:
        return "bitmaps"

    def schema(self) -> str:
        return READ_SCHEMA

    def _folder(self) -> str:
        path = self.options["path"]
        return path if ":/" in path else f"file://{path}"

    def reader(self, schema) -> BitmapReader:
        kind = ChoosyReader if self.options.get("pushdown") == "true" else BitmapReader
        return kind(self._folder(), int(self.options.get("strip_bytes", STRIP_BYTES)))

    def writer(self, schema, overwrite: bool) -> BitmapWriter:
        missing = set(WRITE_COLUMNS) - set(schema.fieldNames())
        if missing:
            raise ValueError(f"images lack the columns {sorted(missing)}")
        return BitmapWriter(self._folder(), overwrite)


def write_bitmaps(images: DataFrame, folder: str, overwrite: bool = False) -> None:
    """One file per image, visible to ``read_strips`` all at once."""
    images.sparkSession.dataSource.register(Bitmaps)
    images.select(*WRITE_COLUMNS).write.format("bitmaps").mode("overwrite" if overwrite else "append").save(folder)


def read_strips(spark: SparkSession, folder: str, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Strips of the images of a folder. A file that is no bitmap is one row marked corrupt.

    If ``spark.sql.python.filterPushdown.enabled`` is true (and stays so until the table is read),
    filters on frame_nr and name choose the files."""
    spark.dataSource.register(Bitmaps)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("bitmaps").options(strip_bytes=strip_bytes, pushdown=pushdown).load(folder)
