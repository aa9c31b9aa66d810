"""Image folders and project files on disk, and the micro-batch import."""

from __future__ import annotations

import random
import struct
import zlib

import pytest
from flatcel.functions.color import dense_to_rgba, label_to_rgba
from flatcel.sources import bitmaps as B
from flatcel.sources import images as I
from flatcel.sources import projects as P
from flatcel.streaming.imports import store_batches
from pyspark.sql import functions as F


def png(path, rows, kind):
    """Write an 8-bit PNG; kind 0 grey, 2 RGB, 6 RGBA."""
    def part(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    width = len(rows[0]) // {0: 1, 2: 3, 6: 4}[kind]
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "a_007A.png", [[255, 0, 0, 255, 1, 2, 3, 4]], 6)
    png(tmp_path / "b_008.png", [[9, 8, 7, 6, 5, 4]], 2)
    png(tmp_path / "zero_009.png", [[0, 0, 0]], 2)
    (tmp_path / "junk_010.png").write_bytes(b"nothing")
    found = I.read_images(spark, str(tmp_path)).cache()
    facts = {r.frame_nr: (r.h, r.w, r.n_channels, r.is_corrupt) for r in found.collect()}
    assert facts[7] == (1, 2, 4, False) and facts[8] == (1, 2, 3, False)
    assert facts[9][3] and facts[10][3]
    good = I.to_pixels(found.where("not is_corrupt")).select("y", "x", "r", "g", "b", "a")
    assert sorted(map(tuple, good.collect())) == sorted([(0, 0, 255, 0, 0, 255), (0, 1, 1, 2, 3, 4), (0, 0, 9, 8, 7, 255), (0, 1, 6, 5, 4, 255)])
    assert {r.seg_id for r in I.to_seg_pixels(found.where("n_channels = 4")).collect()} == {0xFF0000FF, 0x01020304}
    assert I.list_files(spark, str(tmp_path), ["a_*.png", "*07A.png", "b*"]).count() == 2


def bitmaps(spark, sizes, names=None):
    rows = []
    for k, (h, w, n) in enumerate(sizes):
        data = bytearray((7 * i + k) % 251 for i in range(h * w * n))
        rows.append(((names or {}).get(k, f"f_{k:03d}"), h, w, n, data, "extra"))
    return spark.createDataFrame(rows, "name string, h int, w int, n_channels int, data binary, path string")


def whole(strips):
    """Images put together from their strips, which must neither overlap nor leave gaps."""
    out = {}
    for r in sorted(strips.collect(), key=lambda r: (r.path, r.y0)):
        got = out.setdefault(r.name, [r.h, r.w, r.n_channels, 0, b""])
        assert got[3] == r.y0 and len(r.data) == r.strip_h * r.w * r.n_channels
        got[3] += r.strip_h
        got[4] += bytes(r.data)
    return {k: (h, w, n, data) for k, (h, w, n, rows, data) in out.items() if rows == h}


def test_bitmap_strips(spark, tmp_path):
    sizes = [(1, 1, 3), (40, 5, 3), (300, 7, 4), (3, 400, 3), (1, 3, 4)]
    images = bitmaps(spark, sizes).repartition(3)
    folder = str(tmp_path / "frames")
    B.write_bitmaps(images, folder)
    want = {r["name"] + ".bmp": (r.h, r.w, r.n_channels, bytes(r.data)) for r in images.collect()}
    for strip_bytes in (100, 1000, 1 << 20):  # also strips shorter than a row
        assert whole(B.read_strips(spark, folder, strip_bytes)) == want
    assert B.read_strips(spark, folder, 1000).where("h = 300").count() > 5
    pixels = I.to_pixels(B.read_strips(spark, folder, 500).where("not is_corrupt").withColumn("image_id", F.col("name")))
    plain = I.to_pixels(images.withColumn("image_id", F.concat("name", F.lit(".bmp"))))
    assert pixels.exceptAll(plain).count() == plain.exceptAll(pixels).count() == 0
    # Spark's own image source reads the same files.
    own = {r.image_id.rsplit("/", 1)[-1]: bytes(r.data) for r in I.read_images(spark, folder).where("n_channels = 3").collect()}
    assert own["f_003.bmp"] == want["f_003.bmp"][3]


def test_bitmap_commits(spark, tmp_path):
    folder = str(tmp_path / "frames")
    names = lambda: sorted(r.name for r in B.read_strips(spark, folder).collect())
    B.write_bitmaps(bitmaps(spark, [(2, 2, 3)] * 3), folder)
    B.write_bitmaps(bitmaps(spark, [(2, 2, 3)], {0: "later"}), folder)
    assert names() == ["f_000.bmp", "f_001.bmp", "f_002.bmp", "later.bmp"]
    # A failed job and a task that wrote before it was lost leave nothing to see.
    with pytest.raises(Exception, match="no file can have the name"):
        B.write_bitmaps(bitmaps(spark, [(2, 2, 3)] * 2, {0: "good", 1: "a/b"}).coalesce(1), folder)
    job = next((tmp_path / "frames").glob("job-*"))
    (job / "part-0-lost").mkdir()
    (job / "part-0-lost" / "twice.bmp").write_bytes(B.encode(1, 1, 3, b"abc"))
    assert len(names()) == 4
    B.write_bitmaps(bitmaps(spark, [(2, 2, 3)], {0: "only"}), folder, overwrite=True)
    assert names() == ["only.bmp"]
    B.write_bitmaps(bitmaps(spark, [(2, 2, 3)]).where("false"), folder, overwrite=True)
    assert names() == []


def test_bitmaps_of_others(spark, tmp_path):
    # A folder without commits: bottom row first, junk, cut off, empty.
    good = bytearray(B.encode(2, 1, 3, b"abcdef"))
    good[22:26] = struct.pack("<i", 2)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "up_012b.bmp").write_bytes(good)
    (tmp_path / "junk_3.bmp").write_bytes(b"nothing")
    (tmp_path / "cut.bmp").write_bytes(B.encode(9, 9, 4, bytes(324))[:-1])
    (tmp_path / "none.bmp").write_bytes(b"")
    (tmp_path / "other.png").write_bytes(b"")
    rows = {r.name: r for r in B.read_strips(spark, str(tmp_path), 64).collect()}
    assert set(rows) == {"up_012b.bmp", "junk_3.bmp", "cut.bmp", "none.bmp"}
    assert [n for n, r in rows.items() if not r.is_corrupt] == ["up_012b.bmp"]
    assert bytes(rows["up_012b.bmp"].data) == b"defabc" and rows["up_012b.bmp"].frame_nr == 12
    assert rows["junk_3.bmp"].frame_nr == 3 and rows["cut.bmp"].data is None


def test_bitmap_filters(spark, tmp_path):
    folder = str(tmp_path / "frames")
    B.write_bitmaps(bitmaps(spark, [(2, 2, 3)] * 20), folder)
    key = "spark.sql.python.filterPushdown.enabled"
    tests = ("frame_nr >= 3 and frame_nr < 6", "name = 'f_007.bmp'", "frame_nr in (1, 19, 77) and h = 2", "frame_nr > 18 or h = 1")
    plain = [sorted(r.name for r in B.read_strips(spark, folder).where(t).collect()) for t in tests]
    spark.conf.set(key, "true")
    try:
        # One image a task, so that the number of tasks tells how many files are opened.
        found = [B.read_strips(spark, folder, 16).where(t) for t in tests]
        assert [sorted(r.name for r in f.collect()) for f in found] == plain
        assert [f.rdd.getNumPartitions() for f in found] == [3, 1, 2, 20]
    finally:
        spark.conf.unset(key)
    assert [len(p) for p in plain] == [3, 1, 2, 1]


def test_projects_round_trip(spark, tmp_path):
    rows = [(1, '[{"version":"0.4.0"}]', '{"layers":{}}', "[]", '{"cels":[]}'), (2, '[{"version":"0.2.9"}]', "{}", "[]", None)]
    sections = spark.createDataFrame(rows, "project_id int, metadata string, save_state string, temp_images string, document string")
    P.write_projects(sections, str(tmp_path / "out"))
    back = P.read_projects(spark, str(tmp_path / "out"))
    got = sorted((r.metadata, r.save_state, r.temp_images, str(r.document)) for r in back.collect())
    assert got == sorted((r[1], r[2], r[3], str(r[4])) for r in rows)


def test_sentinels_unpack(spark):
    row = spark.range(1).select(dense_to_rgba(F.lit(-100)).alias("d"), label_to_rgba(F.lit(-100)).alias("l")).first()
    assert tuple(row.d) == (156, 255, 255, 255) and tuple(row.l) == (255, 255, 255, 255)


def test_streamed_import(spark, tmp_path):
    schema = "seq long, image_id string, content string, force_new boolean"
    saved: dict[int, list] = {}
    spark.createDataFrame([(1, "a", "x", False), (2, "b", "x", False), (3, "c", "y", False)], schema).write.parquet(str(tmp_path / "in"))
    empty = "image_id string, hash string, reference_count long"
    handler = store_batches(
        lambda: spark.createDataFrame([], empty),
        lambda assigned, records, batch_id: saved.update({batch_id: sorted(map(tuple, assigned.collect()))}),
    )
    stream = (
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(handler)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    stream.awaitTermination(60)
    assert [r for b in sorted(saved) for r in saved[b]] == [(1, "a"), (2, "a"), (3, "c")]


def test_reference_frame_of_a_corpus(spark):
    from flatcel.operators.sequences import scan_corpus

    names = ["lineLayer1_f1_.png", "colorLayer1_f1_.png", "lineLayer1_f2_.png", "colorLayer1_f2_.png", "lineLayer1_f3_.png"]
    files = spark.createDataFrame([("a", n) for n in names] + [("b", names[2])], "corpus string, name string")
    for ref, error in ((None, None), (2, None), (3, "REFERENCE_WITHOUT_COLOR"), (9, "REFERENCE_WITHOUT_COLOR")):
        frames, errors = scan_corpus(files, ref)
        roles = {r.frame_nr: r.role for r in frames.collect()}
        assert {r.corpus: r.error for r in errors.collect()} == ({"b": "NO_COLOR"} | ({"a": error} if error else {}))
        if error is None:
            assert [n for n, role in sorted(roles.items()) if role == "reference"] == [ref or 1]
            assert len(roles) == 3
        else:
            assert roles == {}


def test_folders_are_listed_in_tasks(spark, tmp_path):
    for name in ("a_1.bmp", "x/b_1.bmp", "x/y z/b_2.bmp", "x/y z/c_2.png", "_gone/b_1.bmp", ".b_1.bmp", "k=1/_n=2/a_2.bmp"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"0" * len(name))
    got = I.list_files(spark, str(tmp_path), ["{a,b}_?.bmp", "b_*", "*.tif"])
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    want = raw.where("path like '%.bmp'").select("path", "length", "modificationTime")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_tasks_hold_many_strips(spark, tmp_path):
    from flatcel.sources import bitmaps as B

    (tmp_path / "f_001.bmp").write_bytes(B.encode(4096, 16, 3, bytes(4096 * 48)))
    reader = B.BitmapReader(f"file://{tmp_path}", 48)
    tasks = reader.partitions()
    assert len(tasks) <= 2 * B.TASKS and sum(len(t.pieces) for t in tasks) >= 4096
    rows = [r for t in tasks for r in reader.read(t)]
    assert [r[6] for r in rows] == list(range(4096)) and {r[7] for r in rows} == {1}


def test_bitmaps_in_tasks(spark, tmp_path):
    """Bitmaps of every kind beside other files: rows as Spark's image source gives them, plain ones without it."""
    rng = random.Random(5)
    (tmp_path / "sub [1]").mkdir()
    for k, (h, w, n) in enumerate([(1, 1, 3), (7, 5, 3), (3, 4, 4), (6, 2, 3)]):
        data = B.encode(h, w, n, rng.randbytes(h * w * n))
        (tmp_path / "sub [1]" / f"a {k}%#é {{x}}_{k:03d}.bmp").write_bytes(data)
        (tmp_path / f"up_{k:03d}.BMP").write_bytes(data[:22] + struct.pack("<i", h) + data[26:])  # bottom row first
    (tmp_path / "black_011.bmp").write_bytes(B.encode(2, 2, 3, bytes(12)))
    (tmp_path / "junk_012.bmp").write_bytes(b"nothing")
    (tmp_path / "none_013.bmp").write_bytes(b"")
    (tmp_path / "_hidden_014.bmp").write_bytes(B.encode(1, 1, 3, b"abc"))
    png(tmp_path / "bmp", [[9, 8, 7]], 2)
    png(tmp_path / "p.bmp.png", [[9, 8, 7]], 2)
    png(tmp_path / "named_015.bmp", [[9, 8, 7, 6, 5, 4]], 2)
    source = spark.read.format("image").option("recursiveFileLookup", True).load(str(tmp_path)).select("image.*")
    want = sorted((r.origin, r.height, r.width, r.nChannels, bytes(r.data)) for r in source.collect())
    found = I.read_images(spark, str(tmp_path))
    got = sorted((r.image_id, r.h, r.w, r.n_channels, bytes(r.data)) for r in found.collect())
    assert got == want and len(got) == 13  # without the empty file
    assert {r.image_id.rsplit("/", 1)[-1] for r in found.where("is_corrupt").collect()} == {"black_011.bmp", "junk_012.bmp"}
    one = I.read_images(spark, str(tmp_path / "up_001.BMP"))
    assert [bytes(r.data) for r in one.collect()] == [r[4] for r in want if r[0].endswith("up_001.BMP")]
    for k in range(3):
        (tmp_path / "plain").mkdir(exist_ok=True)
        (tmp_path / "plain" / f"f_{k}.bmp").write_bytes(B.encode(2, 2, 3, rng.randbytes(12)))
    plan = I.read_images(spark, str(tmp_path / "plain"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "image" not in plan.lower().split("mapinarrow")[-1]
