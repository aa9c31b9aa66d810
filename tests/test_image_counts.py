"""Streamed counts of image uses: restarts, failed batches, repeated deliveries."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from flatcel.operators.assets import store_images
from flatcel.streaming.image_counts import assigned_images, count_uses, image_records, keyed_uses, save_counts

SCHEMA = "seq long, image_id string, content string, force_new boolean, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.unset(key)


def batches(seed, n=3, size=60):
    rng = random.Random(seed)
    seq, out = 0, []
    for _ in range(n):
        rows = []
        for _ in range(size):
            seq += 1
            content = rng.choice(["hot"] * 10 + [f"c{i}" for i in range(20)] + ["", None])
            rows.append((seq, f"i{seq}", content, rng.choice([False, False, None, True])))
        out.append(rows)
    return out


def by_hand(parts):
    record, count, assigned = {}, Counter(), {}
    for rows in parts:
        for seq, image, content, forced in sorted(rows):
            if content is None:
                continue
            first = record.setdefault(content, image)
            assigned[seq] = image if forced else first
            count[assigned[seq]] += 1
            count[first] += 0
    return assigned, dict(count)


def put(spark, rows, folder):
    from datetime import datetime

    timed = [(*r, datetime(2024, 1, 1)) for r in rows]
    random.Random(9).shuffle(timed)
    spark.createDataFrame(timed, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, handler=None, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        count_uses(stream, **options)
        .writeStream.foreachBatch(handler or save_counts(str(tmp_path / "out")))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    query.stop()


def check(spark, tmp_path, parts):
    assigned, count = by_hand(parts)
    counts = spark.read.parquet(str(tmp_path / "out"))
    uses = keyed_uses(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))).distinct()
    assert {r.image_id: r.reference_count for r in image_records(counts).collect()} == count
    assert sorted(map(tuple, assigned_images(uses, counts).collect())) == sorted(assigned.items())


def test_restart_goes_on_from_the_state(rocks, tmp_path):
    parts = batches(1)
    for rows in parts:  # a new query for each file, on one checkpoint
        put(rocks, rows, str(tmp_path / "in"))
        run(rocks, tmp_path)
    check(rocks, tmp_path, parts)


def test_failed_batch_is_counted_once(rocks, tmp_path):
    parts = batches(2)
    save = save_counts(str(tmp_path / "out"))
    failures = []

    def fails_once(batch, batch_id):
        save(batch, batch_id)  # the state is written, the batch is not committed
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            raise RuntimeError("lost")

    for i, rows in enumerate(parts):
        put(rocks, rows, str(tmp_path / "in"))
        if i == 1:
            with pytest.raises(StreamingQueryException):
                run(rocks, tmp_path, fails_once)
        else:
            run(rocks, tmp_path, fails_once)
    assert failures == [1]
    check(rocks, tmp_path, parts)


def test_repeated_deliveries_are_counted_once(rocks, tmp_path):
    parts = batches(3, n=2)
    for rows in (parts[0], parts[0], parts[1], parts[1][:30]):
        put(rocks, rows, str(tmp_path / "in"))
        run(rocks, tmp_path, event_time="at")
    check(rocks, tmp_path, parts)


def test_equals_the_batch_operator(rocks, tmp_path):
    (rows,) = batches(4, n=1)
    rows = [(s, i, c, bool(f)) for s, i, c, f in rows if c is not None]
    put(rocks, rows, str(tmp_path / "in"))
    run(rocks, tmp_path)
    counts = rocks.read.parquet(str(tmp_path / "out"))
    incoming = rocks.createDataFrame(rows, "seq long, image_id string, content string, force_new boolean")
    assigned, records = store_images(incoming, rocks.createDataFrame([], "image_id string, hash string, reference_count long"))
    assert sorted(map(tuple, assigned_images(keyed_uses(incoming), counts).collect())) == sorted(map(tuple, assigned.collect()))
    ours = image_records(counts).where("reference_count > 0").select("image_id", "hash", "reference_count")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, records.collect()))
