"""Uses of images counted in Spark's state store: a stream in place of re-reading all records.

A use without ``force_new`` belongs to the record of its bytes, a forced one to a record of
its own. State is kept per (hash, own): ``own`` is empty for the record of the bytes, else the
image id of a forced one. Tasks combine their uses before the shuffle, so a common image
sends a few rows a task however often it is used, and a group keeps two numbers.

Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flatcel.operators.skew import join_unique

_COMBINED = "hash string, own string, n long, seq long, image_id string"
_COUNTS = "hash string, own string, image_id string, uses long"


def keyed_uses(incoming: DataFrame) -> DataFrame:
    """(seq, image_id, hash, own) of ``incoming`` (seq, image_id, content, force_new). Rows without
    content are no uses; a missing ``force_new`` is false."""
    forced = F.coalesce("force_new", F.lit(False))
    return incoming.where("content is not null").select(
        "seq", "image_id", F.md5("content").alias("hash"), F.when(forced, F.col("image_id")).otherwise("").alias("own")
    )


def _combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per (hash, own) of a batch: uses, and the first image. Forced uses also stand, without
    being counted, among those of their bytes: the first of them may make the record."""
    for part in parts:
        seats = part[part["own"] != ""].assign(own="", n=0)
        rows = pd.concat([part.assign(n=1), seats]).sort_values("seq", kind="stable")
        grouped = rows.groupby(["hash", "own"], sort=False)
        yield grouped.agg(n=("n", "sum"), seq=("seq", "first"), image_id=("image_id", "first")).reset_index()


class _Uses(StatefulProcessor):
    """Keeps the image and the uses of one (hash, own)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._record = handle.getValueState("record", "image_id string, uses long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._record.get() if self._record.exists() else None
        uses, first = 0, None
        for part in rows:
            uses += int(part["n"].sum())
            at = part["seq"].idxmin()
            if first is None or part["seq"][at] < first[0]:
                first = (part["seq"][at], part["image_id"][at])
        image, before = (known[0], known[1]) if known else (first[1], 0)
        if known is None or uses:
            self._record.update((image, before + uses))
            yield pd.DataFrame({"hash": [key[0]], "own": [key[1]], "image_id": [image], "uses": [before + uses]})

    def close(self) -> None:
        pass


def count_uses(incoming: DataFrame, event_time: str | None = None, repeats_within: str = "1 hour") -> DataFrame:
    """(hash, own, image_id, uses) of every group that a micro-batch changed, for a stream
    ``incoming``; ``uses`` are all so far. The first use of new bytes (smallest seq of its
    micro-batch) names the record.

    With ``event_time``, a seq that the source delivers again within ``repeats_within`` is
    counted once. State is versioned by micro-batch: a batch that failed is counted from the state before it."""
    if event_time:
        incoming = incoming.withWatermark(event_time, repeats_within).dropDuplicatesWithinWatermark(["seq"])
    combined = keyed_uses(incoming).mapInPandas(_combine, _COMBINED)
    return combined.groupBy("hash", "own").transformWithStateInPandas(_Uses(), _COUNTS, "Append", "None")


def save_counts(folder: str) -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch``: each micro-batch has its folder, which a repeated one overwrites."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return save


def _latest(counts: DataFrame) -> DataFrame:
    # Uses only grow, and the image of a group stays.
    return counts.groupBy("hash", "own").agg(F.first("image_id").alias("image_id"), F.max("uses").alias("uses"))


def image_records(counts: DataFrame) -> DataFrame:
    """(image_id, hash, reference_count) from saved ``counts``."""
    return _latest(counts).groupBy("image_id", "hash").agg(F.sum("uses").alias("reference_count"))


def assigned_images(uses: DataFrame, counts: DataFrame) -> DataFrame:
    """(seq, image_id) of ``uses`` (``keyed_uses``): a forced use keeps its image, others take that of
    their bytes. A common image may be a third of the uses: the join splits the most used ones."""
    shared = _latest(counts.where("own = ''")).select("hash", F.col("image_id").alias("__of"), F.col("uses").alias("__n"))
    return join_unique(uses, shared, ["hash"], "__n", "left").select(
        "seq", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("__of")).alias("image_id")
    )
