"""Micro-batch import of images: ``foreachBatch`` around the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from flatcel.operators.assets import store_images
from flatcel.session import cut_lineage


def store_batches(load_records: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame, int], None]):
    """Handler for ``writeStream.foreachBatch``.

    ``load_records`` reads the stored records (image_id, hash, reference_count),
    ``save`` keeps a batch's (assignments, changed records) under its batch id,
    so that a replayed batch overwrites its own output.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The batch is used several times; a stream source must be read once.
        incoming = cut_lineage(batch.select("seq", "image_id", "content", F.col("force_new")))
        assigned, records = store_images(incoming, load_records())
        save(assigned, records, batch_id)

    return handle
