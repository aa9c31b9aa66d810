"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flatcel.operators.skew import join_unique
from flatcel.session import cut_lineage, drop_written

# Links that a task contracts at once.
CHUNK_LINKS = 1 << 20


def _ranks(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every entry, an entry of every rank); nodes are plain values or flat structs."""
    fields = nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]
    table = pa.table({f"f{i}": f for i, f in enumerate(fields)})
    order = pa.compute.sort_indices(table, [(n, "ascending") for n in table.column_names])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for column in table.take(order).columns:
        if len(column) > 1:
            fresh[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    order = order.to_numpy()
    rank = np.empty(len(order), "int64")
    rank[order] = np.cumsum(fresh) - 1
    return rank, order[fresh]


def _contracted(links: DataFrame) -> DataFrame:
    """(u, v, chunk): every chunk of links as stars around the smallest node of each of its parts."""
    node = links.schema["u"].dataType.simpleString()

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, chunk = [], 0, TaskContext.get().partitionId() << 20
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_LINKS:
                yield stars(kept, chunk)
                kept, rows, chunk = [], 0, chunk + 1
        if rows:
            yield stars(kept, chunk)

    def stars(batches: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
        nodes = pa.concat_arrays([b.column(c) for c in ("u", "v") for b in batches])
        rank, entry = _ranks(nodes)
        a, b = np.split(rank, 2)
        root = np.arange(len(entry))
        while len(a):
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while not np.array_equal(short := root[root], root):
                root = short
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        below = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays(
            [nodes.take(pa.array(entry[below])), nodes.take(pa.array(entry[root[below]])), pa.array(np.full(len(below), chunk))],
            names=["u", "v", "chunk"],
        )

    return links.mapInArrow(contract, f"u {node}, v {node}, chunk long")


def _without_chunk(links: DataFrame) -> DataFrame:
    plain = links.select("u", "v")
    plain._cut_folder = links._cut_folder
    return plain


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of (src, dst); the component is its
    smallest node. Works on any sortable node type.

    Tasks first contract their own links to stars; links of a single task are then
    done. Otherwise two steps alternate until the edges stop changing: every node hands
    its larger neighbors to the smallest one, then its smaller neighbors. Long paths
    shrink exponentially. A hub with a large share of the edges is served by
    broadcast (``join_unique``), its minimum by partial aggregation.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = cut_lineage(_contracted(pairs))
    first, last = links.agg(F.min("chunk"), F.max("chunk")).first()
    links, state = _without_chunk(links), None
    for _ in range(max_rounds if first != last else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("__m"), F.count(F.lit(1)).alias("__n")).withColumn(
            "__m", F.least("__m", "u")
        )
        large = (
            join_unique(both.where("v > u"), smallest, ["u"], "__n")
            .select(F.col("v").alias("u"), F.col("__m").alias("v"))
            .distinct()
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("__m"), F.count(F.lit(1)).alias("__n"))
        joined = join_unique(large, smallest, ["u"], "__n")
        small = (
            joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("__m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, links = links, cut_lineage(small)
        drop_written(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    else:
        if first != last:
            raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
