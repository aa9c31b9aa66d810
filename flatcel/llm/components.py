"""Connected components of a link table, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flatcel.session import cut_lineage, drop_written


def linked_components(links: DataFrame, max_rounds: int = 80) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round first hands the larger neighbours of every node to its smallest
    neighbour, then its smaller ones; paths shrink by a constant factor a round. The
    minimum of a node is a partially aggregated group-by, the join back is an equi join
    whose hot side Spark may split. A round is written to the shared checkpoint folder
    and the one before it deleted. Loops and nulls in ``links`` are ignored.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = cut_lineage(small)
        drop_written(edges, large)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
