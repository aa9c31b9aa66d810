"""The most similar references of every target segment, without the whole similarity matrix.

References of a frame are dealt into blocks of like direction, each with its center and the greatest
distance of a member from it. For a target of length one, no member is more similar than the product
with the center plus that distance. Every target first meets the block of its greatest bound, which
gives it k candidates; then only the blocks whose bound reaches the weakest of them. Lists of the k
best merge, so no task needs all blocks of a target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from flatcel.operators.matching import BLOCK, TEMPERATURE, _unit_rows
from flatcel.operators.skew import join_lookup
from flatcel.session import cut_lineage, drop_written

# Planes whose sides tell directions apart: at most 2^PLANES directions of a frame.
PLANES = 10
SLACK = 1e-9  # rounding of a product of two vectors of length one


def _directions(refs: DataFrame) -> DataFrame:
    """References with the side of each plane they lie on, as a number."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refs.schema)

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _unit_rows(np.concatenate(batch["features"].to_numpy()), len(batch))
                planes = np.random.default_rng(3).standard_normal((x.shape[1], PLANES))
                yield batch.assign(sides=((x @ planes > 0) << np.arange(PLANES)).sum(axis=1).astype("int32"))

    return refs.mapInPandas(sides, f"{schema}, sides int")


def _reference_blocks(ref: DataFrame) -> DataFrame:
    """(pair_id, r_block, r_segs, r_feats, center, reach). As many sides count as give blocks of about
    BLOCK; a direction with more members than that is split by segment."""
    marked = cut_lineage(_directions(ref.select("pair_id", "seg_id", "features")))
    sizes = marked.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK)))).cast("int")
    ways = sizes.select("pair_id", F.pow(F.lit(2), bits).cast("int").alias("ways"))
    sized = join_lookup(marked, ways, ["pair_id"], "inner")
    placed = sized.withColumn("d", F.col("sides") % F.col("ways"))
    crowds = placed.groupBy("pair_id", "d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("pieces"))
    split = join_lookup(placed, crowds, ["pair_id", "d"], "inner").withColumn("p", F.pmod(F.col("seg_id"), F.col("pieces")))
    grouped = split.groupBy("pair_id", "d", "p").agg(F.sort_array(F.collect_list(F.struct("seg_id", "features"))).alias("s"))
    pair_type = ref.schema["pair_id"].dataType.simpleString()

    def centers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["pair_id", "r_block", "r_segs", "r_feats"]].copy()
            units = [_unit_rows(f, len(s)) for f, s in zip(batch["r_feats"], batch["r_segs"])]
            middle = [u.mean(axis=0) for u in units]
            out["center"] = middle
            out["reach"] = [float(np.linalg.norm(u - m, axis=1).max()) for u, m in zip(units, middle)]
            yield out

    flat = grouped.select(
        "pair_id", F.concat_ws(":", "d", "p").alias("r_block"), F.col("s.seg_id").alias("r_segs"), F.flatten("s.features").alias("r_feats")
    )
    blocks = flat.mapInPandas(
        centers, f"pair_id {pair_type}, r_block string, r_segs array<int>, r_feats array<double>, center array<double>, reach double"
    )
    blocks = cut_lineage(blocks)
    drop_written(marked)
    return blocks


def top_matches(ref: DataFrame, tgt: DataFrame, k: int, temperature: float = TEMPERATURE, stats: dict | None = None) -> DataFrame:
    """The ``k`` references most similar to each target of a pair: pair_id, tgt_seg, rank (from 1),
    ref_seg, sim; equal similarities by reference id. Targets of pairs without references give no rows.
    ``stats`` receives the numbers of all block pairs and of those that were multiplied."""
    pair_type = ref.schema["pair_id"].dataType.simpleString()
    blocks = _reference_blocks(ref)
    targets = tgt.select("pair_id", "seg_id", "features", F.floor(F.col("seg_id") / BLOCK).alias("t_block"))
    rows = F.sort_array(F.collect_list(F.struct("seg_id", "features")))
    targets = cut_lineage(
        targets.groupBy("pair_id", "t_block").agg(rows.alias("s")).select(
            "pair_id", "t_block", F.col("s.seg_id").alias("t_segs"), F.flatten("s.features").alias("t_feats")
        )
    )
    # Numbers of blocks are paired first; centers follow by joins, members only for blocks that are met.
    numbers = targets.select("pair_id", "t_block").join(blocks.select("pair_id", "r_block"), "pair_id")
    faced = numbers.join(targets, ["pair_id", "t_block"]).join(
        blocks.select("pair_id", "r_block", "center", "reach"), ["pair_id", "r_block"]
    )

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                most = _unit_rows(row.t_feats, len(row.t_segs)) @ np.asarray(row.center) + row.reach + SLACK
                yield pd.DataFrame(
                    {"pair_id": row.pair_id, "t_block": row.t_block, "r_block": row.r_block, "tgt_seg": row.t_segs, "most": most}
                )

    bounds = cut_lineage(
        faced.mapInPandas(bound, f"pair_id {pair_type}, t_block long, r_block string, tgt_seg int, most double")
    )

    def best(visits: DataFrame) -> DataFrame:
        """The k best of each target within each block it visits."""
        listed = visits.groupBy("pair_id", "t_block", "r_block").agg(F.collect_list("tgt_seg").alias("wanted"))
        met = listed.join(targets, ["pair_id", "t_block"]).join(blocks.drop("center", "reach"), ["pair_id", "r_block"])

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    at = np.isin(row.t_segs, row.wanted)
                    sim = _unit_rows(row.t_feats, len(row.t_segs))[at] @ _unit_rows(row.r_feats, len(row.r_segs)).T
                    order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame(
                        {
                            "pair_id": row.pair_id, "tgt_seg": np.repeat(np.asarray(row.t_segs)[at], order.shape[1]),
                            "ref_seg": np.asarray(row.r_segs)[order].ravel(), "cosine": np.take_along_axis(sim, order, 1).ravel(),
                        }
                    )

        return cut_lineage(met.mapInPandas(multiply, f"pair_id {pair_type}, tgt_seg int, ref_seg int, cosine double"))

    target = ["pair_id", "tgt_seg"]
    first = bounds.groupBy(*target).agg(F.max_by("r_block", F.struct("most", "r_block")).alias("r_block"))
    first = cut_lineage(bounds.drop("most").join(first, [*target, "r_block"], "left_semi"))
    found = best(first)
    # k or more candidates of the first block bound what the others have to reach.
    place = Window.partitionBy(*target).orderBy(F.desc("cosine"), "ref_seg")
    limits = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select(*target, F.col("cosine").alias("least"))
    rest = bounds.join(first.select(*target, "r_block"), [*target, "r_block"], "left_anti").join(limits, target, "left")
    second = cut_lineage(rest.where("least is null or most >= least").drop("most", "least"))
    out = found.unionByName(best(second))
    if stats is not None:
        stats["all"] = numbers.count()
        stats["met"] = first.unionByName(second).select("pair_id", "t_block", "r_block").distinct().count()
    ranked = out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    drop_written(bounds, first, second)
    return ranked.select(*target, "rank", "ref_seg", (F.col("cosine") / temperature).alias("sim"))
