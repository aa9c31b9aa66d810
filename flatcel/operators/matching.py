"""Segment matching by feature similarity.

Every target segment is compared with every reference segment of its pair, but
no pair of segments ever becomes a row. Segments are gathered into blocks of
``BLOCK`` ids, each pair of blocks is one matrix product inside a task, and what
leaves the task is already summed up per target. A frame with millions of
segments is millions of block pairs spread over the cluster by block id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from flatcel.functions.arrays import argmax, dot, let, softmax
from flatcel.functions.color import NULL_COLOR
from flatcel.session import cut_lineage

BLOCK = 128
TEMPERATURE = 0.1
# Taken off the similarity of a masked reference.
MASKED = 1e4


def _blocks(side: DataFrame, prefix: str) -> DataFrame:
    """(pair_id, block) -> ids, colors and flattened features. Ids are unique
    within a frame, hence at most BLOCK segments in a block."""
    rows = F.sort_array(F.collect_list(F.struct("seg_id", "color_id", F.col("features").alias("f"))))
    return (
        side.withColumn(f"{prefix}_block", F.floor(F.col("seg_id") / BLOCK))
        .groupBy("pair_id", f"{prefix}_block")
        .agg(rows.alias("s"))
        .select(
            "pair_id",
            f"{prefix}_block",
            F.col("s.seg_id").alias(f"{prefix}_segs"),
            F.col("s.color_id").alias(f"{prefix}_colors"),
            F.flatten("s.f").alias(f"{prefix}_feats"),
        )
    )


def block_pairs(ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """All (reference block, target block) pairs of each pair of frames.

    The pairing is made on block numbers alone; the data follow by joins on
    (pair, block), so the blocks of one giant frame go to many tasks.
    """
    rid = ref.select("pair_id", F.floor(F.col("seg_id") / BLOCK).alias("r_block")).distinct()
    tid = tgt.select("pair_id", F.floor(F.col("seg_id") / BLOCK).alias("t_block")).distinct()
    return (
        rid.join(tid, "pair_id")
        .join(_blocks(tgt, "t"), ["pair_id", "t_block"])
        .join(_blocks(ref, "r"), ["pair_id", "r_block"])
    )


def _unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    """Centered rows of length one, as ``functions.arrays.norm_features``."""
    x = np.asarray(flat, dtype=float).reshape(n, -1)
    x = x - x.mean(axis=1, keepdims=True)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)


def _per_block(
    pairs: DataFrame, reduce: Callable[[np.ndarray, pd.Series], dict], schema: str, temperature: float
) -> DataFrame:
    """Run ``reduce`` on the (targets x references) similarities of each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                t = _unit_rows(row.t_feats, len(row.t_segs))
                r = _unit_rows(row.r_feats, len(row.r_segs))
                out = reduce(t @ r.T / temperature, row)
                out["pair_id"] = row.pair_id
                yield pd.DataFrame(out)

    pair_type = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.mapInPandas(run, f"pair_id {pair_type}, {schema}")


def similarity(ref: DataFrame, tgt: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Similarity matrix in block rows: for each target and block of
    references, their ids, colors and similarities as arrays."""

    def rows(sim: np.ndarray, row: pd.Series) -> dict:
        n = len(row.t_segs)
        return {
            "tgt_seg": row.t_segs,
            "ref_block": [row.r_block] * n,
            "ref_segs": [row.r_segs] * n,
            "ref_colors": [row.r_colors] * n,
            "sims": list(sim),
        }

    schema = "tgt_seg int, ref_block long, ref_segs array<int>, ref_colors array<int>, sims array<double>"
    return _per_block(block_pairs(ref, tgt), rows, schema, temperature)


def masked_softmax(sims: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Weights of each target over all its references. Masked ones (null color) lose
    ``MASKED`` before the softmax, which leaves them no weight; if all references of a
    target are masked, theirs is an ordinary softmax. The greatest value of a target is
    taken off first, whatever the temperature."""
    lowered = F.zip_with("sims", "ref_colors", lambda s, c: F.when(c == NULL_COLOR, s - MASKED).otherwise(s))
    scored = sims.withColumn("s", lowered)
    peaks = scored.groupBy("pair_id", "tgt_seg").agg(F.max(F.array_max("s")).alias("__peak"))
    weighed = scored.join(peaks, ["pair_id", "tgt_seg"]).withColumn(
        "w", F.transform("s", lambda v: F.exp(v - F.col("__peak")))
    )
    totals = weighed.groupBy("pair_id", "tgt_seg").agg(
        F.sum(F.aggregate("w", F.lit(0.0), lambda a, e: a + e)).alias("__z")
    )
    return weighed.join(totals, ["pair_id", "tgt_seg"]).select(
        "pair_id",
        "tgt_seg",
        "ref_block",
        "ref_segs",
        F.transform("w", lambda e: e / F.col("__z")).alias("weights"),
    )


def color_votes(ref: DataFrame, tgt: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Share of the softmax weight that each color id gets from the references
    of a target. Similarity and vote happen in one pass; partial sums per color
    and block leave the tasks. Targets all of whose references are masked give
    their whole vote to id 0, where masked references are counted."""

    def partial(sim: np.ndarray, row: pd.Series) -> dict:
        colors = np.asarray(row.r_colors)
        kept = colors != NULL_COLOR
        ids, where = np.unique(colors[kept], return_inverse=True)
        one_hot = np.zeros((kept.sum(), len(ids)))
        one_hot[np.arange(len(where)), where] = 1.0
        top = sim[:, kept].max(axis=1, initial=-np.inf)
        votes = np.exp(sim[:, kept] - top[:, None]) @ one_hot
        n, k = votes.shape
        return {
            "tgt_seg": np.repeat(np.asarray(row.t_segs), k),
            "color_id": np.tile(ids, n).astype("int32"),
            "top": np.repeat(top, k),
            "w": votes.reshape(-1),
        }

    # Sums of a block are relative to the greatest similarity there.
    blocks = cut_lineage(
        _per_block(block_pairs(ref, tgt), partial, "tgt_seg int, color_id int, top double, w double", temperature)
    )
    peaks = blocks.groupBy("pair_id", "tgt_seg").agg(F.max("top").alias("peak"))
    summed = (
        blocks.join(peaks, ["pair_id", "tgt_seg"])
        .groupBy("pair_id", "tgt_seg", "color_id")
        .agg(F.sum(F.col("w") * F.exp(F.col("top") - F.col("peak"))).alias("w"))
    )
    # At most one row per palette color is left for each target.
    share = F.col("w") / F.sum("w").over(Window.partitionBy("pair_id", "tgt_seg"))
    voted = summed.select("pair_id", "tgt_seg", "color_id", share.alias("vote"))
    targets = tgt.select("pair_id", F.col("seg_id").alias("tgt_seg"))
    undecided = targets.join(voted.select("pair_id", "tgt_seg").distinct(), ["pair_id", "tgt_seg"], "left_anti")
    known = ref.select("pair_id").distinct()
    return voted.unionByName(
        undecided.join(known, "pair_id", "left_semi").select(
            "pair_id", "tgt_seg", F.lit(0).alias("color_id"), F.lit(1.0).alias("vote")
        )
    )


def predict_colors(votes: DataFrame, tgt: DataFrame) -> DataFrame:
    """Most voted color of each target (smallest id on a tie). Inactive targets,
    those whose own color is null, are given id 0."""
    best = votes.groupBy("pair_id", "tgt_seg").agg(
        F.max_by("color_id", F.struct("vote", (-F.col("color_id")).alias("k"))).alias("__best")
    )
    targets = tgt.select("pair_id", F.col("seg_id").alias("tgt_seg"), F.col("color_id").alias("tgt_color"))
    return targets.join(best, ["pair_id", "tgt_seg"], "left").select(
        "pair_id",
        "tgt_seg",
        "tgt_color",
        F.when(F.col("tgt_color") == NULL_COLOR, 0).otherwise(F.coalesce("__best", F.lit(0))).alias("predicted"),
    )


def cycle_consistency(ref: DataFrame, tgt: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Share of active references that come back to themselves when their
    position travels to the targets and back; only targets whose color was
    predicted right send positions back."""
    colors = predict_colors(color_votes(ref, tgt, temperature), tgt)
    by_place = ref.withColumn(
        "color_id", F.when(F.col("color_id") == NULL_COLOR, NULL_COLOR).otherwise(F.col("seg_id"))
    )
    forward = predict_colors(color_votes(by_place, tgt, temperature), tgt).select(
        "pair_id", "tgt_seg", F.col("predicted").alias("__place")
    )
    right = colors.where((F.col("tgt_color") != NULL_COLOR) & (F.col("tgt_color") == F.col("predicted")))
    senders = (
        tgt.withColumnRenamed("seg_id", "tgt_seg")
        .join(forward, ["pair_id", "tgt_seg"])
        .join(right.select("pair_id", "tgt_seg", F.lit(True).alias("__ok")), ["pair_id", "tgt_seg"], "left")
        .select(
            "pair_id",
            F.col("tgt_seg").alias("seg_id"),
            F.when(F.col("__ok"), F.col("__place")).otherwise(NULL_COLOR).alias("color_id"),
            "features",
        )
    )
    back = predict_colors(color_votes(senders, ref, temperature), ref)
    active = F.col("tgt_color") != NULL_COLOR
    return back.groupBy("pair_id").agg(
        F.count_if(active).alias("active"),
        F.count_if(active & (F.col("predicted") == F.col("tgt_seg"))).alias("returned"),
    )


def mean_cosine(vectors: DataFrame, key: str = "pair_id") -> DataFrame:
    """Mean cosine of column pairs ``a`` and ``b`` over unpadded rows."""
    na, nb = F.sqrt(dot(F.col("a"), F.col("a"))), F.sqrt(dot(F.col("b"), F.col("b")))
    cosine = dot(F.col("a"), F.col("b")) / (F.greatest(na, F.lit(1e-12)) * F.greatest(nb, F.lit(1e-12)))
    return vectors.where(~F.col("is_padding")).groupBy(key).agg(F.avg(cosine).alias("mean_cosine"))


def masked_logits(logits: DataFrame, shown: DataFrame) -> DataFrame:
    """Softmax over the colors shown in the reference of the pair, and its
    argmax. ``logits``: pair_id, seg_id, logits array; ``shown``: pair_id,
    color_id. There are no more shown ids than classes."""
    ids = (
        shown.where(F.col("color_id") != NULL_COLOR).groupBy("pair_id").agg(F.collect_set("color_id").alias("__shown"))
    )
    masked = F.transform(
        "logits",
        lambda z, i: z.cast("double") + F.when(F.coalesce(F.array_contains("__shown", i), F.lit(False)), 0.0).otherwise(-1.0e4),
    )
    answer = let(
        softmax(masked), lambda p: F.struct(p.alias("probs"), argmax(p).alias("predicted"))
    )
    return logits.join(ids, "pair_id", "left").select("pair_id", "seg_id", answer.alias("__a")).select(
        "pair_id", "seg_id", "__a.probs", "__a.predicted"
    )


def clamp_predictions(ids: DataFrame, palette: DataFrame) -> DataFrame:
    """Predicted ids outside of the palette become -100."""
    sizes = palette.groupBy("project_id").agg(F.count(F.lit(1)).alias("__n"))
    return ids.join(sizes, "project_id", "left").select(
        *[c for c in ids.columns if c != "color_id"],
        F.when(F.col("color_id") < F.coalesce("__n", F.lit(0)), F.col("color_id")).otherwise(NULL_COLOR).alias("color_id"),
    )


def agreement(both: DataFrame, key: str = "pair_id") -> DataFrame:
    """Argmax agreement of two runs (``a``, ``b`` logit arrays), in percent, the
    largest difference, and the largest margin lost by a flipped argmax."""
    ia, ib = argmax(F.col("a")), argmax(F.col("b"))
    gap = F.array_max(F.zip_with("a", "b", lambda p, q: F.abs(p - q)))
    margin = F.get("a", ia) - F.get("a", ib)
    return both.groupBy(key).agg(
        (F.avg((ia == ib).cast("double")) * 100).alias("agree_pct"),
        F.max(gap).alias("max_diff"),
        F.coalesce(F.max(F.when(ia != ib, margin)), F.lit(0.0)).alias("flip_margin"),
    )


def flip_report(values: DataFrame, threshold: float, key: str = "frame_id") -> DataFrame:
    """How often ``a`` and ``b`` fall on different sides of a threshold."""
    flip = (F.col("a") < threshold) != (F.col("b") < threshold)
    return values.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(flip).alias("flips"),
        (F.avg(flip.cast("double")) * 100).alias("flip_pct"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"),
    )


def pool_features(features: DataFrame) -> DataFrame:
    """Mean feature vector of each segment (image_id, seg_id, features per
    pixel); padding pixels do not count. Sums are combined map-side per
    (segment, channel), so a giant segment does not pile up anywhere."""
    long = features.where(F.col("seg_id") != NULL_COLOR).select(
        "image_id", "seg_id", F.posexplode("features").alias("dim", "value")
    )
    means = long.groupBy("image_id", "seg_id", "dim").agg(F.avg(F.col("value").cast("double")).alias("m"))
    return (
        means.groupBy("image_id", "seg_id")
        .agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("s"))
        .select("image_id", "seg_id", F.col("s.m").alias("features"))
    )
