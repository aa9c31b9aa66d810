"""Vector paths and strokes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flatcel.operators import scan as SC
from flatcel.operators.skew import with_group_facts
from flatcel.session import cut_lineage

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def path_commands(paths: DataFrame) -> DataFrame:
    """Move and cubic commands of path texts, in viewbox units.

    ``paths``: image_id, path_id, d, transform (null or translate(x,y)), vw, vh.
    Closing commands are dropped, a path must start with a move; each command
    has three points (missing ones are 0) divided by the viewbox.
    """
    steps = F.filter(
        F.regexp_extract_all("d", F.lit(r"([MC][^A-Za-z]*)"), F.lit(1)), lambda s: F.length(F.trim(F.substring(s, 2, 999999999))) > 0
    )
    moved = F.regexp_extract_all(F.coalesce("transform", F.lit("translate(0,0)")), F.lit(f"({NUMBER})"), F.lit(1))
    starts_wrong = ~F.startswith(F.ltrim(F.col("d")), F.lit("M"))
    tokens = paths.select(
        "image_id", "path_id", "vw", "vh",
        F.get(moved, F.lit(0)).cast("double").alias("tx"), F.get(moved, F.lit(1)).cast("double").alias("ty"),
        F.posexplode(F.when(starts_wrong, F.raise_error(F.lit("a path must start with M")).cast("array<string>")).otherwise(steps)).alias("step", "s"),
    ).withColumns(
        {
            "cmd": F.substring("s", 1, 1),
            "n": F.regexp_extract_all("s", F.lit(f"({NUMBER})"), F.lit(1)).cast("array<double>"),
        }
    )
    width = F.when(F.col("cmd") == "M", 2).otherwise(6)
    parts = tokens.select(
        "*", F.explode(F.sequence(F.lit(0), F.floor(F.size("n") / width) - 1)).alias("part")
    ).withColumn("c", F.slice("n", F.col("part") * width + 1, width))

    def coordinate(i: int):
        shift, size = ("tx", "vw") if i % 2 == 0 else ("ty", "vh")
        return F.coalesce((F.get("c", F.lit(i)) + F.col(shift)) / F.col(size), F.lit(0.0))

    rows = parts.select("image_id", "path_id", "step", "part", "cmd", F.array(*[coordinate(i) for i in range(6)]).alias("pts"))
    return SC.numbered(
        rows, ["image_id", "path_id"], ["step", "part"],
        [{"s": F.col("step"), "p": F.floor(F.col("part") / SC.BUCKET_ROWS)}, {"c": F.floor(F.col("__b_s") / SC.BUCKET_ROWS)}],
        "cmd_idx",
    ).select("image_id", "path_id", F.col("cmd_idx").cast("int").alias("cmd_idx"), "cmd", "pts")


def path_summary(commands: DataFrame) -> DataFrame:
    """Box of the points of each path, whether it ends where it starts, and the
    command that ends topmost, then leftmost."""
    count = F.when(F.col("cmd") == "M", 1).otherwise(3)
    xs = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.get("pts", k * 2))
    ys = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.get("pts", k * 2 + 1))
    ends = commands.withColumns(
        {
            "end_x": F.get("pts", (count - 1) * 2), "end_y": F.get("pts", (count - 1) * 2 + 1),
            "x1": F.array_min(xs), "x2": F.array_max(xs), "y1": F.array_min(ys), "y2": F.array_max(ys),
        }
    )
    point = F.struct("end_x", "end_y")
    out = ends.groupBy("image_id", "path_id").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.min_by(point, "cmd_idx").alias("s"), F.max_by(point, "cmd_idx").alias("e"),
        F.min_by("cmd_idx", F.struct("end_y", "end_x", "cmd_idx")).alias("top_left"),
    )
    near = (F.abs(F.col("s.end_x") - F.col("e.end_x")) < 1e-8) & (F.abs(F.col("s.end_y") - F.col("e.end_y")) < 1e-8)
    return out.select("image_id", "path_id", "x1", "y1", "x2", "y2", near.alias("is_closed"), "top_left")


def stroke_properties(points: DataFrame) -> DataFrame:
    """Position, tangent, normal and curvature along strokes (image_id, path_id,
    rn, y, x with rn counting from 0). Differences are central, one-sided at the
    ends; the ends copy the curvature of their neighbor."""
    key = ["image_id", "path_id"]
    buckets = SC.by_number("rn")
    sized = with_group_facts(points, key, {"n": F.count(F.lit(1))})
    near = SC.scan(sized, key, ["rn"], buckets, p=SC.previous_row("y", "x"), q=SC.following_row("y", "x"))
    dy = F.coalesce("q.y", "y") - F.coalesce("p.y", "y")
    dx = F.coalesce("q.x", "x") - F.coalesce("p.x", "x")
    length = F.greatest(F.sqrt(dy * dy + dx * dx), F.lit(1e-6))
    alone = F.col("n") < 2
    tangent = cut_lineage(
        near.select(
            *key, "rn", "y", "x", "n",
            F.when(alone, 0.0).otherwise(dy / length).alias("ty"), F.when(alone, 1.0).otherwise(dx / length).alias("tx"),
        )
    )
    bend = SC.scan(tangent, key, ["rn"], buckets, p=SC.previous_row("ty", "tx"), q=SC.following_row("ty", "tx"))
    by, bx = F.col("q.ty") - F.col("p.ty"), F.col("q.tx") - F.col("p.tx")
    inner = bend.withColumn("k", F.sqrt(by * by + bx * bx)).drop("p", "q")
    ends = SC.scan(cut_lineage(inner), key, ["rn"], buckets, p=SC.previous_row("k"), q=SC.following_row("k"))
    curvature = F.when(F.col("n") <= 2, 0.0).when(F.col("rn") == 0, F.col("q.k")).when(F.col("rn") == F.col("n") - 1, F.col("p.k")).otherwise(F.col("k"))
    return ends.select(
        *key, "rn",
        F.when(alone, 0.0).otherwise(F.col("rn") / (F.col("n") - 1)).alias("position"),
        "ty", "tx", (-F.col("tx")).alias("ny"), F.col("ty").alias("nx"), curvature.alias("curvature"),
    )
