"""Frame sequences: alignment, sampling, chunking, packing, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flatcel.functions.arrays import seeded_number, seeded_text
from flatcel.functions.color import NULL_COLOR, rgba_to_dense
from flatcel.operators import scan as SC
from flatcel.operators.skew import join_lookup, with_group_facts
from flatcel.session import cut_lineage

KINDS = ("seg", "color", "line")


def align_frames(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of a scene present as seg, color and line image.

    ``files``: scene, kind, frame_idx, seq; of several files with one number the
    first counts. One aggregation replaces the three-way join. Scenes sharing
    fewer than two frames are errors: the second table names them.
    """
    seqs = {k: F.min(F.when(F.col("kind") == k, F.col("seq"))).alias(f"{k}_seq") for k in KINDS}
    by_number = files.groupBy("scene", "frame_idx").agg(*seqs.values())
    shared = by_number.where(" and ".join(f"{k}_seq is not null" for k in KINDS))
    counts = by_number.groupBy("scene").agg(
        F.count_if(F.col("seg_seq").isNotNull() & F.col("color_seq").isNotNull() & F.col("line_seq").isNotNull()).alias("n")
    )
    errors = counts.where("n < 2").select(
        "scene", F.when(F.col("n") == 0, "NO_SHARED_FRAMES").otherwise("ONE_SHARED_FRAME").alias("error")
    )
    bad = errors.select("scene", F.lit(True).alias("__bad"))
    return join_lookup(shared, bad, ["scene"]).where("__bad is null").drop("__bad"), errors


def filter_empty(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop frames without data (``is_empty``, ``is_corrupt``) and count them
    per scene and kind."""
    stats = frames.groupBy("scene", "kind").agg(
        F.count_if("is_empty").alias("num_empty"),
        F.count_if(F.col("is_empty") & F.col("is_corrupt")).alias("num_corrupt"),
    )
    return frames.where(~F.col("is_empty")), stats


def drop_repeats(frames: DataFrame) -> DataFrame:
    """Frames whose line image differs from the raw frame before (``hash``)."""
    rows = SC.scan(
        frames, ["project_id"], ["frame_idx"], SC.by_number("frame_idx"), __prev=SC.previous_row("hash")
    )
    keep = F.col("__prev").isNull() | ~F.col("hash").eqNullSafe(F.col("__prev.hash"))
    return rows.where(keep).select(*frames.columns)


def numbered_frames(frames: DataFrame) -> DataFrame:
    return SC.numbered(frames, ["project_id"], ["frame_idx"], SC.by_number("frame_idx"))


def chunk(frames: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Overlapping chunks of a sequence: chunk number and place in it."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the chunk size")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step))
    last = F.floor(F.col("pos") / step)
    return (
        numbered_frames(frames)
        .select("*", F.explode(F.sequence(first, last)).alias("chunk"))
        .withColumn("chunk_pos", F.col("pos") - F.col("chunk") * step)
        .drop("pos")
    )


def take(frames: DataFrame, picks: DataFrame) -> DataFrame:
    """Frames at the given positions (project_id, pick, pos), repeats allowed."""
    return picks.join(numbered_frames(frames), ["project_id", "pos"])


def reverse(frames: DataFrame) -> DataFrame:
    """Position of each frame in the reversed sequence."""
    descending = frames.withColumn("__neg", -F.col("frame_idx"))
    return SC.numbered(descending, ["project_id"], ["__neg"], SC.by_number("__neg")).drop("__neg")


def frame_combos(frames: DataFrame, length: int, max_dist: Column | int) -> DataFrame:
    """Ordered tuples of ``length`` distinct frames that are pairwise within
    ``max_dist``. Bands of that width give every join an equi key."""
    dist = F.lit(max_dist) if isinstance(max_dist, int) else max_dist
    base = frames.select("project_id", "frame_idx", dist.alias("__d")).withColumn(
        "__band", F.floor(F.col("frame_idx") / F.col("__d"))
    )
    out = base.withColumnsRenamed({"frame_idx": "f1"})
    for k in range(2, length + 1):
        nxt = base.select("project_id", "__band", F.col("frame_idx").alias(f"f{k}"))
        near = out.withColumn("__b", F.explode(F.array(*[F.col("__band") + i for i in (-1, 0, 1)])))
        condition = F.lit(True)
        for j in range(1, k):
            gap = F.abs(F.col(f"f{j}") - F.col(f"f{k}"))
            condition = condition & (gap <= F.col("__d")) & (gap > 0)
        out = (
            near.join(nxt.withColumnRenamed("__band", "__b"), ["project_id", "__b"]).where(condition).drop("__b")
        )
    return out.select("project_id", F.array(*[F.col(f"f{k}") for k in range(1, length + 1)]).alias("frames"))


def sample_subsequences(
    frames: DataFrame,
    length: int,
    max_dist: int,
    max_subseqs: int | None = None,
    min_subseqs: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Sub-sequences of a sequence, thinned to ``max_subseqs`` at random and
    filled up to ``min_subseqs`` by repeating random ones.

    Lengths run from 1 to ``length``, except that 2 stands alone. Sequences
    under five frames ignore the distance, shorter ones than ``length`` give
    nothing. The random order is a seeded hash of the tuple; the row limit is
    pushed below the shuffle by the planner, so no task sees a whole project.
    """
    sized = with_group_facts(frames, ["project_id"], {"__frames": F.count(F.lit(1))}).where(
        F.col("__frames") >= length
    )
    dist = F.when(F.col("__frames") < 5, 10000).otherwise(max_dist)
    sizes = [2] if length == 2 else list(range(1, length + 1))
    combos = None
    for n in sizes:
        some = frame_combos(sized, n, dist)
        combos = some if combos is None else combos.unionByName(some)
    order = seeded_text(seed, F.array_join("frames", ","))
    ranked = combos.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("project_id").orderBy(order, "frames"))
    )
    out = combos
    if max_subseqs is not None:
        out = ranked.where(F.col("__rank") <= max_subseqs).drop("__rank")
    if min_subseqs is not None:
        kept = cut_lineage(out)
        few = (
            kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < min_subseqs)
        )
        # Projects with fewer than min_subseqs rows: small groups by definition.
        short = kept.join(few, "project_id").withColumn(
            "__rank", F.row_number().over(Window.partitionBy("project_id").orderBy(order, "frames"))
        )
        picks = few.select(
            "project_id", "__n", F.explode(F.sequence(F.lit(1), min_subseqs - F.col("__n"))).alias("__j")
        ).select(
            "project_id",
            (seeded_number(seed + 1, "project_id", "__j") % F.col("__n") + 1).cast("int").alias("__rank"),
        )
        extra = picks.join(short.drop("__n"), ["project_id", "__rank"]).select("project_id", "frames")
        out = kept.unionByName(extra)
    return out


def _choose(n: Column, k: Column) -> Column:
    """Binomial coefficient; every partial product is divided exactly."""
    one = F.lit(1).cast("bigint")
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, one, lambda acc, t: F.call_function("div", acc * (n - t + 1), t))


def _subset(index: Column, among: Column, size: Column) -> Column:
    """The subset of ``size`` numbers in [0, among) with this place in the order of subsets by their
    greatest number, then the next one and so on: each number is the greatest whose subsets all fit."""
    start = F.struct(index.alias("q"), F.expr("cast(array() as array<int>)").alias("chosen"))

    def step(state: Column, k: Column) -> Column:
        above = F.when(among > k, F.sequence(k, among - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        number = k - 1 + F.size(F.filter(above, lambda x: _choose(x, k) <= state["q"]))
        return F.struct(
            (state["q"] - _choose(number, k)).alias("q"),
            F.concat(state["chosen"], F.array(number)).alias("chosen"),
        )

    steps = F.when(size > 0, F.sequence(size, F.lit(1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, start, step, lambda s: s["chosen"])


def _arranged(index: Column, values: Column) -> Column:
    """The permutation of sorted ``values`` with this place in lexicographic order."""
    start = F.struct(index.alias("p"), values.alias("rest"), F.slice(values, 1, 0).alias("out"))

    def step(state: Column, left: Column) -> Column:
        block = F.factorial(left)
        place = F.call_function("div", state["p"], block).cast("int")
        return F.struct(
            F.pmod(state["p"], block).alias("p"),
            F.filter(state["rest"], lambda _, i: i != place).alias("rest"),
            F.concat(state["out"], F.array(F.get(state["rest"], place))).alias("out"),
        )

    return F.aggregate(F.sequence(F.size(values) - 1, F.lit(0)), start, step, lambda s: s["out"])


def _followers(frames: DataFrame, max_dist: int) -> DataFrame:
    """``frames`` plus ``followers``, the frames after each one within the distance.

    Windows run over bands of frame numbers, each with the first frames of the next band; the
    numbers of a project are distinct, so a band is bounded. Projects under five frames are one band."""
    width = max(max_dist, SC.BUCKET_ROWS)
    number, small = F.col("frame_idx"), F.col("__frames") < 5
    own = F.when(small, 0).otherwise(F.floor(number / width)).cast("bigint")
    early = ~small & (number - own * width < max_dist)
    bands = frames.withColumn("__own", own).withColumn(
        "__band", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own)))
    )
    window = Window.partitionBy("project_id", "__band").orderBy("frame_idx")
    near = sum((F.coalesce(F.lead("frame_idx", k).over(window) - number <= 10000, F.lit(False)).cast("int") for k in (1, 2, 3)), F.lit(0))
    within = F.count(F.lit(1)).over(window.rangeBetween(1, max_dist)).cast("int")
    return (
        bands.withColumn("followers", F.when(small, near).otherwise(within))
        .where(F.col("__band") == F.col("__own"))
        .drop("__band", "__own")
    )


def draw_subsequences(
    frames: DataFrame, length: int, max_dist: int, max_subseqs: int, min_subseqs: int = 0, seed: int = 0
) -> DataFrame:
    """The sample of ``sample_subsequences`` without listing the tuples it is drawn from.

    Tuples are ranked by length, smallest frame, set (greatest frame first) and arrangement. A
    frame with c followers is the smallest of n! * C(c, n - 1) tuples of length n, so running sums
    say which ranks are its own. The ranks of a project are cut into ``max_subseqs`` equal parts and
    one rank is drawn in each; only drawn ranks are turned into tuples. A project with fewer tuples
    gives them all, and then repeats, drawn at random, up to ``min_subseqs``. Work follows frames
    plus drawn tuples, whatever the distance.

    Returns (project_id, draw, frames); ``draw`` counts from 0. Lengths, and the distance of short
    sequences, are those of ``sample_subsequences``. Repeated frame numbers count once; rows without
    project or number are left out. More tuples in a project than a long holds are an error.
    """
    if not 0 < max_subseqs >= min_subseqs:
        raise ValueError("max_subseqs must be positive and no smaller than min_subseqs")
    distinct = frames.select("project_id", "frame_idx").dropna().distinct()
    sized = with_group_facts(distinct, ["project_id"], {"__frames": F.count(F.lit(1))}).where(F.col("__frames") >= length)
    base = cut_lineage(numbered_frames(_followers(sized, max_dist)).drop("__frames"))

    sizes = [2] if length == 2 else list(range(1, length + 1))
    n, c = F.col("n"), F.col("followers")
    weighted = (
        base.withColumn("n", F.explode(F.array(*[F.lit(k) for k in sizes])))
        .where(c >= n - 1)
        .withColumn("__tuples", _choose(c, n - 1) * F.factorial(n))
    )
    ranked = SC.scan(
        with_group_facts(weighted, ["project_id"], {"__total": F.sum("__tuples")}),
        ["project_id"],
        ["n", "frame_idx"],
        [{"n": n, "frame_idx": F.floor(F.col("frame_idx") / SC.BUCKET_ROWS)}],
        __end=SC.running_sum(F.col("__tuples")),
    ).withColumn("__start", F.col("__end") - F.col("__tuples"))

    total, wide = F.col("__total"), "decimal(19,0)"
    parts = F.least(F.lit(max_subseqs).cast("bigint"), total)
    div = lambda a, b: F.call_function("div", a, b).cast("bigint")
    part_of = lambda rank: div((rank + 1).cast(wide) * parts.cast(wide) - 1, total.cast(wide))
    start_of = lambda j: div(j.cast(wide) * total.cast(wide), parts.cast(wide))
    chance = lambda k: F.conv(F.substring(seeded_text(k, "project_id", "draw"), 1, 15), 16, 10).cast("bigint")
    j = F.col("draw")
    repeats = F.when(parts < min_subseqs, F.sequence(parts, F.lit(min_subseqs - 1).cast("bigint"))).otherwise(
        F.expr("cast(array() as array<bigint>)")
    )
    rank = F.when(j < parts, start_of(j) + chance(seed) % F.greatest(start_of(j + 1) - start_of(j), F.lit(1))).otherwise(
        chance(seed + 1) % total
    )
    drawn = (
        ranked.withColumn("draw", F.explode(F.concat(F.sequence(part_of(F.col("__start")), part_of(F.col("__end") - 1)), repeats)))
        .withColumn("__rank", rank)
        .where((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end")))
        .withColumn("__rank", F.col("__rank") - F.col("__start"))
    )
    later = _subset(div(F.col("__rank"), F.factorial(n)), c, n - 1)
    places = F.concat(F.array(F.col("pos")), F.transform(later, lambda x: F.col("pos") + 1 + x))
    return (
        drawn.select("project_id", "draw", F.pmod("__rank", F.factorial(n)).alias("__order"), F.explode(places).alias("pos"))
        .join(base.select("project_id", "pos", "frame_idx"), ["project_id", "pos"])
        .groupBy("project_id", "draw", "__order")
        .agg(F.sort_array(F.collect_list("frame_idx")).alias("__set"))  # at most ``length`` frames
        .select("project_id", "draw", _arranged(F.col("__order"), F.col("__set")).alias("frames"))
    )


def random_palette(palette: DataFrame, seed: int) -> DataFrame:
    """Palette with seeded random opaque colors."""
    byte = [seeded_number(seed, F.lit(k), "project_id", "color_id") % 256 for k in range(3)]
    return palette.withColumn("color", rgba_to_dense(*byte, F.lit(255)))


def shuffle(rows: DataFrame, seed: int, key: str = "project_id", pos: str = "pos") -> DataFrame:
    """Seeded random new position (``shuffled``) of each row of a group."""
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), pos))
    return SC.numbered(
        hashed, [key], ["__h", pos], [{"h": F.shiftright(F.col("__h"), 48)}], "shuffled"
    ).drop("__h")


def unshuffle(shuffled: DataFrame, rows: DataFrame, key: str = "project_id", pos: str = "pos") -> DataFrame:
    """Bring rows numbered by ``shuffled`` back to their first positions."""
    return rows.join(shuffled.select(key, pos, "shuffled"), [key, "shuffled"]).drop("shuffled")


# --- packing -----------------------------------------------------------------

SMALL_GROUP = 4096


def pack(items: DataFrame, capacity: int, small_group: int = SMALL_GROUP) -> DataFrame:
    """Greedy next-fit packing of ordered items (image_id, item, length) into
    rows of ``capacity``: row number, start and end slot of each item.

    An item never reopens an earlier row. Images of ordinary size are folded as
    one short array; images with more than ``small_group`` items go through
    ``_pack_large``, which gives the same rows without gathering an image.
    Items longer than the capacity are errors.
    """
    checked = items.select(
        "image_id",
        "item",
        F.when(
            F.col("length") > capacity, F.raise_error(F.lit(f"an item is longer than the capacity {capacity}"))
        ).otherwise(F.col("length")).cast("long").alias("length"),
    )
    sizes = items.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n"))
    large = cut_lineage(sizes.where(F.col("__n") > small_group).select("image_id"))
    if large.isEmpty():
        return _pack_small(checked, capacity)
    # At most rows / small_group images are large.
    marked = checked.join(large.withColumn("__large", F.lit(True)), "image_id", "left")
    small = _pack_small(marked.where("__large is null").drop("__large"), capacity)
    return small.unionByName(_pack_large(marked.where("__large").drop("__large"), capacity))


def _pack_small(items: DataFrame, capacity: int) -> DataFrame:
    ordered = items.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("s"))

    def place(state: Column, it: Column) -> Column:
        new = state["end"] + it["length"] > capacity
        start = F.when(new, F.lit(0)).otherwise(state["end"]).cast("long")
        row = F.when(new, state["row"] + 1).otherwise(state["row"]).cast("long")
        placed = F.struct(it["item"].alias("item"), row.alias("row_nr"), start.alias("start"), (start + it["length"]).alias("end"))
        return F.struct(row.alias("row"), (start + it["length"]).alias("end"), F.concat(state["out"], F.array(placed)).alias("out"))

    item_type = dict(items.dtypes)["item"]
    empty = F.array().cast(f"array<struct<item:{item_type},row_nr:bigint,start:bigint,end:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("end"), empty.alias("out"))
    return ordered.select("image_id", F.explode(F.aggregate("s", zero, place)["out"]).alias("p")).select(
        "image_id", "p.item", "p.row_nr", "p.start", "p.end"
    )


def _pack_large(items: DataFrame, capacity: int, max_rounds: int = 60) -> DataFrame:
    """Next-fit by pointer doubling.

    If a row starts at item i, the next one starts at the first item that no
    longer fits. These jumps are known for every item from running lengths; the
    true row starts are the items reached from the first one, found by doubling
    the jump length each round.
    """
    summed = cut_lineage(
        SC.scan(
            items, ["image_id"], ["item"], SC.by_number("item"),
            before=SC.running_sum(F.col("length"), inclusive=False), pos=SC.running_count(inclusive=False),
        )
    )
    # First item whose end exceeds before + capacity: ask at that offset.
    offers = summed.select(
        "image_id", (F.col("before") + F.col("length")).alias("at"), F.lit(1).alias("kind"),
        F.col("pos"), F.lit(None).cast("long").alias("asker"),
    )
    asks = summed.select(
        "image_id", (F.col("before") + capacity).alias("at"), F.lit(2).alias("kind"),
        F.lit(-1).cast("long").alias("pos"), F.col("pos").alias("asker"),
    )
    found = SC.scan(
        offers.unionByName(asks),
        ["image_id"],
        ["at", "kind", "pos", "asker"],
        SC.by_number("at"),
        nxt=SC.next_value(F.when(F.col("kind") == 1, F.struct("at", "pos")), inclusive=False),
    ).where("kind = 2")
    jumps = cut_lineage(found.select("image_id", F.col("asker").alias("pos"), F.col("nxt.pos").alias("nxt")))
    reached = cut_lineage(jumps.groupBy("image_id").agg(F.min("pos").alias("pos")))
    for _ in range(max_rounds):
        ahead = reached.join(jumps, ["image_id", "pos"]).where("nxt is not null").select("image_id", F.col("nxt").alias("pos"))
        fresh = cut_lineage(ahead.join(reached, ["image_id", "pos"], "left_anti"))
        if fresh.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(fresh))
        doubled = jumps.select("image_id", F.col("pos").alias("nxt"), F.col("nxt").alias("__nxt"))
        jumps = cut_lineage(
            jumps.where("nxt is not null").join(doubled, ["image_id", "nxt"]).select(
                "image_id", "pos", F.col("__nxt").alias("nxt")
            )
        )
    else:
        raise RuntimeError("row starts did not settle")
    starts = SC.numbered(reached, ["image_id"], ["pos"], SC.by_number("pos"), "row_nr")
    rows = summed.join(starts, ["image_id", "pos"], "left")
    opened = SC.scan(
        rows, ["image_id"], ["pos"], SC.by_number("pos"),
        open=SC.last_value(F.when(F.col("row_nr").isNotNull(), F.struct("row_nr", "before"))),
    )
    start = F.col("before") - F.col("open.before")
    return opened.select(
        "image_id", "item", F.col("open.row_nr").alias("row_nr"), start.alias("start"), (start + F.col("length")).alias("end")
    )


def pack_values(values: DataFrame, packed: DataFrame) -> DataFrame:
    """Lay out the values of each item (image_id, item, values array)."""
    return (
        values.join(packed, ["image_id", "item"])
        .select("image_id", "row_nr", "start", F.posexplode("values").alias("__k", "value"))
        .select("image_id", "row_nr", (F.col("start") + F.col("__k")).alias("slot"), "value")
    )


def unpack_values(slots: DataFrame, packed: DataFrame) -> DataFrame:
    """Values back to (image_id, item, place in the item)."""
    places = packed.where(F.col("end") > F.col("start")).select(
        "image_id", "item", "row_nr", "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("slot")
    )
    return slots.join(places, ["image_id", "row_nr", "slot"]).select(
        "image_id", "item", (F.col("slot") - F.col("start")).alias("place"), "value"
    )


def block_mask(packed: DataFrame) -> DataFrame:
    """Block-diagonal attention mask, one row per slot: the slots [lo, hi) of the
    same row it may see. (The dense mask is these spans written out.)"""
    full = packed.where(F.col("end") > F.col("start"))
    return full.select(
        "image_id",
        "row_nr",
        F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("slot"),
        F.col("start").alias("lo"),
        F.col("end").alias("hi"),
    )


def pad_array(values: Column, size: Column) -> Column:
    return F.concat(values, F.array_repeat(F.lit(NULL_COLOR), (size - F.size(values)).cast("int")))


def collate(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Pad the array columns of a batch (``key``) to its longest with -100."""
    facts = {f"__max_{c}": F.max(F.size(c)) for c in columns}
    sized = with_group_facts(df, [key], facts)
    return sized.select(
        *[c for c in df.columns if c not in columns], *[pad_array(F.col(c), F.col(f"__max_{c}")).alias(c) for c in columns]
    )


def pad_to_bucket(df: DataFrame, column: str, bucket: int) -> DataFrame:
    """Pad to a fixed size; longer arrays are an error."""
    values = F.col(column)
    refuse = F.raise_error(F.lit(f"{column} exceeds the bucket of {bucket}")).cast("array<int>")
    return df.withColumn(
        column, F.when(F.size(values) > bucket, refuse).otherwise(pad_array(values, F.lit(bucket)))
    )


def pack_pair(ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """Reference and target segments of a pair in one gapless sequence, the
    reference first, with the attention length of the pair."""
    both = ref.select("pair_id", F.lit(0).alias("part"), "seg_id", "color_id").unionByName(
        tgt.select("pair_id", F.lit(1).alias("part"), "seg_id", "color_id")
    )
    sized = with_group_facts(both, ["pair_id"], {"attn_length": F.count(F.lit(1))})
    return SC.numbered(
        sized, ["pair_id"], ["part", "seg_id"],
        [{"p": F.col("part"), "s": F.floor(F.col("seg_id") / SC.BUCKET_ROWS)}], "slot",
    )


def scan_corpus(files: DataFrame, ref_frame: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Reference and target frames of each corpus (corpus, name).

    Names look like ``lineLayer1_f12_...``. Frame ``ref_frame``, by default the
    first color frame, is the reference and needs a line and a color image; all
    other line frames are targets.
    Returns (corpus, frame_nr, role, line_name, color_name) and the corpora
    without a usable reference.
    """
    pattern = r"^(lineLayer|colorLayer)[0-9]*_f([0-9]+)_.*\.png$"
    named = files.select(
        "corpus",
        "name",
        F.regexp_extract("name", pattern, 1).alias("__layer"),
        F.nullif(F.regexp_extract("name", pattern, 2), F.lit("")).cast("int").alias("frame_nr"),
    ).where("frame_nr is not null")
    is_line = F.col("__layer") == "lineLayer"
    by_number = named.groupBy("corpus", "frame_nr").agg(
        F.max(F.when(is_line, F.col("name"))).alias("line_name"),
        F.max(F.when(~is_line, F.col("name"))).alias("color_name"),
    )
    colored = F.col("color_name").isNotNull()
    asked = colored if ref_frame is None else colored & (F.col("frame_nr") == ref_frame)
    first = by_number.groupBy("corpus").agg(
        F.min(F.when(asked, F.struct("frame_nr", F.col("line_name").isNotNull().alias("ok")))).alias("r"),
        F.bool_or(colored).alias("any_color"),
    )
    errors = first.where("r is null or not r.ok").select(
        "corpus",
        F.when(~F.col("any_color"), "NO_COLOR")
        .when(F.col("r").isNull(), "REFERENCE_WITHOUT_COLOR")
        .otherwise("REFERENCE_WITHOUT_LINE")
        .alias("error"),
    )
    refs = first.where("r.ok").select("corpus", F.col("r.frame_nr").alias("__ref"))
    frames = join_lookup(by_number, refs, ["corpus"], "inner").where("line_name is not null").select(
        "corpus",
        "frame_nr",
        F.when(F.col("frame_nr") == F.col("__ref"), "reference").otherwise("target").alias("role"),
        "line_name",
        F.when(F.col("frame_nr") == F.col("__ref"), F.col("color_name")).alias("color_name"),
    )
    return frames, errors
