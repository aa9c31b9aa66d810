"""Mixing sources to target weights: iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens. Raking scales the
cells until their token sums agree with the target shares of every source, language and
topic. A cell's factor is then the number of times each of its documents should be seen;
its whole part is taken, the rest is drawn by a hash of the document.

Only cell tables take part in the rounds. Their size is sources x languages x topics at
most, independent of the number of documents; they stay DataFrames, are joined by
equality and written to the shared checkpoint folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.session import cut_lineage, drop_written

TOPICS = 8
MARGINS = ("source", "lang", "topic")
# Target shares are token shares to this power (1: as they are, 0: all alike).
SMOOTHING = 0.7


def token_count(text: Column) -> Column:
    """Words between ASCII whitespace; 0 for null and empty."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]++"), F.lit(0))), F.lit(0))


_LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A coarse topic: the bucket of the greatest (in byte order) of the words of twelve and more
    letters; without one, of the greatest word; without words, of the empty one. Copies
    share it."""
    long_words = F.regexp_extract_all(text, F.lit(_LETTER + "{12,}+"), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(_LETTER + "++"), F.lit(0))
    word = F.coalesce(F.array_max(long_words), F.array_max(words), F.lit(""))
    return F.pmod(F.xxhash64(word), F.lit(topics)).cast("int")


def smoothed_targets(cells: DataFrame, margin: str, power: float = SMOOTHING) -> DataFrame:
    """(margin, share): token shares to ``power``, normalised."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    return sums.crossJoin(F.broadcast(total)).select(margin, (F.col("s") / F.col("t")).alias("share"))  # one row


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    tolerance: float = 1e-4,
    max_rounds: int = 40,
    check_every: int = 4,
) -> DataFrame:
    """``cells`` (margins.., tokens) with ``weight``: tokens scaled to the target shares.

    ``targets`` gives (margin, share) per margin. Shares of values that no cell has are
    spread over the others; a value without target keeps its tokens. Every ``check_every``
    rounds the cells are written, and the rounds end when no margin misses its target by
    more than ``tolerance`` of all tokens. Targets that contradict each other end after
    ``max_rounds`` with the last margin met."""
    state = cut_lineage(cells.withColumn("weight", F.col("tokens").cast("double")))
    total = state.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for m, t in targets.items():
        known = state.select(m).distinct().join(t.withColumnRenamed(m, "__v"), F.col(m).eqNullSafe(F.col("__v")), "left")
        known = known.select(F.col(m).alias("__v"), "share")
        goals[m] = cut_lineage(known)
        present = goals[m].agg(F.sum("share")).first()[0] or 1.0
        goals[m] = goals[m].select("__v", (F.col("share") / present * total).alias("__goal"))
    for k in range(max_rounds):
        now = state
        for m, goal in goals.items():
            sums = now.groupBy(F.col(m).alias("__k")).agg(F.sum("weight").alias("__sum"))
            factor = sums.join(goal, F.col("__k").eqNullSafe(F.col("__v"))).select(
                "__k", F.when(F.col("__sum") > 0, F.coalesce(F.col("__goal") / F.col("__sum"), F.lit(1.0))).alias("__f")
            )
            now = now.join(factor, F.col(m).eqNullSafe(F.col("__k"))).select(
                *[c for c in state.columns if c != "weight"], (F.col("weight") * F.coalesce("__f", F.lit(1.0))).alias("weight")
            )
        written = cut_lineage(now)
        drop_written(state)
        state = written
        if (k + 1) % check_every == 0 and _miss(state, goals) <= tolerance * max(total, 1):
            break
    return state


def _miss(state: DataFrame, goals: dict[str, DataFrame]) -> float:
    """The largest distance of a margin from its goal, in tokens."""
    worst = 0.0
    for m, goal in goals.items():
        sums = state.groupBy(F.col(m).alias("__k")).agg(F.sum("weight").alias("__sum"))
        off = sums.join(goal, F.col("__k").eqNullSafe(F.col("__v"))).agg(F.max(F.abs(F.col("__sum") - F.col("__goal"))))
        worst = max(worst, off.first()[0] or 0.0)
    return worst


def uniform(id_col: str, text_col: str, seed: int) -> Column:
    """A fixed number in [0, 1) for each row, from its id and text."""
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(text_col, F.lit("")))
    return F.pmod(h, F.lit(1 << 40)) / float(1 << 40)


def mix_sources(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = 1.0,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topics: int = TOPICS,
) -> DataFrame:
    """(id, source, lang, topic, tokens, weight, copies) for every row of ``docs``.

    ``weight`` is the expected, ``copies`` the drawn number of times a row is seen;
    ``budget`` scales the expected tokens of the mix against the tokens given. ``targets``
    maps source, lang or topic to (value, share); a missing margin takes the smoothed
    shares of the input. Null sources and languages are values of their own; a text
    without words has weight 1 and no part in the sums; rows that repeat id and text draw
    alike. Other columns are not looked at; an empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.col(lang_col).alias("lang"),
        topic_of(text, topics).alias("topic"),
        token_count(text).cast("long").alias("tokens"),
        uniform(id_col, text_col, seed).alias("draw"),
    )
    rows = cut_lineage(rows)
    cells = cut_lineage(rows.where("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    given = targets or {}
    goals = {m: given.get(m, smoothed_targets(cells, m)) for m in MARGINS}
    raked = rake(cells, goals)
    factors = raked.select(
        *[F.col(m).alias(f"__{m}") for m in MARGINS], (F.col("weight") / F.col("tokens") * budget).alias("factor")
    )
    same = [F.col(m).eqNullSafe(F.col(f"__{m}")) for m in MARGINS]
    weight = F.when(F.col("tokens") > 0, F.coalesce("factor", F.lit(0.0))).otherwise(1.0)
    whole = F.floor("weight")
    return (
        rows.join(factors, same[0] & same[1] & same[2], "left")
        .withColumn("weight", weight)
        .select(
            F.col("id").alias(id_col),
            "source",
            "lang",
            "topic",
            "tokens",
            "weight",
            (whole + (F.col("draw") < F.col("weight") - whole).cast("long")).alias("copies"),
        )
    )
