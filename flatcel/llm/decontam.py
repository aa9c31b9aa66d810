"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Test items are cut into windows of consecutive words. Document frequencies of all test
terms over the training texts tell the rarest two terms of every window. The index
stores the postings (term, document, position) of these leading terms; those of a
rarest term carry the words around them. A window occurs where the offset-adjusted
lists of its two leading terms meet at one start, and the words around agree with the
whole window. Work follows the lengths of the rarest lists, not those of common words.
A window is near where the two lists meet within a few words and every word of the window
stands at most ``slop`` words from its place.

Small sides (test terms, windows) are broadcast after their rows are counted, and
joined by shuffle beyond ``common.BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.llm.common import small_side
from flatcel.session import cut_lineage

WINDOW = 10
# Words by which a word may stand from its place in a near match.
SLOP = 2
# A word: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words in order, case as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def folded(word: Column) -> Column:
    """``word`` with A-Z lower-cased, other letters as they are."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, win, words) for each window; an item of fewer words is one window."""
    words = items.select(
        F.col(id_col).alias("item_id"), F.transform(raw_words(F.col(text_col)), folded).alias("all")
    ).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return (
        words.select("item_id", "all", F.explode(starts).alias("i"))
        .select("item_id", F.slice("all", F.col("i"), F.lit(window)).alias("words"))
        .select("item_id", F.xxhash64(F.concat_ws(" ", "words")).alias("win"), "words")
        .distinct()
    )


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, text): a row is known by its id and a hash of its text, so null or repeated ids
    do not mix texts."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))


def document_frequency(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each of ``terms`` (term) over all texts."""
    return (
        texts.select(F.explode(raw_words(F.col("text"))).alias("raw"))
        .select(folded(F.col("raw")).alias("term"))
        .join(small_side(terms), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lead_terms(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(win, words, t1, o1, t2, o2): the rarest two terms of each distinct window and their
    offsets; windows with a term that no text holds are left out. t2 is null for one word."""
    ranked = (
        windows.select("win", "words")
        .distinct()
        .select("win", "words", F.posexplode("words").alias("o", "term"))
        .join(small_side(frequency), "term", "left")
        .groupBy("win", "words")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "term"))).alias("r"))
    )
    return ranked.where(F.col("r")[0]["n"] > 0).select(
        "win",
        "words",
        F.col("r")[0]["term"].alias("t1"),
        F.col("r")[0]["o"].alias("o1"),
        F.get("r", F.lit(1))["term"].alias("t2"),
        F.get("r", F.lit(1))["o"].alias("o2"),
    )


def postings(texts: DataFrame, leads: DataFrame, reach: int = WINDOW) -> DataFrame:
    """The index (term, id, k, pos, around) of the leading terms. ``around`` holds the words from
    ``reach - 1`` before to ``reach - 1`` after the posting of a rarest term, joined by
    blanks, else null. (Generated code cuts them out; a higher-order function here would
    copy the whole text once per posting.)"""
    terms = (
        leads.select(
            F.explode(
                F.array(
                    F.struct(F.col("t1").alias("term"), F.lit(1).alias("rarest")),
                    F.struct(F.col("t2").alias("term"), F.lit(0).alias("rarest")),
                )
            ).alias("x")
        )
        .select("x.term", "x.rarest")
        .where("term is not null")
        .groupBy("term")
        .agg(F.max("rarest").alias("rarest"))
    )
    first = F.greatest(F.col("pos") - (reach - 1), F.lit(0))
    return (
        texts.select("id", "k", raw_words(F.col("text")).alias("all"))
        .select("id", "k", "all", F.posexplode("all").alias("pos", "raw"))
        .select("id", "k", "all", "pos", folded(F.col("raw")).alias("term"))
        .join(small_side(terms), "term")
        .select(
            "term",
            "id",
            "k",
            "pos",
            F.when(
                F.col("rarest") == 1,
                folded(F.concat_ws(" ", F.slice("all", first + 1, F.col("pos") - first + reach))),
            ).alias("around"),
        )
    )


def _starts(index: DataFrame, leads: DataFrame, term: str, offset: str, *more: str) -> DataFrame:
    """Offset-adjusted list: where each window would start by this one of its terms."""
    side = small_side(leads.where(F.col(term).isNotNull()).select(F.col(term).alias("term"), offset, "win", *more))
    return index.join(side, "term").select(
        "id", "k", "win", (F.col("pos") - F.col(offset)).alias("start"), *[c for c in index.columns if c == "around"],
        *[F.col(c) for c in (offset, *more)],
    )


def phrase_matches(index: DataFrame, leads: DataFrame, reach: int = WINDOW) -> DataFrame:
    """(id, k, win, start, n): every exact occurrence of a window, n words from word ``start``."""
    rare = _starts(index.where("around is not null"), leads, "t1", "o1", "words", "t2").where("start >= 0")
    second = _starts(index.drop("around"), leads, "t2", "o2").select(
        F.col("id").alias("id2"), F.col("k").alias("k2"), F.col("win").alias("win2"), F.col("start").alias("start2")
    )
    same = (
        F.col("id").eqNullSafe(F.col("id2"))
        & (F.col("k") == F.col("k2"))
        & (F.col("win") == F.col("win2"))
        & (F.col("start") == F.col("start2"))
    )
    met = rare.where("t2 is not null").join(second, same, "left_semi").unionByName(rare.where("t2 is null"))
    # The posting stands at index least(pos, reach - 1) of ``around``.
    at = F.least(F.col("start") + F.col("o1"), F.lit(reach - 1)) - F.col("o1")
    return met.where(F.slice(F.split("around", " "), F.greatest(at + 1, F.lit(1)), F.size("words")) == F.col("words")).select(
        "id", "k", "win", "start", F.size("words").alias("n")
    )


def proximity_matches(index: DataFrame, leads: DataFrame, slop: int) -> DataFrame:
    """(id, k, win, start, shift): the two leading terms of a window stand at most ``slop`` words
    nearer or farther than in the window; start follows from the rarest. Starts are binned by
    slop + 1 words, so the join stays an equi join of neighbouring bins."""
    width = slop + 1
    rare = _starts(index.where("around is not null").drop("around"), leads, "t1", "o1").withColumn(
        "bin", F.floor(F.col("start") / width)
    )
    second = _starts(index.drop("around"), leads, "t2", "o2").select(
        F.col("id").alias("id2"),
        F.col("k").alias("k2"),
        F.col("win").alias("win2"),
        F.col("start").alias("start2"),
        F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)])).alias("bin2"),
    )
    near = (
        F.col("id").eqNullSafe(F.col("id2"))
        & (F.col("k") == F.col("k2"))
        & (F.col("win") == F.col("win2"))
        & (F.col("bin") == F.col("bin2"))
        & (F.abs(F.col("start") - F.col("start2")) <= slop)
    )
    return rare.join(second, near).select(
        "id", "k", "win", "start", (F.col("start2") - F.col("start")).alias("shift")
    )


def _each_near_its_place(words: Column, around: Column, at: Column, slop: int) -> Column:
    """Whether some start, at most ``slop`` words from index ``at`` of ``around``, has every one of
    ``words`` at most ``slop`` words from its place."""

    def fits(shift: Column) -> Column:
        def close(word: Column, k: Column) -> Column:
            place = at + shift + k
            first = F.greatest(place - slop, F.lit(0))
            return F.array_contains(F.slice(around, first + 1, F.greatest(place + slop - first + 1, F.lit(0))), word)

        return F.forall(F.transform(words, close), lambda x: x)

    return F.exists(F.sequence(F.lit(-slop), F.lit(slop)), fits)


def near_matches(index: DataFrame, leads: DataFrame, slop: int = SLOP, reach: int = WINDOW + 2 * SLOP) -> DataFrame:
    """(id, k, win, start, n, exact): near matches of windows of n words. ``start`` follows from the
    posting of the rarest term; ``exact`` marks occurrences word by word.

    A window is near at s if each of its words, say the i-th from 0, stands at a word from
    s + i - slop to s + i + slop; s may lie before the text. A word may serve for
    two equal ones. The starts that two leading terms propose then differ by 2 slop at most,
    which the lists are met by; the words around settle the rest. The index must
    reach 2 slop words farther than the window.
    """
    rare = _starts(index.where("around is not null"), leads, "t1", "o1", "words", "t2")
    width = 2 * slop + 1
    second = _starts(index.drop("around"), leads, "t2", "o2").select(
        F.col("id").alias("id2"),
        F.col("k").alias("k2"),
        F.col("win").alias("win2"),
        F.col("start").alias("start2"),
        F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)])).alias("bin2"),
    )
    close = (
        F.col("id").eqNullSafe(F.col("id2"))
        & (F.col("k") == F.col("k2"))
        & (F.col("win") == F.col("win2"))
        & (F.floor(F.col("start") / width) == F.col("bin2"))
        & (F.abs(F.col("start") - F.col("start2")) <= 2 * slop)
    )
    met = rare.where("t2 is not null").join(second, close, "left_semi").unionByName(rare.where("t2 is null"))
    # The posting stands at index least(pos, reach - 1) of ``around``.
    cut = met.withColumn("a", F.split("around", " ")).withColumn(
        "at", F.least(F.col("start") + F.col("o1"), F.lit(reach - 1)) - F.col("o1")
    )
    same = F.slice("a", F.greatest(F.col("at") + 1, F.lit(1)), F.size("words")) == F.col("words")
    return (
        cut.where(F.size(F.array_except("words", "a")) == 0)
        .withColumn("exact", (F.col("start") >= 0) & same)
        .where(F.col("exact") | _each_near_its_place(F.col("words"), F.col("a"), F.col("at"), slop))
        .select("id", "k", "win", "start", F.size("words").alias("n"), "exact")
    )


def build_index(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows of the items, their leading terms, stored postings over ``docs``). ``reach``:
    how far the words around a posting go, by default as far as a window."""
    texts = keyed_texts(docs, id_col, text_col)
    windows = cut_lineage(item_windows(items, window))
    terms = windows.select(F.explode("words").alias("term")).distinct()
    frequency = cut_lineage(document_frequency(texts, terms))
    leads = cut_lineage(lead_terms(windows, frequency))
    return windows, leads, cut_lineage(postings(texts, leads, reach or window))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    slop: int = SLOP,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256) for every
    row of ``docs``.

    A word is hit inside any occurrence of an item window. ``n_near`` counts the items with a
    window that is near somewhere (``near_matches``), exact ones included; ``near_sha256`` is
    to them what ``items_sha256`` is to the items of exact occurrences. Null and empty texts have no
    words and no hits; items without words have no windows; an item of fewer words than
    a window is one window. Rows that repeat id and text get equal results, rows that
    share an id but not the text are judged apart, null ids stay. Null item ids are
    not listed. Other columns are not looked at; an empty table gives an empty result,
    no items give no hits.
    """
    reach = window + 2 * slop
    windows, leads, index = build_index(docs, items, window, id_col, text_col, reach)
    # Repeated rows bring repeated postings: one match each is enough.
    found = cut_lineage(near_matches(index, leads, slop, reach).distinct())
    hit = (
        found.where("exact").select("id", "k", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("w"))
        .distinct()
        .groupBy("id", "k")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    item = F.col("item_id").cast("string")  # at most all items in one row
    held = (
        found.groupBy("id", "k", "win")
        .agg(F.max("exact").alias("exact"))
        .join(small_side(windows.select("win", "item_id").distinct()), "win")
        .groupBy("id", "k")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("exact"), item))).alias("items"),
            F.sort_array(F.collect_set(item)).alias("near"),
        )
    )
    per_text = held.join(hit, hit["id"].eqNullSafe(held["id"]) & (hit["k"] == held["k"]), "left").select(
        held["id"].alias("id2"), held["k"].alias("k2"), "n_hit", "items", "near"
    )
    counted = keyed_texts(docs, id_col, text_col).select("id", "k", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    none = F.expr("cast(array() as array<string>)")
    items_of, near_of = F.coalesce("items", none), F.coalesce("near", none)
    return counted.join(
        per_text, counted["id"].eqNullSafe(per_text["id2"]) & (counted["k"] == per_text["k2"]), "left"
    ).select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.size(near_of).cast("long").alias("n_near"),
        F.sha2(F.array_join(near_of, ","), 256).alias("near_sha256"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without any occurrence of an item window, with all their columns."""
    windows, leads, index = build_index(docs, items, window, id_col, text_col)
    out = phrase_matches(index, leads, window).select(F.col("id").alias("__id"), F.col("k").alias("__k")).distinct()
    key = F.xxhash64(F.coalesce(text_col, F.lit("")))
    return docs.join(out, F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__k")), "left_anti")
