"""Spans of regular expressions as native columns: where every match starts and ends."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Running sums of array<int>. Every round adds to each entry the sum of as many entries
    before it as it covers itself, so n entries take about log2(n) rounds of one array each."""
    shifts = F.transform(
        F.sequence(F.lit(0), F.length(F.bin(F.size(numbers).cast("long"))) - 1),
        lambda k: F.call_function("shiftleft", F.lit(1), k),
    )
    return F.aggregate(
        shifts,
        numbers,
        lambda sums, by: F.transform(
            sums, lambda x, i: F.when(i >= by, x + F.get(sums, i - by)).otherwise(x)
        ),
    )


def matches(text: Column, pattern: str, wanted: Column | None = None) -> Column:
    """array<struct<s, e, hit>> of the leftmost non-overlapping matches in order.

    Offsets count code points, the end is exclusive. The text between the matches comes
    from a split by the same pattern, so starts are running sums of gap and match
    lengths; time grows with n log n of the n matches. Rows where ``wanted`` is not true
    give an empty array without a search.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.filter(
        F.zip_with(gaps, hits, lambda gap, hit: F.struct((F.length(gap) + F.length(hit)).alias("n"), hit.alias("hit"))),
        lambda x: x["hit"].isNotNull(),
    )
    found = bind(
        steps,
        lambda st: F.zip_with(
            running_sums(F.transform(st, lambda x: x["n"])),
            st,
            lambda e, x: F.struct((e - F.length(x["hit"])).alias("s"), e.alias("e"), x["hit"].alias("hit")),
        ),
    )
    empty = F.expr("cast(array() as array<struct<s:int,e:int,hit:string>>)")
    some = text.rlike(pattern)
    return F.when(some if wanted is None else wanted & some, found).otherwise(empty)


def pieces(text: Column, size: int) -> Column:
    """The text cut into pieces of ``size`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def text_before(cut: Column, size: int, start: Column, chars: int) -> Column:
    """Up to ``chars`` (at most ``size``) code points before ``start`` of a text cut by ``pieces``:
    two pieces are read, however long the text is."""
    first = F.greatest(F.floor(start / size).cast("int") - 1, F.lit(0))
    near = F.concat(F.get(cut, first), F.coalesce(F.get(cut, first + 1), F.lit("")))
    at = start - first * size
    return F.substring(near, F.greatest(at + 1 - chars, F.lit(1)), F.least(at, F.lit(chars)))


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<.., kind, s, e>> in the order of the array, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def count_kind(spans: str, kind: str) -> Column:
    """Number of spans of one kind, as column n_<kind>."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
