"""Ordered scans over groups of any size.

A window over ``partitionBy(key)`` drags a whole group through one task. The
scans here cut every group into buckets of the sort key instead: each bucket is
reduced to one summary row, the summaries (up to 65536 times fewer) carry
state from bucket to bucket, and the rows only ever meet the other rows of
their own bucket. A group holding a third of the table is spread like any other.

Buckets are plain expressions of the row (``frame_nr div 65536``), so that a
recomputed task after an executor loss lands on the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 65536


@dataclass(frozen=True)
class Carry:
    """One scan output: what to remember, in which direction."""

    kind: str  # "sum" | "max" | "last" | "next"
    value: Column
    inclusive: bool


def running_sum(value: Column, inclusive: bool = True) -> Carry:
    return Carry("sum", value, inclusive)


def running_count(inclusive: bool = True) -> Carry:
    return Carry("sum", F.lit(1).cast("bigint"), inclusive)


def running_max(value: Column, inclusive: bool = True) -> Carry:
    return Carry("max", value, inclusive)


def last_value(value: Column, inclusive: bool = True) -> Carry:
    """Latest non-null value at or before (``inclusive``) the row."""
    return Carry("last", value, inclusive)


def next_value(value: Column, inclusive: bool = True) -> Carry:
    """Earliest non-null value at or after (``inclusive``) the row."""
    return Carry("next", value, inclusive)


def previous_row(*cols: str | Column) -> Carry:
    """Struct of the row just before (nulls in the columns are kept)."""
    return Carry("last", F.struct(*cols), False)


def following_row(*cols: str | Column) -> Carry:
    return Carry("next", F.struct(*cols), False)


def _window_value(carry: Carry, value: Column, window) -> Column:
    if carry.kind == "next":
        start = 0 if carry.inclusive else 1
        frame = window.rowsBetween(start, Window.unboundedFollowing)
        return F.first(value, ignorenulls=True).over(frame)
    end = 0 if carry.inclusive else -1
    frame = window.rowsBetween(Window.unboundedPreceding, end)
    if carry.kind == "sum":
        return F.coalesce(F.sum(value).over(frame), F.lit(0))
    if carry.kind == "max":
        return F.max(value).over(frame)
    return F.last(value, ignorenulls=True).over(frame)


def _summary(carry: Carry, order: Sequence[str]) -> Column:
    if carry.kind == "sum":
        return F.sum(carry.value)
    if carry.kind == "max":
        return F.max(carry.value)
    at = F.when(carry.value.isNotNull(), F.struct(*order))
    return (F.max_by if carry.kind == "last" else F.min_by)(carry.value, at)


def _combine(carry: Carry, local: Column, carried: Column) -> Column:
    if carry.kind == "sum":
        return local + F.coalesce(carried, F.lit(0))
    if carry.kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: Sequence[dict[str, Column]],
    **outputs: Carry,
) -> DataFrame:
    """Add one column per ``outputs`` entry.

    ``order`` must be a total order inside ``keys``. ``buckets`` goes from fine
    to coarse; each level is a dict of columns that do not decrease along
    ``order`` (the coarser ones are written in terms of the finer ones' names).
    With no level left the remaining rows are few and one window finishes.
    """
    if not buckets:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns(
            {name: _window_value(c, c.value, window) for name, c in outputs.items()}
        )
    fine = {f"__b_{name}": expr for name, expr in buckets[0].items()}
    bucketed = df.withColumns(fine)
    group = [*keys, *fine]
    summary = bucketed.groupBy(*group).agg(
        *[_summary(c, order).alias(f"__s_{name}") for name, c in outputs.items()]
    )
    upper = {
        f"__c_{name}": Carry(c.kind, F.col(f"__s_{name}"), False)
        for name, c in outputs.items()
    }
    coarser = [
        {name: expr for name, expr in level.items()} for level in buckets[1:]
    ]
    carried = scan(summary, keys, list(fine), coarser, **upper).select(*group, *upper)
    window = Window.partitionBy(*group).orderBy(*order)
    # The window deals rows out by ``group`` anyway, so a join by sorting costs no further shuffle of
    # them; with few rows to a bucket the summaries are too many for a broadcast.
    joined = bucketed.join(carried.hint("merge"), group)
    return joined.withColumns(
        {
            name: _combine(c, _window_value(c, c.value, window), F.col(f"__c_{name}"))
            for name, c in outputs.items()
        }
    ).drop(*fine, *upper)


def by_number(column: str, rows: int = BUCKET_ROWS) -> list[dict[str, Column]]:
    """Buckets over an integer sort column."""
    return [{column: F.floor(F.col(column) / rows)}]


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: Sequence[dict[str, Column]],
    name: str = "pos",
) -> DataFrame:
    """Zero-based position of each row in its group."""
    return scan(df, keys, order, buckets, **{name: running_count(inclusive=False)})
