"""Joining one row per key to many rows when some keys hold a large share of them.

The keys with most rows, a constant number of them, are served by broadcast. Their rows are
marked on the way and then spread over all tasks of the join that serves the others, so the
many rows are read once, and no task gathers a large key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# This many keys per shuffle partition are served by broadcast. A key that holds more than
# one in (HOT_SHARE x partitions) of all rows is always among them.
HOT_SHARE = 4
SPREAD = 1 << 20


def hot_limit(df: DataFrame) -> int:
    return HOT_SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def largest_keys(stats: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """The rows of ``stats`` (one per key) with the greatest ``count``: a constant number."""
    return stats.orderBy(F.desc(count), *keys).limit(hot_limit(stats))


def with_group_facts(df: DataFrame, keys: Sequence[str], facts: dict[str, Column]) -> DataFrame:
    """``df`` plus aggregates of its own groups (``facts``), keys may be null."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in facts.items()])
    return join_unique(df, stats, keys, "__n").drop("__n")


def join_unique(df: DataFrame, stats: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """Null-safe inner or left join with a table of one row per key. ``count`` names its column
    with the number of rows per key in ``df``."""
    return _join(df, largest_keys(stats, keys, count), stats, keys, how)


def join_lookup(
    df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Inner or left join with a table of one row per key whose share of ``df`` is not known:
    the rows per key are counted first. Null keys match only if ``null_safe``."""
    if not null_safe:
        for k in keys:
            table = table.where(F.col(k).isNotNull())
    top = largest_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), keys, "__rows").drop("__rows")
    # One row per key, so both sides of this join are as few as the keys of ``top``.
    found = table.join(F.broadcast(_renamed(top, keys)), _same(keys), "left_semi")
    facts = [c for c in table.columns if c not in keys]
    hot = top.join(F.broadcast(_renamed(found.withColumn("__there", F.lit(True)), keys)), _same(keys), "left")
    if how == "inner":
        hot = hot.where("__there")
    return _join(df, hot.select(*keys, *facts), table, keys, how)


def _renamed(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"__k_{k}" for k in keys})


def _same(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return condition


def _join(df: DataFrame, hot: DataFrame, table: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``hot``: rows of ``table`` to broadcast, or rows of nulls for keys known to be absent."""
    facts = [c for c in table.columns if c not in keys]
    few = hot.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__h_{c}") for c in facts], F.lit(True).alias("__hot")
    )
    rest = table.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__c_{c}") for c in facts],
        F.lit(0).alias("__at"), F.lit(True).alias("__cold"),
    )
    marked = df.join(F.broadcast(few), _same(keys), "left").drop(*[f"__k_{k}" for k in keys])
    spread = F.pmod(F.xxhash64(*_hashable(df)), F.lit(SPREAD)).cast("int") + 1
    marked = marked.withColumn("__spread", F.when(F.col("__hot"), spread).otherwise(0))
    both = marked.join(rest, _same(keys) & (F.col("__spread") == F.col("__at")), "left")
    if how == "inner":
        both = both.where("__hot or __cold")
    return both.select(*df.columns, *[F.coalesce(f"__h_{c}", f"__c_{c}").alias(c) for c in facts])


def _hashable(df: DataFrame) -> list[str]:
    """Columns that tell rows of one key apart, without the bulky ones where others are left."""
    plain = [f.name for f in df.schema if not f.dataType.typeName() in ("binary", "map", "array", "struct", "variant")]
    return plain or [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
