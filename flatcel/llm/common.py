"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flatcel.session import ship_package

# Largest small side that is broadcast, in rows; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; Python workers get this package with it."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if counting shows that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def shard_share(id_col: str, shares: int = 1 << 20) -> Column:
    """A fixed pseudo-random share in [0, shares) for each id."""
    return F.pmod(F.xxhash64(F.lit(77), F.col(id_col)), F.lit(shares))


def bounded_sample(labelled: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` of the labelled rows at most, chosen by a hash of the id.

    The rows are counted first; with no more than ``max_rows`` all of them stay."""
    n = labelled.count()
    if n <= max_rows:
        return labelled
    shares = 1 << 20
    return labelled.where(shard_share(id_col, shares) < int(shares * max_rows / n))
