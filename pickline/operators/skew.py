"""Joining rows with one statistic per key when a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.session import cut

#: A key with more rows than this is hot. Of R rows at most R / HOT_ROWS keys can be hot, so the
#: broadcast of hot keys holds at most 100,000 narrow rows per 100 billion rows of input.
HOT_ROWS = 1_000_000
#: Largest table of narrow rows that may be broadcast, after its rows were counted.
BROADCAST_ROWS = 1_000_000
_SALTS = 4096


def attach(
    fact: DataFrame,
    stats: DataFrame,
    key: str,
    size: str,
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    keep: bool = False,
) -> DataFrame:
    """Join ``fact`` with ``stats``, one row per ``key`` aggregated from ``fact``.

    ``size`` names the column of ``stats`` with the key's row count. The statistics are written
    once and counted. Few of them are broadcast and ``fact`` stays where it is. Otherwise only
    those of hot keys are broadcast; the rows of a hot key have found their partner then, so they
    are salted and spread in the shuffle that serves the rest. ``keep`` keeps rows without statistics.
    """
    stats = cut(stats)
    if stats.count() <= broadcast_rows:
        return fact.join(F.broadcast(stats), key, "left" if keep else "inner")
    values = [c for c in stats.columns if c != key]
    hot = stats.filter(F.col(size) > hot_rows).select(key, F.struct(*values).alias("_hot"))
    cold = stats.filter(F.col(size) <= hot_rows).select(
        key, F.struct(*values).alias("_cold"), F.lit(0).alias("_salt")
    )
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(*fact.columns), F.lit(_SALTS)).cast("int") + 1
    )
    found = F.coalesce("_hot", "_cold")
    return (
        fact.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", salt)
        .join(cold, [key, "_salt"], "left")
        .withColumn("_found", found)
        .filter(F.lit(True) if keep else F.col("_found").isNotNull())
        .select(*fact.columns, *[F.col(f"_found.{c}").alias(c) for c in values])
    )


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a counted size within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def slots_of(count: Column, hot_rows: int = HOT_ROWS) -> Column:
    """How many salted copies a key with ``count`` rows is spread over."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(hot_rows))).cast("int")
