"""Bounded views of long series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.operators.ordering import KEYS, ORDER


def stride(df: DataFrame, every: int, order: str = ORDER) -> DataFrame:
    return df.where(F.col(order) % every == 0)


def rows_between(df: DataFrame, start: int, end: int, order: str = ORDER) -> DataFrame:
    return df.where((F.col(order) >= start) & (F.col(order) < end))


def over_budget(df: DataFrame, budget: int) -> DataFrame:
    """(over): whether ``df`` has more than ``budget`` rows; stops reading there."""
    return df.limit(budget + 1).agg((F.count(F.lit(1)) > budget).alias("over"))


def sample_smallest(df: DataFrame, n: int, seed: int = 0, order: str = ORDER) -> DataFrame:
    """n rows of the smallest hashed keys: the same rows however the input is dealt out."""
    return df.orderBy(F.xxhash64(F.col(order), F.lit(seed)), order).limit(n)


def positions(df: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    w = W.partitionBy(*keys)
    return df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))


def uniform(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Rows at n evenly spaced positions of each series, both ends included; shorter series whole.

    A row at position i of m is taken if some floor(k * (m - 1) / (n - 1)) is i.
    """
    m = F.col("_n") - 1
    k = F.ceil(F.col("_i") * (n - 1) / F.greatest(m, F.lit(1)))
    hit = (k <= n - 1) & (F.floor(k * m / F.lit(n - 1)) == F.col("_i")) if n > 1 else F.col("_i") == 0
    return positions(df, keys, order).where((F.col("_n") <= n) | hit).drop("_i", "_n")


def level_changes(df: DataFrame, value: str, n: int | None = None, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Rows where a step series changes, and its ends; of more than n, the first and the last of n - 1 runs of the others.

    Run k of m rows ends at position floor(k * (m / (n - 1))) of them, in floating point; a budget of one is the last row.
    """
    w = W.partitionBy(*keys).orderBy(order)
    spot = positions(df, keys, order).withColumn("_was", F.lag(value).over(w))
    kept = spot.where((F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_was", "_i", "_n")
    if n is None:
        return kept
    spot, last = positions(kept, keys, order), F.col("_i") == F.col("_n") - 1
    if n > 1:
        width = (F.col("_n") - 1) / F.lit(float(n - 1))
        near = F.round(F.col("_i") / width)
        ends = F.array(near - 1, near, near + 1)
        hit = (F.col("_i") == 0) | last | F.exists(ends, lambda k: (k > 0) & (k < n - 1) & (F.floor(k * width) == F.col("_i")))
    else:
        hit = last
    return spot.where((F.col("_n") <= n) | hit).drop("_i", "_n")


def relative_ns(df: DataFrame, time: str = "ts_ns", name: str = "x_ns") -> DataFrame:
    first = df.agg(F.min(time).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn(name, F.col(time) - F.col("_first")).drop("_first")  # one row


def display_time(ts: Column, timezone: str, form: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), timezone), form)


def shuffled_dates(dates: Sequence[str], seed: int = 0, sizes: dict[str, int] | None = None, buckets: int = 4) -> list[str]:
    """Dates in a seeded order; with sizes, those of the largest quarter (``buckets``) first."""
    import random

    rng = random.Random(seed)
    mixed = sorted(dates)
    rng.shuffle(mixed)
    if not sizes:
        return mixed
    rank = {d: i * buckets // len(mixed) for i, d in enumerate(sorted(mixed, key=lambda d: -sizes.get(d, 0)))}
    return sorted(mixed, key=lambda d: rank[d])


def shuffled_rows(df: DataFrame, window: int, seed: int = 0, order: str = ORDER) -> DataFrame:
    """Rows mixed within runs of ``window`` rows, the runs in order; the same rows in the same order for a seed."""
    return df.orderBy(F.floor(F.col(order) / window), F.xxhash64(F.col(order), F.lit(seed)), order)
