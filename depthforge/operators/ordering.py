"""Row order and time keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One book.
KEYS = ("publisher_id", "instrument_id")
ORDER = "row_nr"


def by_row(keys=KEYS, order: str = ORDER) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def so_far(keys=KEYS, order: str = ORDER) -> WindowSpec:
    return by_row(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def before(keys=KEYS, order: str = ORDER) -> WindowSpec:
    return by_row(keys, order).rowsBetween(W.unboundedPreceding, -1)


def ts_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def with_row_nr(df: DataFrame, name: str = ORDER) -> DataFrame:
    """The position of each row in its parquet file, from the reader; call it right after the read."""
    return df.withColumn(name, F.col("_metadata.row_index"))


def lag(x: Column, keys=KEYS, order: str = ORDER) -> Column:
    return F.lag(x).over(by_row(keys, order))


def diff(x: Column, keys=KEYS, order: str = ORDER) -> Column:
    """Change from the previous row; 0 at the first."""
    return F.coalesce(x - lag(x, keys, order), F.lit(0))


def forward_fill(x: Column, keys=KEYS, order: str = ORDER) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(keys, order))


def carry_forward(x: Column, keys=KEYS, order: str = ORDER) -> Column:
    """The last value that isn't null before the current row."""
    return F.last(x, ignorenulls=True).over(before(keys, order))


def average_rank(x: Column) -> Column:
    """Rank from 1, ties sharing their mean; global, so for aggregated or bounded inputs."""
    w = W.orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(x)) - 1) / 2.0
