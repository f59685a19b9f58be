"""Set, join and dedup operators over dated frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.operators.ordering import ORDER
from depthforge.operators.reports import value_ranges


def dedup_last(df: DataFrame, keys: Sequence[str], order: str = ORDER) -> DataFrame:
    """The last row of each key; a pre-aggregated maximum, not a sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*keys, *(F.col(f"_last.`{c}`").alias(c) for c in rest)).select(df.columns)


def group_last_time(df: DataFrame, keys: Sequence[str], time: str = "ts_ns") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(time).alias(f"max_{time}"))


def with_group_max(df: DataFrame, keys: Sequence[str], time: str = "ts_ns", name: str = "max_ts_ns") -> DataFrame:
    return df.withColumn(name, F.max(time).over(W.partitionBy(*keys)))


def union_same(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """By name; types widen, missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefix_columns(df: DataFrame, prefix: str, keys: Sequence[str], sep: str = "_") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{sep}{c}" for c in df.columns if c not in keys})


def join_products(frames: dict[str, DataFrame], on: Sequence[str], dedup_order: str | None = ORDER, fill: bool = True, partition: Sequence[str] = (), sep: str = "_") -> DataFrame:
    """Full outer join of products' frames on ``on``, columns prefixed, gaps filled forward in the order of ``on``.

    ``partition``: those of ``on`` within which values are carried (the date); without any, one order runs over all
    rows, which are filled range by range of the first of ``on``, see :func:`fill_all`.
    """
    on = list(on)
    ready = [prefix_columns(dedup_last(f, on, dedup_order) if dedup_order else f, p, on, sep) for p, f in frames.items()]
    out = reduce(lambda a, b: a.join(b, on=on, how="full"), ready)
    if fill:
        order = [c for c in on if c not in partition]
        if not partition:
            return fill_all(out, order)
        w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.select(*on, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in out.columns if c not in on))
    return out


def fill_all(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with gaps filled forward in one order over all rows, without sorting them in one task.

    Rows are dealt into ranges of the first of ``order``, filled inside each, and what is then still empty gets the
    last value of the ranges before: one small row per range.
    """
    rest = [c for c in df.columns if c not in order]
    placed = df.withColumn("_range", value_ranges(df, order[0]))
    key = F.struct(*order)
    lasts = placed.groupBy("_range").agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.struct(c)), F.when(F.col(c).isNotNull(), key)).alias(c) for c in rest))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    carried = lasts.select(F.col("_range").alias("_r"), *(F.last(c, ignorenulls=True).over(before)[c].alias(f"_before_{c}") for c in rest))
    w = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = placed.select("_range", *order, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in rest))
    return filled.join(F.broadcast(carried), F.col("_range") == F.col("_r")).select(*order, *(F.coalesce(c, f"_before_{c}").alias(c) for c in rest))


def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has."""
    return [c for c in columns if c in df.columns]
