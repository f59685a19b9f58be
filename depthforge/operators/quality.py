"""Integrity checks of recorded days: statistics per file, then rules over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.operators.book import BAD_TS, LAST, MAYBE_BAD, SNAPSHOT

#: Segments of a UTC day: (name, from, to) in seconds.
SEGMENTS = (("gap_before", 0, 47_700), ("window", 47_700, 72_300), ("gap_after", 72_300, 86_400))


def regressions(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str = "row_nr") -> DataFrame:
    """Per key and column: steps backwards and, for sequences, jumps of more than one."""
    w = W.partitionBy(*keys).orderBy(order)
    steps = df.select(*keys, *((F.col(c) - F.lag(c).over(w)).alias(c) for c in columns))
    count = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    return steps.groupBy(*keys).agg(*(count(F.col(c) < 0).alias(f"{c}_regressions") for c in columns), *(count(F.col(c) > 1).alias(f"{c}_jumps") for c in columns))


def has(flag: int) -> Column:
    return F.col("flags").cast("int").bitwiseAND(flag) != 0


def flag_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), n(has(LAST)).alias("n_last"), n(has(SNAPSHOT)).alias("n_snapshot"), n(has(SNAPSHOT) & (F.col("action") == "R")).alias("n_snapshot_reset"),
        n(has(SNAPSHOT) & has(LAST)).alias("n_snapshot_last"), n(has(BAD_TS)).alias("n_bad_ts"), n(has(MAYBE_BAD)).alias("n_maybe_bad"),
    )


def bounds(df: DataFrame, keys: Sequence[str], time: str = "ts_ns", order: str = "row_nr") -> DataFrame:
    """Rows, first, last, smallest and largest time, and distinct times, null counting as one."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(time, order).alias("first"), F.max_by(time, order).alias("last"), F.min(time).alias("min"), F.max(time).alias("max"),
        (F.count_distinct(time) + F.max(F.col(time).isNull().cast("int"))).alias("n_unique"),
    )


def segment(time: str = "ts_ns") -> Column:
    second = F.pmod(F.floor(F.col(time) / 1_000_000_000), F.lit(86_400))
    out = F.lit(None).cast("string")
    for name, a, b in SEGMENTS:
        out = F.when((second >= a) & (second < b), name).otherwise(out)
    return out


def segment_bounds(df: DataFrame, keys: Sequence[str], time: str = "ts_ns") -> DataFrame:
    return df.groupBy(*keys, segment(time).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("min"), F.max(time).alias("max"))


def segment_overlaps(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, segment, overlaps) of :func:`segment_bounds` rows: whether a segment begins before an earlier one has ended."""
    earlier = W.partitionBy(*keys).orderBy("min", "max", "segment").rowsBetween(W.unboundedPreceding, -1)
    return segments.select(*keys, "segment", F.coalesce(F.col("min") <= F.max("max").over(earlier), F.lit(False)).alias("overlaps"))


def row_sums(segments: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_segments, n_whole, equal): rows of the segments against those of the whole days."""
    parts = segments.groupBy(*keys).agg(F.sum("n").alias("n_segments"))
    total = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_whole"))
    both = parts.join(total, list(keys), "full").na.fill(0, ["n_segments", "n_whole"])
    return both.withColumn("equal", F.col("n_segments") == F.col("n_whole"))


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that one frame lacks or has in another type or place; empty where schemas are equal."""
    one, two = ([(f.name, f.dataType.simpleString()) for f in x.schema.fields] for x in (a, b))
    places = {c: i for i, c in enumerate(two)}
    return sorted({n for n, _ in set(one) ^ set(two)} | {c[0] for i, c in enumerate(one) if places.get(c, i) != i})


def issues(stats: DataFrame, rules: Sequence[tuple[str, str, Column]], keys: Sequence[str]) -> DataFrame:
    """(keys, severity, rule) for each rule whose condition holds; rules are (severity, name, condition)."""
    found = F.array(*(F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"))) for severity, name, test in rules))
    return stats.select(*keys, F.inline(F.filter(found, lambda x: x.isNotNull())))


def exit_code(found: DataFrame, strict: bool = False) -> int:
    """1 if there are errors (strict: or warnings)."""
    return int(found.where(F.lit(True) if strict else F.col("severity") == "error").limit(1).count() > 0)
