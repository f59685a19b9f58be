"""Summaries of predictions, features and books."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.functions.exprs import num
from depthforge.operators.ordering import KEYS, ORDER
from depthforge.operators.scores import Score, evaluate


def value_ranges(values: DataFrame, column: str) -> Column:
    """The number of the range a value is in, ranges being cut at approximate quantiles that the driver fetches.

    The bounds are literals, so a plan that reads the ranges twice gets the same ones; null comes first, NaN last.
    """
    parts = max(2, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / parts for i in range(1, parts)]
    bounds = values.agg(F.percentile_approx(column, steps, 1000).alias("b")).first().b or []
    cuts = F.array(*(F.lit(b) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    return F.when(F.col(column).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda b: b < F.col(column))))


def ranked(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``df`` with the average rank of ``column`` from 1, without sorting all rows in one task; null has no rank.

    Distinct values are counted first, dealt into ranges of their quantiles, ranked inside each range and offset by
    the rows of the ranges before it.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.withColumn("_p", value_ranges(counts, "_v"))
    totals = placed.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = totals.select("_p", (F.sum("_t").over(W.orderBy("_p")) - F.col("_t")).alias("_before"))  # a row per range
    inside = F.sum("_n").over(W.partitionBy("_p").orderBy("_v"))
    ranks = placed.withColumn("_upto", inside).join(F.broadcast(before), "_p").select("_v", (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def decile_report(df: DataFrame, prediction: str, target: str, bins: int = 10) -> DataFrame:
    """Per bin of the average rank of predictions: rows, means of prediction, target and signed target.

    Rows are summed per distinct prediction first; ranks and bins are those of the sums, so rows are never joined.
    """
    p, y = num(F.col(prediction)), num(F.col(target))
    each = df.groupBy(p.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.count(y).alias("_ny"), F.sum(y).alias("_y"))
    placed = each.withColumn("_p", value_ranges(each, "_v"))
    totals = placed.groupBy("_p").agg(F.sum("_n").alias("_t"))
    every = W.orderBy("_p")
    before = totals.select("_p", (F.sum("_t").over(every) - F.col("_t")).alias("_before"), F.sum("_t").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_rows"))
    upto = F.sum("_n").over(W.partitionBy("_p").orderBy("_v"))
    rank = F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0
    decile = F.least(F.greatest(F.floor((rank - 1) * bins / F.col("_rows")), F.lit(0)), F.lit(bins - 1)).cast("int")
    ranked_sums = placed.withColumn("_upto", upto).join(F.broadcast(before), "_p")  # a row per range
    mean = lambda total, n: F.try_divide(F.sum(total), F.sum(n))
    known = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    return ranked_sums.groupBy(decile.alias("decile")).agg(
        F.sum("_n").alias("n"), mean(F.col("_v") * F.col("_n"), known).alias("mean_prediction"), mean("_y", "_ny").alias("mean_return"),
        mean(F.signum("_v") * F.col("_y"), F.when(F.col("_v").isNotNull(), F.col("_ny")).otherwise(0)).alias("mean_signed_return"),
    )


def interval_coverage(df: DataFrame, target: str, low: str, high: str) -> DataFrame:
    y, a, b = (num(F.col(c)) for c in (target, low, high))
    return df.agg(F.avg(((y >= a) & (y <= b)).cast("double")).alias("coverage"), F.avg(b - a).alias("mean_width"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, correlation) for each pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(F.corr(num(F.col(a)), num(F.col(b))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(cells))


def feature_scores(df: DataFrame, features: Sequence[str], target: str, score) -> DataFrame:
    """(feature, score), each feature taken as a prediction, best first; one wide aggregate."""
    scores: list[Score] = [score(target, f, f"s_{i}") for i, f in enumerate(features)]
    row = evaluate(df, scores)
    return row.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"s_{i}").alias("score")) for i, f in enumerate(features))))).orderBy(F.desc_nulls_first("score"), "feature")


def action_side_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action", "side").agg(F.count(F.lit(1)).alias("n"))


def cumulative(df: DataFrame, gain: str, norm: str, name: str = "cumulative", keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Gains so far over norms so far; 0 while there is no norm."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    g, n = F.sum(gain).over(w), F.sum(norm).over(w)
    return df.withColumn(name, F.when(n > 0, g / F.when(n > 0, n).otherwise(1.0)).otherwise(0.0))


def summary(df: DataFrame, flags: Sequence[str], medians: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(f"n_{c}") for c in flags), *(F.median(c).alias(f"median_{c}") for c in medians))
