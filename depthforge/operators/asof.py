"""Backward as-of values and forward returns.

The value as of t + h is the value of the last row (by time, then row order) at or before t + h; null when the
group ends before t + h.  It is one growing window frame per horizon, ``max`` of (time, row, value) from the start
of the group to t + h: each row enters once, and all horizons share one shuffle and one sort.
A row is picked whatever its value, so a null there stays null.

Labels deal a group's rows out by spans of time, twice the longest horizon wide.  The row as of t + h isn't before the
row itself, so it is in the same span or in the first half of the next, whose rows come a second time for that.  A
group may hold all rows: no window holds more than a span and a half.  Ends of groups are an aggregate that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.functions.durations import horizon_ns
from depthforge.functions.exprs import fdiv, num, size_weighted_price
from depthforge.operators.ordering import KEYS, ORDER


def _last_until(value: Column, ahead_ns: int, keys: Sequence[str], time: str, order: str) -> Column:
    frame = W.partitionBy(*keys).orderBy(time).rangeBetween(W.unboundedPreceding, ahead_ns)
    return F.max(F.struct(F.col(time).alias("t"), F.col(order).alias("r"), value.alias("v"))).over(frame)["v"]


def asof_backward(value: Column, ahead_ns: int, keys: Sequence[str] = KEYS, time: str = "ts_ns", order: str = ORDER) -> Column:
    """The value as of ``ahead_ns`` after each row as a column; a group of ``keys`` is one window, see :func:`add_future_price` for large ones."""
    end = F.max(time).over(W.partitionBy(*keys))
    return F.when(F.col(time) + ahead_ns <= end, _last_until(value, ahead_ns, keys, time, order))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], order: str = ORDER) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its keys at or before its time: both sides in one pass of one window."""
    cols = left.columns
    payload = F.struct(F.col(right_time).alias("t"), F.col(order).alias("r"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(order).cast("bigint").alias("_o"), payload.alias("_found"))
    probe = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_o"), F.struct(*cols).alias("_row"))
    both = probe.unionByName(r, allowMissingColumns=True)
    seen = F.last("_found", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("_seen", seen).where("_side = 1").select("_row.*", *(F.col(f"_seen.v{i}").alias(v) for i, v in enumerate(values)))


def weighted_horizons(horizons: Sequence[str] | str, weights: Sequence[float] | float) -> list[tuple[int, float]]:
    hs = [horizons] if isinstance(horizons, str) else list(horizons)
    ws = [float(weights)] * len(hs) if isinstance(weights, (int, float)) else [float(w) for w in weights]
    if len(hs) != len(ws):
        raise ValueError("as many weights as horizons")
    return [(horizon_ns(h), w) for h, w in zip(hs, ws, strict=True)]


def add_future_price(df: DataFrame, price: Column, horizons, weights=1.0, name: str = "future_price", keys: Sequence[str] = KEYS, time: str = "ts_ns", order: str = ORDER) -> DataFrame:
    """Weighted mean of the price as of each horizon; a null in any makes it null; no horizons: unchanged."""
    pairs = weighted_horizons(horizons, weights)
    if not pairs:
        return df
    pairs = [(h, w) for h, w in pairs if w]
    total = sum(w for _, w in pairs)
    if not pairs or not total:
        raise ValueError("the weights must not add up to zero")
    keys = [k for k in keys if k in df.columns]
    tail = "_" * max(len(c) for c in df.columns)  # longer than any column
    value, home, span, end = (f"_{x}{tail}" for x in ("value", "home", "span", "end"))
    ends = df.groupBy(*(F.col(k).alias(f"_key{i}{tail}") for i, k in enumerate(keys))).agg(F.max(time).alias(end))
    alike = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}{tail}")) for i, k in enumerate(keys)), F.lit(True))
    ahead = max(h for h, _ in pairs)
    width = max(2 * ahead, 1)
    into = F.pmod(F.col(time), F.lit(width))
    dealt = df.withColumns({value: num(price), home: F.col(time) - into}).join(F.broadcast(ends), alike)
    dealt = dealt.withColumn(span, F.explode(F.when(into < ahead, F.array(F.col(home), F.col(home) - width)).otherwise(F.array(home))))
    terms = [F.when(F.col(time) + h <= F.col(end), _last_until(F.col(value), h, [*keys, span], time, order)) * w for h, w in pairs]
    out = dealt.withColumn(value, reduce(lambda a, b: a + b, terms) / total).where(F.col(span).eqNullSafe(F.col(home)))
    return out.select(*df.columns, F.col(value)).withColumn(name, F.col(value)).drop(value)


def add_return(df: DataFrame, price: Column, horizons, weights=1.0, name: str = "return_bps", keys: Sequence[str] = KEYS, time: str = "ts_ns", order: str = ORDER) -> DataFrame:
    """(future price / price - 1) in basis points."""
    if not weighted_horizons(horizons, weights):
        return df
    tail = "_" * max(len(c) for c in df.columns)
    now, future = f"_now{tail}", f"_future{tail}"
    out = add_future_price(df.withColumn(now, price), F.col(now), horizons, weights, future, keys, time, order)
    return out.withColumn(name, (fdiv(F.col(future), F.col(now)) - 1.0) * 1e4).drop(now, future)


def add_future_executable_price(df: DataFrame, depth: int, total_size: float, horizons, weights=1.0, name: str = "future_executable_price", **at) -> DataFrame:
    return add_future_price(df, size_weighted_price(depth, total_size), horizons, weights, name, **at)


def add_executable_return(df: DataFrame, depth: int, total_size: float, horizons, weights=1.0, name: str = "executable_return_bps", **at) -> DataFrame:
    """The ratio of the executable price's log offsets, as defined, not of prices."""
    return add_return(df, size_weighted_price(depth, total_size), horizons, weights, name, **at)
