"""Row predicates and the two ways of combining them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import time as Time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.functions.exprs import BUY, SELL, UNDEF, bbo_valid, finite, num, valid
from depthforge.operators.ordering import KEYS, ORDER, diff


def any_of(filters: Iterable[Column]) -> Column:
    """Rows that pass any filter; no filters pass all."""
    filters = list(filters)
    return reduce(lambda a, b: a | b, filters) if filters else F.lit(True)


def all_groups(*groups: Iterable[Column]) -> Column:
    """Rows that pass any filter of each group."""
    return reduce(lambda a, b: a & b, [any_of(g) for g in groups], F.lit(True))


def all_of(filters: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, list(filters), F.lit(True))


def trade_size(threshold: float, size: str = "trade_sz", side: str = "trade_side", bid: str = "bid_sz_0", ask: str = "ask_sz_0") -> Column:
    """Trades larger than ``threshold`` of the size they meet."""

    def large(depth: str) -> Column:
        d = num(F.col(depth))
        return F.when(d > 0, num(F.col(size)) / d > threshold)

    hit = F.when(F.col(side) == BUY, large(ask)).when(F.col(side) == SELL, large(bid))
    return F.coalesce(hit, F.lit(False))


def level_taken(bid: str = "bid_px_0", ask: str = "ask_px_0", eps: float = 1e-10, keys: Sequence[str] = KEYS, order: str = ORDER) -> Column:
    """Rows where the best bid or ask moved.  It looks at the previous row: use :func:`where_level`."""
    move = lambda c: F.coalesce(F.abs(diff(num(F.col(c)), keys, order)) > eps, F.lit(False))
    return move(bid) | move(ask)


def where_level(df: DataFrame, predicate: Column) -> DataFrame:
    """``df.where`` for predicates over neighbouring rows, which are computed before any row goes."""
    return df.withColumn("_keep", predicate).where("_keep").drop("_keep")


def tight_spread(ticks: int, bid: str = "bid_px_0", ask: str = "ask_px_0") -> Column:
    if ticks < 0:
        raise ValueError("the spread isn't negative")
    # difference as decimal: two integer prices may be further apart than a bigint holds
    return F.col(ask).cast("decimal(20,0)") - F.col(bid).cast("decimal(20,0)") == ticks


def _micros(at: str | Time) -> int:
    if not isinstance(at, Time):
        parts = [int(x) for x in at.split(":")]
        if len(parts) not in (2, 3):
            raise ValueError("a time is HH:MM or HH:MM:SS")
        at = Time(*parts)
    return ((at.hour * 60 + at.minute) * 60 + at.second) * 1_000_000 + at.microsecond


def micro_of_day(ts: Column, timezone: str | None = None) -> Column:
    local = F.from_utc_timestamp(ts.cast("timestamp"), timezone) if timezone else ts.cast("timestamp")
    return F.pmod(F.unix_micros(local), F.lit(86_400_000_000))


def intraday_time(start: str | Time, end: str | Time, ts: str = "ts_event", timezone: str | None = None, closed: str = "left") -> Column:
    """Rows whose local time of day is in the interval; one that ends before it starts runs past midnight."""
    if closed not in ("left", "right", "both", "none"):
        raise ValueError("closed is left, right, both or none")
    a, b, t = _micros(start), _micros(end), micro_of_day(F.col(ts), timezone)
    left = t >= a if closed in ("left", "both") else t > a
    right = t <= b if closed in ("right", "both") else t < b
    return left & right if a <= b else left | right


def valid_rows(target: str, features: Sequence[str]) -> Column:
    """A valid, uncrossed top, a target, and finite features."""
    ok = bbo_valid() & (F.col("ask_px_0") > F.col("bid_px_0")) & F.col(target).isNotNull()
    return F.coalesce(all_of([ok, *(finite(F.col(c)) for c in features)]), F.lit(False))


def valid_price(price: str, size: str | None = None, undefined: int = UNDEF) -> Column:
    ok = F.col(price).isNotNull() & (F.col(price) > 0) & (F.col(price) < undefined)
    return F.coalesce(ok & (F.col(size) > 0) if size else ok, F.lit(False))


def scaled_price(price: str, size: str | None = None, scale: float = 1e9) -> Column:
    return F.when(valid_price(price, size), num(F.col(price)) / scale)


def valid_size(size: str, price: str) -> Column:
    return F.when(valid_price(price, size), num(F.col(size)))


def is_value(column: str, value) -> Column:
    """Equality, or membership of a list; an empty list matches nothing."""
    if isinstance(value, (list, tuple, set)):
        return F.col(column).isin(*value) if value else F.lit(False)
    return F.col(column) == value


def depth_prices(df: DataFrame, depth: int) -> DataFrame:
    """(price): distinct valid prices of the first levels of both sides."""
    levels = [F.when(valid(F.col(f"{s}_px_{i}"), F.col(f"{s}_sz_{i}")), F.col(f"{s}_px_{i}")) for s in ("bid", "ask") for i in range(depth)]
    return df.select(F.explode(F.array(*levels)).alias("price")).dropna().distinct()


def depth_price_filter(events: DataFrame, book: DataFrame, depth: int, mode: str | None = "levels", price: str = "price") -> DataFrame:
    """Events at a visible price (``levels``), between the outermost ones (``range``), or all (None)."""
    if mode is None:
        return events
    if mode == "levels":
        return events.join(depth_prices(book, depth).withColumnRenamed("price", price), price, "left_semi").select(events.columns)
    if mode == "range":
        bounds = depth_prices(book, depth).agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
        return events.crossJoin(F.broadcast(bounds)).where(F.col(price).between(F.col("_lo"), F.col("_hi"))).select(events.columns)  # one row
    raise ValueError("mode is levels, range or None")
