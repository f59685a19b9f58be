"""Scalar expressions: IEEE arithmetic under ANSI mode and the order-book primitives.

All are plain ``Column`` functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: The price of an empty level.
UNDEF = 9223372036854775807
BUY, SELL = 0, 1

INF, NAN = float("inf"), float("nan")


def num(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def fdiv(a: Column, b: Column) -> Column:
    """a / b as floating point does it: infinities and NaN instead of an error; null stays null."""
    a, b = num(a), num(b)
    return F.when(b != 0, a / b).when(a.isNull() | b.isNull(), None).when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)


def flog(a: Column) -> Column:
    """Natural logarithm: -inf at 0 and NaN below, where Spark gives null."""
    a = num(a)
    return F.when(a > 0, F.log(a)).when(a == 0, -INF).when(a.isNotNull(), NAN)


def flog1p(a: Column) -> Column:
    a = num(a)
    return F.when(a > -1, F.log1p(a)).when(a == -1, -INF).when(a.isNotNull(), NAN)


def fsqrt(a: Column) -> Column:
    return F.sqrt(num(a))


def finite(a: Column) -> Column:
    """Null for null, else whether neither infinite nor NaN."""
    a = num(a)
    return ~F.isnan(a) & (F.abs(a) != INF)


# ---------------------------------------------------------------- book


def px(side: str, i: int) -> Column:
    return F.col(f"{side}_px_{i}")


def sz(side: str, i: int) -> Column:
    return num(F.col(f"{side}_sz_{i}"))


def valid(price: Column, size: Column) -> Column:
    """A level that holds something; the empty price is tested on integers."""
    return (price != UNDEF) & (size > 0)


def bbo_valid() -> Column:
    return F.coalesce(valid(px("bid", 0), sz("bid", 0)) & valid(px("ask", 0), sz("ask", 0)), F.lit(False))


def mid() -> Column:
    """Half of both prices; each is cast first, as two empty prices overflow."""
    return (num(px("bid", 0)) + num(px("ask", 0))) / 2.0


def bbo_volume() -> Column:
    return 0.5 * (F.coalesce(sz("bid", 0), F.lit(0.0)) + F.coalesce(sz("ask", 0), F.lit(0.0)))


def log_mid_return(w: WindowSpec) -> Column:
    """log(mid / previous row's mid); null where either has no valid top."""
    m = F.when(bbo_valid(), mid())
    return flog(fdiv(m, F.lag(m).over(w)))


def spread_bps() -> Column:
    return F.when(bbo_valid() & (mid() > 0), (num(px("ask", 0)) - num(px("bid", 0))) / mid() * 1e4)


def balance(left: Column, right: Column, log: bool = False, eps: float = 1e-12) -> Column:
    """Log ratio, or difference over sum, of two sides that aren't negative.

    Their sums with eps are positive, so logarithm and division need no special cases; expressions stay small
    enough to be compiled.
    """
    return F.log(left + eps) - F.log(right + eps) if log else F.try_divide(left - right, left + right + eps)


# ---------------------------------------------------------------- static features


def _weighted_depth(side: str, depth: int) -> Column:
    """Sizes over their distance from the mid in half spreads."""
    half = (num(px("ask", 0)) - num(px("bid", 0))) / 2.0
    total = F.lit(0.0)
    for i in range(depth):
        gap = mid() - num(px(side, i)) if side == "bid" else num(px(side, i)) - mid()
        ok = valid(px(side, i), sz(side, i)) & (half > 0) & (gap > 0)
        total = total + F.when(ok, sz(side, i) / (gap / half)).otherwise(0.0)
    return total


def book_imbalance(depth: int, log: bool = False, eps: float = 1e-12) -> Column:
    return balance(_weighted_depth("bid", depth), _weighted_depth("ask", depth), log, eps)


def average_price(side: str, depth: int, total_size: float) -> Column:
    """Average price of taking ``total_size`` level by level; what is there if less; null if nothing is."""
    size = float(total_size)
    before, qty, cost = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in range(depth):
        there = F.when(valid(px(side, i), sz(side, i)), sz(side, i)).otherwise(0.0)
        take = F.least(there, F.greatest(F.lit(size) - before, F.lit(0.0)))
        before, qty, cost = before + there, qty + take, cost + take * F.when(there > 0, num(px(side, i))).otherwise(0.0)
    return F.try_divide(cost, qty)  # null where nothing is taken


def size_weighted_price_gap(depth: int, total_size: float, log: bool = False, eps: float = 1e-12) -> Column:
    return 2.0 * balance(average_price("ask", depth, total_size), average_price("bid", depth, total_size), log, eps) * 1e4


def size_weighted_price(depth: int, total_size: float) -> Column:
    """Mean of both sides' average prices against the mid, in log basis points."""
    both = average_price("bid", depth, total_size) + average_price("ask", depth, total_size)
    return F.log(F.try_divide(both, num(px("bid", 0)) + num(px("ask", 0)))) * 1e4


# ---------------------------------------------------------------- flows


def is_trade() -> Column:
    return F.coalesce(F.col("trade_side").isin(BUY, SELL) & (F.coalesce(num(F.col("trade_sz")), F.lit(0.0)) > 0), F.lit(False))


def trade_sign() -> Column:
    return F.when(F.col("trade_side").isin(BUY, SELL), 1.0 - 2.0 * num(F.col("trade_side")))


def signed_trade(mode: str) -> Column:
    if mode not in ("side", "volume"):
        raise ValueError("trade correlation mode is side or volume")
    return trade_sign() if mode == "side" else trade_sign() * flog1p(F.col("trade_sz"))


def _unit(x: Column, unit: bool) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0) if unit else x


def trade_flow(side: int, unit: bool = False) -> Column:
    return F.when(F.col("trade_side") == side, F.lit(1.0) if unit else num(F.col("trade_sz"))).otherwise(0.0)


def _top_change(side: str, w: WindowSpec):
    p, s = px(side, 0), F.coalesce(sz(side, 0), F.lit(0.0))
    p0, s0 = F.lag(p).over(w), F.coalesce(F.lag(s).over(w), F.lit(0.0))
    now, then = F.coalesce(valid(p, s), F.lit(False)), F.coalesce(valid(p0, s0), F.lit(False))
    return p, s, p0, s0, now, then


def push_flow(side: str, w: WindowSpec, unit: bool = False) -> Column:
    """Size that joins or betters the best level, outside of trade rows."""
    p, s, p0, s0, now, then = _top_change(side, w)
    better = p > p0 if side == "bid" else p < p0
    event = F.when(~is_trade() & now & then & better, s).when(~is_trade() & now & then & (p == p0) & (s > s0), s - s0).otherwise(0.0)
    return _unit(event, unit)


def pull_flow(side: str, w: WindowSpec, unit: bool = False) -> Column:
    """Size that leaves the best level, outside of trade rows."""
    p, s, p0, s0, now, then = _top_change(side, w)
    worse = p < p0 if side == "bid" else p > p0
    gone = then & (~now | F.coalesce(worse, F.lit(False)))
    event = F.when(~is_trade() & gone, s0).when(~is_trade() & then & (p == p0) & (s < s0), s0 - s).otherwise(0.0)
    return _unit(event, unit)


def flows(mode: str, w: WindowSpec, unit: bool = False) -> tuple[Column, Column]:
    """(buying, selling) flow of a mode; asks pulled are buying."""
    if mode == "trade":
        return trade_flow(BUY, unit), trade_flow(SELL, unit)
    if mode == "push":
        return push_flow("bid", w, unit), push_flow("ask", w, unit)
    if mode == "pull":
        return pull_flow("ask", w, unit), pull_flow("bid", w, unit)
    raise ValueError("momentum mode is trade, push or pull")


def combine_flows(buy: Column, sell: Column, combine: str = "diff", log: bool = False, eps: float = 1e-12) -> Column:
    if combine == "diff":
        return balance(1.0 + buy, 1.0 + sell, log, eps)
    if combine == "sum":
        return F.log((1.0 + buy) * (1.0 + sell) + eps) if log else buy + sell
    raise ValueError("momentum combine is diff or sum")
