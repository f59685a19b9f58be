"""Scores as mergeable aggregates.

A score is a set of additive sums and a value computed from them: sums run as partial and final hash aggregates,
several scores share one pass, and states of parts add up to the state of the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.functions.exprs import num


@dataclass(frozen=True)
class Score:
    name: str
    sums: Mapping[str, Column]
    value: Callable[[Callable[[str], Column]], Column]

    def states(self) -> list[Column]:
        return [F.coalesce(F.sum(c), F.lit(0)).alias(f"{self.name}__{k}") for k, c in self.sums.items()]

    def result(self) -> Column:
        return self.value(lambda k: F.col(f"{self.name}__{k}")).alias(self.name)


def state(df: DataFrame, scores: Sequence[Score], by: Sequence[str] = ()) -> DataFrame:
    """One row of sums, or one per group."""
    return df.groupBy(*by).agg(*(s for score in scores for s in score.states()))


def merge(states: DataFrame, scores: Sequence[Score], by: Sequence[str] = ()) -> DataFrame:
    """Sums of states, of whatever parts they come from."""
    return states.groupBy(*by).agg(*(F.coalesce(F.sum(f"{s.name}__{k}"), F.lit(0)).alias(f"{s.name}__{k}") for s in scores for k in s.sums))


def values(states: DataFrame, scores: Sequence[Score], by: Sequence[str] = ()) -> DataFrame:
    return states.select(*by, *(s.result() for s in scores))


def evaluate(df: DataFrame, scores: Sequence[Score], by: Sequence[str] = ()) -> DataFrame:
    return values(state(df, scores, by), scores, by)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, num(a) / F.when(b != 0, num(b)).otherwise(1.0)).otherwise(0.0)




def rmse(y: str, p: str, name: str = "rmse") -> Score:
    e = num(F.col(y)) - num(F.col(p))
    return Score(name, {"sse": e * e, "n": F.lit(1)}, lambda s: F.sqrt(_ratio(s("sse"), s("n"))))


def weighted_rmse(y: str, p: str, weight: str | None = None, name: str = "weighted_rmse") -> Score:
    """Weights are finite and not negative; others raise."""
    e = num(F.col(y)) - num(F.col(p))
    w = num(F.col(weight)) if weight else F.lit(1.0)
    ok = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf"))
    w = F.when(ok, w).otherwise(F.raise_error(F.lit("sample weight must be finite and nonnegative")).cast("double"))
    return Score(name, {"sse": w * e * e, "weight_sum": w, "n": F.lit(1)}, lambda s: F.sqrt(_ratio(s("sse"), s("weight_sum"))))


def weighted(name: str):
    """The weighted form of a score by name."""
    if name == "rmse":
        return weighted_rmse
    raise ValueError(f"{name} has no weighted form")


def r2(y: str, p: str, name: str = "r2") -> Score:
    v, e = num(F.col(y)), num(F.col(y)) - num(F.col(p))

    def value(s):
        sst = s("y2") - _ratio(s("y") * s("y"), s("n"))
        flat = F.when(s("sse") <= 0, 1.0).otherwise(0.0)
        return F.when(s("n") == 0, 0.0).when(sst <= 0, flat).otherwise(1.0 - _ratio(s("sse"), sst))

    return Score(name, {"sse": e * e, "y": v, "y2": v * v, "n": F.lit(1)}, value)


def correlation(y: str, p: str, name: str = "correlation") -> Score:
    a, b = num(F.col(y)), num(F.col(p))

    def value(s):
        var = lambda x, xx: s(xx) - _ratio(s(x) * s(x), s("n"))
        spread = var("y", "y2") * var("p", "p2")
        cov = s("yp") - _ratio(s("y") * s("p"), s("n"))
        return F.when((s("n") < 2) | (spread <= 0), 0.0).otherwise(_ratio(cov, F.sqrt(F.greatest(spread, F.lit(0.0)))))

    return Score(name, {"y": a, "p": b, "y2": a * a, "p2": b * b, "yp": a * b, "n": F.lit(1)}, value)


def beyond(x: Column, above: float | None = None, below: float | None = None) -> Column:
    """Whether ``x`` is above or below a bound; null and NaN, which Spark takes for the largest number, are neither."""
    return F.coalesce(~F.isnan(x) & (x > above if above is not None else x < below), F.lit(False))


def unit_pnl(y: str, p: str, threshold: float = 0.0, power: int = 0, name: str = "unit_pnl") -> Score:
    """Return earned per unit of position, positions being the sign (or a power) of predictions beyond the threshold; null and NaN predictions take none."""
    a, b = num(F.col(y)), num(F.col(p))
    active = beyond(F.abs(b), above=threshold)
    weight = F.pow(F.abs(b), F.lit(power)) if power else F.lit(1.0)
    sums = {"pnl": F.when(active, F.signum(b) * weight * a).otherwise(0.0), "norm": F.when(active, weight).otherwise(0.0), "n": active.cast("int")}
    return Score(name, sums, lambda s: _ratio(s("pnl"), s("norm")))


def quantile_pnl(y: str, quantiles: Sequence[str], q_buy: int = -1, q_sell: int = 0, buy_above: float = 0.0, sell_below: float = 0.0, power: int = 0, name: str = "quantile_pnl") -> Score:
    """Buy where one predicted quantile is above a bound, sell where another is below; both at once is neither, and null and NaN are on no side."""
    k = len(quantiles)
    if not (-k <= q_buy < k and -k <= q_sell < k):
        raise ValueError("quantile index out of bounds")
    up, down = num(F.col(quantiles[q_buy])), num(F.col(quantiles[q_sell]))
    b, s = beyond(up, above=buy_above), beyond(down, below=sell_below)
    buy, sell = b & ~s, s & ~b
    signal = F.when(buy, up).otherwise(down)
    weight = F.pow(F.abs(signal), F.lit(power)) if power else F.lit(1.0)
    v = num(F.col(y))
    sums = {
        "pnl": F.when(buy, weight * v).when(sell, -weight * v).otherwise(0.0), "norm": F.when(buy | sell, weight).otherwise(0.0),
        "n": (buy | sell).cast("int"), "n_buy": buy.cast("int"), "n_sell": sell.cast("int"), "n_overlap": (b & s).cast("int"),
    }
    return Score(name, sums, lambda g: _ratio(g("pnl"), g("norm")))


def pinball(y: str, predictions: Sequence[str], quantiles: Sequence[float] = (0.5,), name: str = "pinball") -> Score:
    if len(predictions) != len(quantiles):
        raise ValueError("as many predictions as quantiles")
    loss = F.lit(0.0)
    for p, q in zip(predictions, quantiles, strict=True):
        e = num(F.col(y)) - num(F.col(p))
        loss = loss + F.greatest(q * e, (q - 1.0) * e)
    return Score(name, {"loss": loss, "n": F.lit(1)}, lambda s: _ratio(s("loss"), s("n") * len(quantiles)))


def context(df: DataFrame, date: str = "date", nature: str = "nature", order: str = "row_nr") -> DataFrame:
    """Rows, and dates and natures in the order they first appear."""
    first = lambda c: df.groupBy(c).agg(F.min(order).alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c]).alias(f"{c}s"))
    return df.agg(F.count(F.lit(1)).alias("n")).crossJoin(first(date)).crossJoin(first(nature))  # one row each
