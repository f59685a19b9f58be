"""Every operator as a query over the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthforge import book_sql, tree_sql
from depthforge.functions import exprs as X
from depthforge.operators import asof, book, book_sql_function, boosting, filters, linear, neural, quality, relational, reports, sampling, scores, transforms, user_scores, validation
from depthforge.operators.book_ranges import build_depth_by_ranges
from depthforge.operators.kernels import Decay, decayed_by_ranges
from depthforge.operators.ordering import KEYS, average_rank, by_row, carry_forward, forward_fill
from depthforge.plans import features as P
from depthforge.plans import search
from depthforge.sources import calendars, records
from depthforge.sources.dated import DataSource, nature, session_days, with_row_nr
from depthforge.sources.shared import shared_path
from depthforge.sources.views import MBO_SQL, QUOTES_SQL, event_stream, mbo, mbo_of, quotes, quotes_of
from depthforge.streaming import event_time, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000_000
UND = X.UNDEF


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---------------------------------------------------------------- SQL texts

OVER = "OVER (PARTITION BY publisher_id, instrument_id ORDER BY row_nr)"
VALID = f"(bid_px_0 <> {UND} AND bid_sz_0 > 0 AND ask_px_0 <> {UND} AND ask_sz_0 > 0)"
MID = "((CAST(bid_px_0 AS DOUBLE) + CAST(ask_px_0 AS DOUBLE)) / 2)"
TRADE = "(trade_side IS NOT NULL AND trade_sz > 0)"


def with_quotes(rest: str) -> str:
    return f"WITH {QUOTES_SQL} {rest}"


def balance_sql(a: str, b: str, log: bool) -> str:
    return f"(ln({a} + 1e-12) - ln({b} + 1e-12))" if log else f"(({a} - {b}) / ({a} + {b} + 1e-12))"


def depth_sql(side: str, depth: int) -> str:
    half = "((CAST(ask_px_0 AS DOUBLE) - CAST(bid_px_0 AS DOUBLE)) / 2)"
    terms = []
    for i in range(depth):
        p = f"CAST({side}_px_{i} AS DOUBLE)"
        gap = f"({MID} - {p})" if side == "bid" else f"({p} - {MID})"
        terms.append(f"CASE WHEN {side}_px_{i} <> {UND} AND {side}_sz_{i} > 0 AND {half} > 0 AND {gap} > 0 THEN {side}_sz_{i} / ({gap} / {half}) ELSE 0 END")
    return "(" + " + ".join(terms) + ")"


def average_sql(side: str, depth: int, size: float) -> str:
    taken, qty, cost = "0", [], []
    for i in range(depth):
        there = f"(CASE WHEN {side}_px_{i} <> {UND} AND {side}_sz_{i} > 0 THEN CAST({side}_sz_{i} AS DOUBLE) ELSE 0 END)"
        take = f"least({there}, greatest({size} - ({taken}), 0))"
        qty.append(take)
        cost.append(f"{take} * CAST({side}_px_{i} AS DOUBLE)")
        taken = f"{taken} + {there}"
    q = "(" + " + ".join(qty) + ")"
    return f"(CASE WHEN {q} > 0 THEN ({' + '.join(cost)}) / nullif({q}, 0) END)"


def price_sql(depth: int, size: float) -> str:
    return f"(ln(({average_sql('bid', depth, size)} + {average_sql('ask', depth, size)}) / (CAST(bid_px_0 AS DOUBLE) + CAST(ask_px_0 AS DOUBLE))) * 1e4)"


def flow_sql(kind: str, side: str, unit: bool = False) -> str:
    """Push or pull flow of quotes joined with the previous row's px0 and sz0."""
    p, s, p0, s0 = f"{side}_px_0", f"{side}_sz_0", f"{side}_p0", f"coalesce({side}_s0, 0)"
    now, then = f"({p} <> {UND} AND {s} > 0)", f"coalesce({p_ok(side)}, false)"
    better = f"{p} > {p0}" if (side == "bid") == (kind == "push") else f"{p} < {p0}"
    if kind == "push":
        e = f"CASE WHEN NOT {TRADE} AND {now} AND {then} AND {better} THEN {s} WHEN NOT {TRADE} AND {now} AND {then} AND {p} = {p0} AND {s} > {s0} THEN {s} - {s0} ELSE 0 END"
    else:
        e = f"CASE WHEN NOT {TRADE} AND {then} AND (NOT {now} OR {better}) THEN {s0} WHEN NOT {TRADE} AND {then} AND {p} = {p0} AND {s} < {s0} THEN {s0} - {s} ELSE 0 END"
    return f"(CASE WHEN ({e}) > 0 THEN 1 ELSE 0 END)" if unit else f"({e})"


def p_ok(side: str) -> str:
    return f"{side}_p0 <> {UND} AND {side}_s0 > 0"


LAGGED = (
    f"lagged AS (SELECT *, lag(bid_px_0) {OVER} AS bid_p0, lag(bid_sz_0) {OVER} AS bid_s0, lag(ask_px_0) {OVER} AS ask_p0, lag(ask_sz_0) {OVER} AS ask_s0, "
    f"ln(CASE WHEN {VALID} THEN {MID} END / lag(CASE WHEN {VALID} THEN {MID} END) {OVER}) AS ret FROM quotes)"
)


def flows_sql(mode: str, unit: bool = False) -> tuple[str, str]:
    if mode == "trade":
        return tuple(f"(CASE WHEN trade_side = {s} THEN {'1' if unit else 'trade_sz'} ELSE 0 END)" for s in (0, 1))
    return (flow_sql("push", "bid", unit), flow_sql("push", "ask", unit)) if mode == "push" else (flow_sql("pull", "ask", unit), flow_sql("pull", "bid", unit))


def decay_sql(name: str, source: str, value: str, half_life: int) -> str:
    """CTE ``name`` (row_nr, s): decayed sums of ``value`` over the rows of ``source`` (row_nr, instrument_id, ts_ns)."""
    return (
        f"{name}_x AS (SELECT row_nr, instrument_id, ts_ns, CAST(coalesce({value}, 0) AS DOUBLE) AS x FROM {source}), "
        f"{name} AS (SELECT a.row_nr, sum(b.x * exp(-{math.log(2.0)!r} * (a.ts_ns - b.ts_ns) / {float(half_life)!r})) AS s FROM {name}_x a JOIN {name}_x b "
        f"ON a.instrument_id = b.instrument_id AND b.row_nr <= a.row_nr GROUP BY a.row_nr)"
    )


def mean_sql(name: str, source: str, value: str, half_life: int) -> str:
    """CTE ``name`` (row_nr, s): normalised averages, carried over null rows."""
    over = "OVER (PARTITION BY instrument_id ORDER BY row_nr)"
    u = f"CASE WHEN lag(ts_ns) {over} IS NULL THEN x ELSE (1 - exp(-{math.log(2.0)!r} * (ts_ns - lag(ts_ns) {over}) / {float(half_life)!r})) * x END"
    return (
        f"{name}_v AS (SELECT row_nr, instrument_id, ts_ns, CAST({value} AS DOUBLE) AS x FROM {source}), "
        f"{name}_u AS (SELECT row_nr, instrument_id, ts_ns, {u} AS u FROM {name}_v WHERE x IS NOT NULL), "
        f"{decay_sql(name + '_s', name + '_u', 'u', half_life)}, "
        f"{name} AS (SELECT v.row_nr, last_value(s IGNORE NULLS) OVER (PARTITION BY v.instrument_id ORDER BY v.row_nr ROWS UNBOUNDED PRECEDING) AS s FROM {name}_v v LEFT JOIN {name}_s USING (row_nr))"
    )


def asof_sql(name: str, source: str, price: str, ahead: int) -> str:
    """CTE ``name`` (row_nr, v): price as of ``ahead`` later."""
    return (
        f"{name}_p AS (SELECT row_nr, instrument_id, ts_ns, ts_ns + {ahead} AS t, max(ts_ns) OVER (PARTITION BY instrument_id) AS e, {price} AS p FROM {source}), "
        f"{name} AS (SELECT a.row_nr, CASE WHEN a.t <= a.e THEN b.p END AS v FROM {name}_p a ASOF JOIN {name}_p b ON a.instrument_id = b.instrument_id AND a.t >= b.ts_ns)"
    )


# ---------------------------------------------------------------- filters and projections


@query(
    "scan_project_filter",
    with_quotes("SELECT row_nr, instrument_id, bid_px_0, ask_px_0 FROM quotes WHERE trade_side = 0 AND trade_sz >= 5"),
)
def _(s, d):
    return quotes(s, d).where((F.col("trade_side") == 0) & (F.col("trade_sz") >= 5)).select("row_nr", "instrument_id", "bid_px_0", "ask_px_0")


@query("or_mask", with_quotes("SELECT row_nr FROM quotes WHERE bid_sz_0 > 45 OR ask_sz_0 > 45"))
def _(s, d):
    return quotes(s, d).where(filters.any_of([F.col("bid_sz_0") > 45, F.col("ask_sz_0") > 45])).select("row_nr")


@query("and_groups", with_quotes("SELECT row_nr FROM quotes WHERE (bid_sz_0 > 45 OR ask_sz_0 > 45) AND (instrument_id = 1 OR instrument_id = 2)"))
def _(s, d):
    return quotes(s, d).where(filters.all_groups([F.col("bid_sz_0") > 45, F.col("ask_sz_0") > 45], [F.col("instrument_id") == 1, F.col("instrument_id") == 2])).select("row_nr")


@query("value_filter", with_quotes("SELECT row_nr FROM quotes WHERE instrument_id IN (0, 3) AND trade_side = 1"))
def _(s, d):
    return quotes(s, d).where(filters.is_value("instrument_id", [0, 3]) & filters.is_value("trade_side", 1)).select("row_nr")


def _trade_size(name: str, threshold: float):
    large = f"CASE WHEN trade_side = 0 THEN ask_sz_0 > 0 AND CAST(trade_sz AS DOUBLE) / ask_sz_0 > {threshold} WHEN trade_side = 1 THEN bid_sz_0 > 0 AND CAST(trade_sz AS DOUBLE) / bid_sz_0 > {threshold} ELSE false END"
    query(name, with_quotes(f"SELECT row_nr FROM quotes WHERE {large}"))(lambda s, d: quotes(s, d).where(filters.trade_size(threshold)).select("row_nr"))


_trade_size("trade_size_filter", 0.5)


def _round_sizes(s, d) -> DataFrame:
    """Sizes of a hundredth of the depth they meet, so that quotients fall on the threshold."""
    n = F.col("event_id")
    return s.read.parquet(f"{d}/events.parquet").select(n.alias("row_nr"), (n % 2).alias("trade_side"), (n % 61).alias("trade_sz"), (F.lit(100) * (n % 3)).alias("bid_sz_0"), (F.lit(100) * (n % 4)).alias("ask_sz_0"))


@query(
    "trade_size_boundary",
    "WITH t AS (SELECT event_id AS row_nr, event_id % 61 AS z, CASE WHEN event_id % 2 = 0 THEN 100 * (event_id % 4) ELSE 100 * (event_id % 3) END AS depth FROM events) SELECT row_nr FROM t WHERE depth > 0 AND CAST(z AS DOUBLE) / CAST(depth AS DOUBLE) > CAST(0.29 AS DOUBLE)",
)
def _(s, d):
    """A size of 29 against a depth of 100 isn't above 0.29."""
    return _round_sizes(s, d).where(filters.trade_size(0.29)).select("row_nr")


@query("level_taken_filter", with_quotes(f", {LAGGED} SELECT row_nr FROM lagged WHERE abs(coalesce(CAST(bid_px_0 AS DOUBLE) - bid_p0, 0)) > 1e-10 OR abs(coalesce(CAST(ask_px_0 AS DOUBLE) - ask_p0, 0)) > 1e-10"))
def _(s, d):
    return filters.where_level(quotes(s, d), filters.level_taken()).select("row_nr")


@query("tight_spread_filter", with_quotes(f"SELECT row_nr FROM quotes WHERE CAST(ask_px_0 AS HUGEINT) - bid_px_0 = 250000000 AND bid_px_0 <> {UND}"))
def _(s, d):
    return quotes(s, d).where(filters.tight_spread(250_000_000) & (F.col("bid_px_0") != UND)).select("row_nr")


def _time_of_day(name, start, end, closed, zone, test):
    t = "epoch_us(ts_event)" if zone is None else f"epoch_us(timezone('{zone}', timezone('UTC', ts_event)))"
    sql = with_quotes(f", t AS (SELECT row_nr, {t} % 86400000000 AS t FROM quotes) SELECT row_nr FROM t WHERE {test}")
    query(name, sql)(lambda s, d: quotes(s, d).where(filters.intraday_time(start, end, timezone=zone, closed=closed)).select("row_nr"))


for _closed, _test in {"left": ("t >= {a} AND t < {b}"), "right": "t > {a} AND t <= {b}", "both": "t >= {a} AND t <= {b}", "none": "t > {a} AND t < {b}"}.items():
    _time_of_day(f"intraday_time_{_closed}", "09:30", "16:00", _closed, None, _test.format(a=34_200_000_000, b=57_600_000_000))
_time_of_day("intraday_time_midnight", "22:00", "02:30:00", "left", None, "t >= 79200000000 OR t < 9000000000")
_time_of_day("intraday_time_new_york", "09:30", "16:00", "left", "America/New_York", "t >= 34200000000 AND t < 57600000000")


@query("valid_rows", with_quotes(f"SELECT row_nr FROM quotes WHERE {VALID} AND ask_px_0 > bid_px_0 AND trade_sz IS NOT NULL"))
def _(s, d):
    return quotes(s, d).where(filters.valid_rows("trade_sz", ["bid_sz_0", "ask_sz_0"])).select("row_nr")


@query("scaled_price", with_quotes(f"SELECT row_nr, round(CASE WHEN bid_px_0 > 0 AND bid_px_0 < {UND} AND bid_sz_0 > 0 THEN bid_px_0 / 1e9 END, 6) AS price, CAST(CASE WHEN bid_px_0 > 0 AND bid_px_0 < {UND} AND bid_sz_0 > 0 THEN bid_sz_0 END AS DOUBLE) AS size FROM quotes"))
def _(s, d):
    return quotes(s, d).select("row_nr", r6(filters.scaled_price("bid_px_0", "bid_sz_0"), "price"), F.when(filters.valid_price("bid_px_0", "bid_sz_0"), F.col("bid_sz_0").cast("double")).alias("size"))


# ---------------------------------------------------------------- static features


def _feature(name: str, column, sql: str, lagged: bool = False):
    source = f", {LAGGED} SELECT row_nr, round(CAST({sql} AS DOUBLE), 6) AS value FROM lagged" if lagged else f"SELECT row_nr, round(CAST({sql} AS DOUBLE), 6) AS value FROM quotes"
    query(name, with_quotes(source))(lambda s, d: quotes(s, d).select("row_nr", r6(column(by_row()), "value")))


for _name, _depth, _log in (("d1_log", 1, True), ("d3_lin", 3, False), ("d3_log", 3, True)):
    _feature(f"book_imbalance_{_name}", lambda w, k=_depth, g=_log: X.book_imbalance(k, g), balance_sql(depth_sql("bid", _depth), depth_sql("ask", _depth), _log))
for _size in (2.0, 5.0, 10.0):
    _feature(f"swap_price_sz{_size:g}", lambda w, z=_size: X.size_weighted_price(3, z), price_sql(3, _size))
for _log in (False, True):
    _feature(f"price_gap_{'log' if _log else 'lin'}", lambda w, g=_log: X.size_weighted_price_gap(3, 5.0, g), f"2 * {balance_sql(average_sql('ask', 3, 5.0), average_sql('bid', 3, 5.0), _log)} * 1e4")
_feature("mid_log_return", lambda w: X.log_mid_return(w) * 1e4, "ret * 1e4", True)
_feature("bbo_spread_bps", lambda w: X.spread_bps(), f"CASE WHEN {VALID} AND {MID} > 0 THEN (CAST(ask_px_0 AS DOUBLE) - CAST(bid_px_0 AS DOUBLE)) / {MID} * 1e4 END")
_feature("bbo_volume", lambda w: X.bbo_volume(), "0.5 * (bid_sz_0 + ask_sz_0)")


def _flow(mode, unit):
    buy, sell = flows_sql(mode, unit)
    sql = with_quotes(f", {LAGGED} SELECT row_nr, CAST({buy} AS DOUBLE) AS buy, CAST({sell} AS DOUBLE) AS sell FROM lagged")

    def run(s, d):
        b, z = X.flows(mode, by_row(), unit)
        return quotes(s, d).select("row_nr", b.cast("double").alias("buy"), z.cast("double").alias("sell"))

    query(f"{mode}_flow_{'unit' if unit else 'size'}", sql)(run)


for _mode in ("trade", "push", "pull"):
    for _u in (False, True):
        _flow(_mode, _u)

# ---------------------------------------------------------------- windows and decays

PREV = "last_value({x} IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY row_nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("carry_forward_prev", with_quotes(f"SELECT row_nr, {PREV.format(x='trade_sz')} AS value FROM quotes"))
def _(s, d):
    return quotes(s, d).select("row_nr", carry_forward(F.col("trade_sz")).alias("value"))


@query("forward_fill", with_quotes("SELECT row_nr, last_value(trade_side IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY row_nr ROWS UNBOUNDED PRECEDING) AS value FROM quotes"))
def _(s, d):
    return quotes(s, d).select("row_nr", forward_fill(F.col("trade_side")).alias("value"))


def _node(name, node, ctes, value, lagged=True, digits=6):
    sql = with_quotes((f", {LAGGED}" if lagged else "") + "".join(f", {c}" for c in ctes) + f" SELECT q.row_nr, round(CAST({value} AS DOUBLE), {digits}) AS value FROM {'lagged' if lagged else 'quotes'} q " + " ".join(f"LEFT JOIN {n} ON {n}.row_nr = q.row_nr" for n in _joined(value)))
    query(name, sql)(lambda s, d: P.add_features(quotes(s, d), [node("value")]).select("row_nr", F.round("value", digits).alias("value")))


def _joined(value: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"\b(c_\w+)\.s\b", value)))


_node("ewma_unnormalized", lambda n: P.Ewma(n, lambda w: F.col("trade_sz"), half_life="1h"), [decay_sql("c_a", "quotes", "trade_sz", HOUR)], "c_a.s", False)
_node("ewma_normalized", lambda n: P.Ewma(n, lambda w: F.col("trade_sz"), half_life="1h", normalized=True), [mean_sql("c_a", "quotes", "trade_sz", HOUR)], "c_a.s", False)


@query("ewma_by_ranges", with_quotes(f", {decay_sql('c_a', 'quotes', 'trade_sz', HOUR)}, {mean_sql('c_b', 'quotes', 'trade_sz', HOUR)} SELECT c_a.row_nr, round(c_a.s, 6) AS total, round(c_b.s, 6) AS mean FROM c_a JOIN c_b ON c_a.row_nr = c_b.row_nr"))
def _(s, d):
    """Decayed sums and averages, the rows of an instrument dealt out by ranges."""
    q = quotes(s, d).select(*KEYS, "row_nr", "ts_ns", F.col("trade_sz").cast("double").alias("x"))
    out = decayed_by_ranges(q, [Decay("total", "x", HOUR), Decay("mean", "x", HOUR, True)], 1000)
    return out.select("row_nr", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


def _momentum(name, mode, combine="diff", log=False, unit=False):
    buy, sell = flows_sql(mode, unit)
    ctes = [decay_sql("c_buy", "lagged", buy, HOUR), decay_sql("c_sell", "lagged", sell, HOUR), mean_sql("c_vol", "lagged", "0.5 * (bid_sz_0 + ask_sz_0)", HOUR)]
    b, z = (f"({c}.s / greatest(c_vol.s, 1e-12))" for c in ("c_buy", "c_sell"))
    if combine == "diff":
        value = balance_sql(f"(1 + {b})", f"(1 + {z})", log)
    else:
        value = f"ln((1 + {b}) * (1 + {z}) + 1e-12)" if log else f"({b} + {z})"
    _node(name, lambda n: P.momentum(n, "1h", mode, log=log, unit=unit, combine=combine), ctes, value)


for _mode in ("trade", "push", "pull"):
    _momentum(f"{_mode}_momentum", _mode)
    _momentum(f"{_mode}_momentum_log", _mode, log=True)
_momentum("trade_momentum_sum", "trade", "sum")
_momentum("trade_momentum_sum_log", "trade", "sum", True)
_momentum("push_momentum_unit", "push", unit=True)


def _correlation(mode):
    sign = "(CASE WHEN trade_side IN (0, 1) THEN 1 - 2 * trade_side END)"
    v = sign if mode == "side" else f"({sign} * ln(1 + trade_sz))"
    pairs = (
        f"signed AS (SELECT *, CASE WHEN {TRADE} THEN {v} END AS tv FROM quotes), "
        f"pairs AS (SELECT row_nr, instrument_id, ts_ns, CASE WHEN tv IS NOT NULL THEN pv END AS pv, CASE WHEN pv IS NOT NULL THEN tv END AS v FROM (SELECT *, {PREV.format(x='tv')} AS pv FROM signed))"
    )
    ctes = [pairs, mean_sql("c_v", "pairs", "v", HOUR), mean_sql("c_q", "pairs", "v * pv", HOUR), decay_sql("c_m", "pairs", "CASE WHEN v IS NOT NULL AND pv IS NOT NULL THEN 1 END", HOUR)]
    s2 = "1"
    if mode == "volume":
        ctes.append(mean_sql("c_w", "pairs", "v * v", HOUR))
        s2 = "c_w.s"
    value = f"CASE WHEN c_m.s > 1e-12 THEN least(greatest((c_q.s - c_v.s * c_v.s) / ({s2} - c_v.s * c_v.s + 1e-12), -1), 1) END"
    _node(f"trade_corr_{mode}", lambda n: P.trade_correlation(n, "1h", mode), ctes, value, False, 3)


_correlation("side")
_correlation("volume")
_node("log_return", lambda n: P.log_return(n, "1h"), [decay_sql("c_r", "lagged", "ret * 1e4", HOUR)], "c_r.s")
_node("ewma_var", lambda n: P.ewma_var(n, "1h"), [decay_sql("c_r", "lagged", "ret * ret", HOUR)], "sqrt(c_r.s) * 1e4")
_node("ewma_spread", lambda n: P.ewma_spread(n, "1h"), [mean_sql("c_p", "lagged", f"CASE WHEN {VALID} AND {MID} > 0 THEN (CAST(ask_px_0 AS DOUBLE) - CAST(bid_px_0 AS DOUBLE)) / {MID} * 1e4 END", HOUR)], "c_p.s")


def _flow_return(form):
    buy, sell = flows_sql("trade")
    b, z = (f"({c}.s / greatest(c_vol.s, 1e-12))" for c in ("c_buy", "c_sell"))
    mom = (
        f"mom AS (SELECT l.row_nr, l.instrument_id, l.ts_ns, l.ret, {balance_sql(f'(1 + {b})', f'(1 + {z})', False)} AS m FROM lagged l JOIN c_buy ON c_buy.row_nr = l.row_nr JOIN c_sell ON c_sell.row_nr = l.row_nr JOIN c_vol ON c_vol.row_nr = l.row_nr), "
        f"resp AS (SELECT *, {PREV.format(x='m')} * ret * 1e4 AS x FROM mom)"
    )
    ctes = [decay_sql("c_buy", "lagged", buy, HOUR), decay_sql("c_sell", "lagged", sell, HOUR), mean_sql("c_vol", "lagged", "0.5 * (bid_sz_0 + ask_sz_0)", HOUR), mom, decay_sql("c_n", "resp", "x", 10 * HOUR)]
    value = "c_n.s"
    if form == "corr":
        ctes.append(decay_sql("c_d", "resp", "abs(ret * 1e4)", 10 * HOUR))
        value = "CASE WHEN c_d.s > 1e-12 THEN c_n.s / c_d.s END"
    _node(f"flow_return_{form}", lambda n: P.flow_return(n, "1h", "10h", form), ctes, value)


_flow_return("sum")
_flow_return("corr")


@query("standard_features")
def _(s, d):
    """All 34 features of the standard set, in one fold."""
    return _standard(quotes(s, d), *P.standard_set(["1h", "2h", "4h", "8h"]))


def _standard(q: DataFrame, static, nodes) -> DataFrame:
    """The static features are made where the rows are read, in as many tasks as that takes: a book's own rows all meet in one."""
    made = q.withColumns({n: F.round(c(by_row()), 6) for n, c in static.items()})
    made = made.drop("ts_event", *(f"{side}_{x}_{i}" for side in ("bid", "ask") for x in ("px", "sz") for i in (1, 2)))  # the fold passes on what it gets
    return P.add_features(made, nodes).select("row_nr", *static, *(F.round(n.name, 6).alias(n.name) for n in nodes))


def _standard_sql(half_lives) -> str:
    """The standard set without the correlations, whose ratios near 0 / 0 don't bear rounding."""
    spread = f"CASE WHEN {VALID} AND {MID} > 0 THEN (CAST(ask_px_0 AS DOUBLE) - CAST(bid_px_0 AS DOUBLE)) / {MID} * 1e4 END"
    ctes, cols = [], {
        "imbalance_1": balance_sql(depth_sql("bid", 1), depth_sql("ask", 1), True), "imbalance_3": balance_sql(depth_sql("bid", 3), depth_sql("ask", 3), True), "imbalance_3_lin": balance_sql(depth_sql("bid", 3), depth_sql("ask", 3), False),
        "price_gap": f"2 * {balance_sql(average_sql('ask', 3, 5.0), average_sql('bid', 3, 5.0), False)} * 1e4", "swap": price_sql(3, 5.0), "spread_bps": spread,
    }
    for name, h in half_lives.items():
        ctes.append(mean_sql(f"c_vol{name}", "lagged", "0.5 * (bid_sz_0 + ask_sz_0)", h))
        for mode in ("trade", "push", "pull"):
            for side, flow in zip(("buy", "sell"), flows_sql(mode), strict=True):
                ctes.append(decay_sql(f"c_{mode}{side}{name}", "lagged", flow, h))
            b, z = (f"(1 + c_{mode}{side}{name}.s / greatest(c_vol{name}.s, 1e-12))" for side in ("buy", "sell"))
            cols[f"{mode}_{name}"] = balance_sql(b, z, True)
        ctes += [decay_sql(f"c_ret{name}", "lagged", "ret * 1e4", h), decay_sql(f"c_var{name}", "lagged", "ret * ret", h), mean_sql(f"c_spread{name}", "lagged", spread, h)]
        cols |= {f"return_{name}": f"c_ret{name}.s", f"var_{name}": f"sqrt(c_var{name}.s) * 1e4", f"spread_{name}": f"c_spread{name}.s"}
    used = list(dict.fromkeys(n for c in cols.values() for n in _joined(c)))
    joins = " ".join(f"JOIN {n} ON {n}.row_nr = q.row_nr" for n in used)
    return with_quotes(f", {LAGGED}, {', '.join(ctes)} SELECT q.row_nr, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {n}' for n, c in cols.items())} FROM lagged q {joins}")


@query("standard_features_from_json", _standard_sql({"1h": HOUR}))
def _(s, d):
    """The standard set, from its JSON."""
    static, nodes = P.from_json(P.to_json(*P.standard_set(["1h"])))
    return _standard(quotes(s, d), static, [n for n in nodes if not n.name.startswith("corr")])


# ---------------------------------------------------------------- labels

GOOD = f"CASE WHEN {VALID} THEN {MID} / 1e9 END"


def good_mid():
    return F.when(X.bbo_valid(), X.mid() / 1e9)


@query("future_price", with_quotes(f", {asof_sql('f', 'quotes', GOOD, HOUR)} SELECT q.row_nr, round(f.v, 6) AS value FROM quotes q JOIN f ON f.row_nr = q.row_nr"))
def _(s, d):
    return asof.add_future_price(quotes(s, d), good_mid(), "1h").select("row_nr", r6(F.col("future_price"), "value"))


@query("future_return_1h", with_quotes(f", {asof_sql('f', 'quotes', GOOD, HOUR)} SELECT q.row_nr, round((f.v / ({GOOD}) - 1) * 1e4, 6) AS value FROM quotes q JOIN f ON f.row_nr = q.row_nr"))
def _(s, d):
    return asof.add_return(quotes(s, d), good_mid(), "1h").select("row_nr", r6(F.col("return_bps"), "value"))


@query(
    "weighted_multi_horizon_return",
    with_quotes(f", {asof_sql('f', 'quotes', GOOD, HOUR)}, {asof_sql('g', 'quotes', GOOD, 6 * HOUR)} SELECT q.row_nr, round(((f.v * 2 + g.v * 1) / 3 / ({GOOD}) - 1) * 1e4, 6) AS value FROM quotes q JOIN f ON f.row_nr = q.row_nr JOIN g ON g.row_nr = q.row_nr"),
)
def _(s, d):
    return asof.add_return(quotes(s, d), good_mid(), ["1h", "6h", "1d"], [2.0, 1.0, 0.0]).select("row_nr", r6(F.col("return_bps"), "value"))


@query("executable_price_future", with_quotes(f", {asof_sql('f', 'quotes', price_sql(3, 5.0), HOUR)} SELECT q.row_nr, round(f.v, 6) AS value FROM quotes q JOIN f ON f.row_nr = q.row_nr"))
def _(s, d):
    return asof.add_future_executable_price(quotes(s, d), 3, 5.0, "1h").select("row_nr", r6(F.col("future_executable_price"), "value"))


@query(
    "executable_return",
    with_quotes(f", {asof_sql('f', 'quotes', price_sql(3, 60.0), HOUR)}, p AS (SELECT q.row_nr, f.v, {price_sql(3, 60.0)} AS p FROM quotes q JOIN f ON f.row_nr = q.row_nr) SELECT row_nr, round((v / p - 1) * 1e4, 4) AS value FROM p WHERE abs(p) > 1e-3 AND v IS NOT NULL"),
)
def _(s, d):
    out = asof.add_executable_return(quotes(s, d), 3, 60.0, "1h").withColumn("p", X.size_weighted_price(3, 60.0))
    return out.where((F.abs("p") > 1e-3) & F.col("executable_return_bps").isNotNull()).select("row_nr", F.round("executable_return_bps", 4).alias("value"))


@query("asof_join_trades", with_quotes("SELECT a.row_nr, b.row_nr AS trade_row, b.trade_sz AS last_size FROM quotes a ASOF LEFT JOIN (SELECT * FROM quotes WHERE trade_side = 0) b ON a.instrument_id = b.instrument_id AND a.ts_ns >= b.ts_ns"))
def _(s, d):
    q = quotes(s, d)
    trades = q.where("trade_side = 0").select(*KEYS, "ts_ns", "row_nr", F.col("row_nr").alias("trade_row"), F.col("trade_sz").alias("last_size"))
    return asof.asof_join(q.select(*KEYS, "ts_ns", "row_nr"), trades, KEYS, "ts_ns", "ts_ns", ["trade_row", "last_size"]).select("row_nr", "trade_row", "last_size")


# ---------------------------------------------------------------- relational


@query(
    "multi_product_full_join_ffill",
    with_quotes(", b AS (SELECT ts_ns // 3600000000000 AS bucket, instrument_id, arg_max(bid_sz_0, row_nr) AS z FROM quotes GROUP BY ALL), j AS (SELECT coalesce(x.bucket, y.bucket) AS bucket, x.z AS zx, y.z AS zy FROM (SELECT * FROM b WHERE instrument_id = 0) x FULL JOIN (SELECT * FROM b WHERE instrument_id = 1) y ON x.bucket = y.bucket) SELECT bucket, last_value(zx IGNORE NULLS) OVER w AS a_bid_sz_0, last_value(zy IGNORE NULLS) OVER w AS b_bid_sz_0 FROM j WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)"),
)
def _(s, d):
    q = quotes(s, d).withColumn("bucket", F.floor(F.col("ts_ns") / HOUR))
    frames = {n: q.where(F.col("instrument_id") == i).select("bucket", "row_nr", "bid_sz_0") for i, n in enumerate("ab")}
    return relational.join_products(frames, ["bucket"]).select("bucket", "a_bid_sz_0", "b_bid_sz_0")


@query("dedup_keep_last", with_quotes("SELECT trade_sz, instrument_id, max(row_nr) AS row_nr, arg_max(bid_sz_0, row_nr) AS bid_sz_0 FROM quotes GROUP BY ALL"))
def _(s, d):
    return relational.dedup_last(quotes(s, d).select("trade_sz", "instrument_id", "row_nr", "bid_sz_0").withColumn("o", F.col("row_nr")), ["trade_sz", "instrument_id"], "o").drop("o")


@query("group_max_time", with_quotes("SELECT publisher_id, instrument_id, max(ts_ns) AS max_ts_ns FROM quotes GROUP BY ALL"))
def _(s, d):
    return relational.group_last_time(quotes(s, d), KEYS)


@query("union_relaxed", with_quotes("SELECT row_nr, trade_sz, CAST(NULL AS BIGINT) AS bid_sz_0 FROM quotes WHERE trade_side = 0 UNION ALL SELECT row_nr, NULL, bid_sz_0 FROM quotes WHERE trade_side = 1"))
def _(s, d):
    q = quotes(s, d)
    return relational.union_relaxed(q.where("trade_side = 0").select("row_nr", "trade_sz"), q.where("trade_side = 1").select("row_nr", "bid_sz_0"))


@query("distinct_depth_prices", with_quotes(" UNION ".join(f"{'SELECT' if i or s == 'ask' else 'SELECT'} {s}_px_{i} AS price FROM quotes WHERE {s}_px_{i} <> {UND} AND {s}_sz_{i} > 0" for s in ("bid", "ask") for i in range(3))))
def _(s, d):
    return filters.depth_prices(quotes(s, d), 3)


_PRICES = f"prices AS ({' UNION '.join(f'SELECT {s}_px_{i} AS price FROM quotes WHERE {s}_px_{i} <> {UND} AND {s}_sz_{i} > 0' for s in ('bid', 'ask') for i in range(2))})"


@query("depth_price_semi_join", with_quotes(f", {MBO_SQL}, {_PRICES} SELECT row_nr, price FROM mbo WHERE price IN (SELECT price FROM prices)"))
def _(s, d):
    return filters.depth_price_filter(mbo(s, d), quotes(s, d), 2).select("row_nr", "price")


@query("depth_price_range", with_quotes(f", {MBO_SQL}, {_PRICES} SELECT row_nr, price FROM mbo WHERE price BETWEEN (SELECT min(price) FROM prices) AND (SELECT max(price) FROM prices)"))
def _(s, d):
    return filters.depth_price_filter(mbo(s, d), quotes(s, d), 2, "range").select("row_nr", "price")


# ---------------------------------------------------------------- scores

PRED_SQL = f"pred AS (SELECT row_nr, instrument_id, ts_ns, ((row_nr * 7919) % 2001 - 1000) / 4.0::DOUBLE AS y, ((row_nr * 104729) % 2003 - 1000) / 8.0::DOUBLE AS p, ((row_nr * 31) % 7)::DOUBLE AS w, ((row_nr * 13) % 101 - 60) / 8.0::DOUBLE AS q0, ((row_nr * 17) % 101 - 40) / 8.0::DOUBLE AS q1 FROM quotes)"


def predictions(s, d) -> DataFrame:
    """Targets, predictions, weights and quantiles in exact binary fractions, so that sums don't depend on their order."""
    q = quotes(s, d)
    n = F.col("row_nr")
    return q.select(
        "row_nr", *KEYS, "ts_ns", (((n * 7919) % 2001 - 1000) / 4.0).alias("y"), (((n * 104729) % 2003 - 1000) / 8.0).alias("p"), ((n * 31) % 7).cast("double").alias("w"),
        (((n * 13) % 101 - 60) / 8.0).alias("q0"), (((n * 17) % 101 - 40) / 8.0).alias("q1"),
    )


def _score(name, score, sql):
    query(name, with_quotes(f", {PRED_SQL} SELECT round({sql}, 6) AS score FROM pred"))(lambda s, d: scores.evaluate(predictions(s, d), [score("score")]))
    inner = QUERIES[name]
    QUERIES[name] = lambda s, d: inner(s, d).select(F.round("score", 6).alias("score"))


_score("score_rmse", lambda n: scores.rmse("y", "p", n), "sqrt(avg((y - p) * (y - p)))")
_score("score_weighted_rmse", lambda n: scores.weighted_rmse("y", "p", "w", n), "sqrt(sum(w * (y - p) * (y - p)) / sum(w))")
_score("score_r2", lambda n: scores.r2("y", "p", n), "1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))")
_score("score_corr", lambda n: scores.correlation("y", "p", n), "corr(y, p)")
_score("score_unit_pnl", lambda n: scores.unit_pnl("y", "p", 5.0, 0, n), "sum(sign(p) * y) FILTER (abs(p) > 5) / count(*) FILTER (abs(p) > 5)")
_score("score_unit_pnl_power", lambda n: scores.unit_pnl("y", "p", 5.0, 1, n), "sum(p * y) FILTER (abs(p) > 5) / sum(abs(p)) FILTER (abs(p) > 5)")
_QP = "(CASE WHEN q1 > 1 AND NOT q0 < -1 THEN y WHEN q0 < -1 AND NOT q1 > 1 THEN -y END)"
_score("score_quantile_pnl", lambda n: scores.quantile_pnl("y", ["q0", "q1"], -1, 0, 1.0, -1.0, 0, n), f"avg({_QP})")
_score("score_pinball", lambda n: scores.pinball("y", ["q0", "q1"], [0.1, 0.9], n), "sum(greatest(0.1 * (y - q0), -0.9 * (y - q0)) + greatest(0.9 * (y - q1), -0.1 * (y - q1))) / (2 * count(*))")

_GAPS_SQL = f"{PRED_SQL}, gaps AS (SELECT y, CASE WHEN row_nr % 5 = 0 THEN 'NaN'::DOUBLE WHEN row_nr % 7 <> 0 THEN p END AS p, CASE WHEN row_nr % 7 = 0 THEN 'NaN'::DOUBLE WHEN row_nr % 11 <> 0 THEN q1 END AS q1, CASE WHEN row_nr % 13 = 0 THEN 'NaN'::DOUBLE WHEN row_nr % 3 <> 0 THEN q0 END AS q0 FROM pred)"


def _gaps(s, d) -> DataFrame:
    """Predictions with NaN and nulls."""
    n = F.col("row_nr")
    gap = lambda c, nan, null: F.when(n % nan == 0, float("nan")).when(n % null != 0, F.col(c)).alias(c)
    return predictions(s, d).select("y", gap("p", 5, 7), gap("q1", 7, 11), gap("q0", 13, 3))


@query("unit_pnl_of_gaps", with_quotes(f", {_GAPS_SQL} SELECT round(sum(sign(p) * y) / count(*), 6) AS score, count(*) AS n FROM gaps WHERE p IS NOT NULL AND NOT isnan(p) AND abs(p) > 5"))
def _(s, d):
    one = scores.unit_pnl("y", "p", 5.0, 0, "score")
    return scores.state(_gaps(s, d), [one]).select(F.round(one.result(), 6).alias("score"), F.col("score__n").alias("n"))


_SIDES_SQL = "sides AS (SELECT y, coalesce(q1 > 1 AND NOT isnan(q1), false) AS b, coalesce(q0 < -1 AND NOT isnan(q0), false) AS s FROM gaps)"


@query(
    "quantile_pnl_of_gaps",
    with_quotes(f", {_GAPS_SQL}, {_SIDES_SQL} SELECT round(sum(CASE WHEN b AND NOT s THEN y WHEN s AND NOT b THEN -y END) / count(*) FILTER (b <> s), 6) AS score, count(*) FILTER (b AND NOT s) AS n_buy, count(*) FILTER (s AND NOT b) AS n_sell, count(*) FILTER (b AND s) AS n_overlap FROM sides"),
)
def _(s, d):
    one = scores.quantile_pnl("y", ["q0", "q1"], -1, 0, 1.0, -1.0, 0, "score")
    return scores.state(_gaps(s, d), [one]).select(F.round(one.result(), 6).alias("score"), *(F.col(f"score__{c}").alias(c) for c in ("n_buy", "n_sell", "n_overlap")))


_DAY = "ts_ns // 86400000000000"


@query("score_by_date", with_quotes(f", {PRED_SQL} SELECT {_DAY} AS day, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(sum(sign(p) * y) / nullif(count(*) FILTER (p <> 0), 0), 6) AS unit_pnl FROM pred GROUP BY 1"))
def _(s, d):
    df = predictions(s, d).withColumn("day", F.floor(F.col("ts_ns") / 86_400_000_000_000))
    return scores.evaluate(df, [scores.rmse("y", "p"), scores.unit_pnl("y", "p")], ["day"]).select("day", r6(F.col("rmse"), "rmse"), r6(F.col("unit_pnl"), "unit_pnl"))


def _user_rmse() -> user_scores.UserScore:
    """The root mean square error as a user's own score."""
    return user_scores.UserScore(
        "rmse", ["y", "p"], lambda: {"sse": 0.0, "n": 0.0}, lambda s, y, p: {"sse": s["sse"] + float(((y - p) ** 2).sum()), "n": s["n"] + len(y)},
        lambda a, b: {k: a[k] + b[k] for k in a}, lambda s: math.sqrt(s["sse"] / s["n"]) if s["n"] else 0.0,
    )


@query("score_user_aggregate", with_quotes(f", {PRED_SQL} SELECT {_DAY} AS day, instrument_id, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM pred GROUP BY 1, 2"))
def _(s, d):
    df = predictions(s, d).withColumn("day", F.floor(F.col("ts_ns") / 86_400_000_000_000))
    return user_scores.evaluate(df, _user_rmse(), ["day", "instrument_id"]).select("day", "instrument_id", F.round("rmse", 6).alias("rmse"))


@query("score_merge", with_quotes(f", {PRED_SQL} SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(corr(y, p), 6) AS correlation FROM pred"))
def _(s, d):
    df, wanted = predictions(s, d), [scores.rmse("y", "p"), scores.correlation("y", "p")]
    halves = [scores.state(df.where(F.col("row_nr") % 2 == i), wanted) for i in (0, 1)]
    return scores.values(scores.merge(halves[0].unionByName(halves[1]), wanted), wanted).select(r6(F.col("rmse"), "rmse"), r6(F.col("correlation"), "correlation"))


# ---------------------------------------------------------------- transforms, models, reports


@query("standardizer_fit", with_quotes(f", {PRED_SQL} SELECT round(avg(y), 6) AS y_mean, round(avg(w), 6) AS w_mean, round(stddev_samp(y), 6) AS y_std, round(stddev_samp(w), 6) AS w_std FROM pred"))
def _(s, d):
    row = transforms.Standardizer(["y", "w"]).statistics(predictions(s, d))
    return row.select(*(F.round(c, 6).alias(c) for c in row.columns))


@query("standardizer_apply", with_quotes(f", {PRED_SQL} SELECT row_nr, round((y - (SELECT avg(y) FROM pred)) / (SELECT stddev_samp(y) FROM pred), 6) AS y FROM pred"))
def _(s, d):
    df = predictions(s, d)
    return transforms.Standardizer(["y"]).fit(df).apply(df).select("row_nr", F.round("y", 6).alias("y"))


@query("return_normalizer", with_quotes(f", {PRED_SQL} SELECT row_nr, round(y / greatest(w, 0.5), 6) AS y FROM pred"))
def _(s, d):
    return transforms.ReturnNormalizer("w", "y", 0.5).apply(predictions(s, d)).select("row_nr", F.round("y", 6).alias("y"))


_TARGET = "2 * p - q0 + 0.1::DOUBLE * y"


@query("gram_stats", with_quotes(f", {PRED_SQL}, v AS (SELECT [p, q0, y, 1.0::DOUBLE] AS x, w FROM pred), c AS (SELECT i, j, round(sum(w * x[i + 1] * x[j + 1]), 4) AS value FROM v, range(4) a(i), range(4) b(j) WHERE i <= j GROUP BY i, j) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, value FROM c"))
def _(s, d):
    return linear.gram_rows(predictions(s, d), ["p", "q0"], "y", "w").where("i >= 0").select("i", "j", F.round("value", 4).alias("value"))


@query("ridge_fit_predict", book_sql.ridge_predictions(PRED_SQL, _TARGET, 1.0))
def _(s, d):
    df = predictions(s, d).withColumn("t", 2 * F.col("p") - F.col("q0") + 0.1 * F.col("y"))
    model = linear.ridge(linear.gram(df, ["p", "q0"], "t"), ["p", "q0"], 1.0)
    return model.predict(df).select("row_nr", F.round("prediction", 6).alias("prediction"))


@query("lasso_path_score", book_sql.lasso_scores(PRED_SQL, _TARGET, [0.0, 0.1, 1.0, 10.0]))
def _(s, d):
    df = predictions(s, d).withColumn("t", 2 * F.col("p") - F.col("q0") + 0.1 * F.col("y"))
    path = linear.lasso_path(linear.gram(df, ["p", "q0", "q1"], "t"), ["p", "q0", "q1"])
    row = linear.score_path(df, path, "t", [0.0, 0.1, 1.0, 10.0], lambda y, p, n: scores.rmse(y, p, n))
    return row.select(*(F.round(c, 6).alias(c) for c in row.columns))


_EDGES = [[-80.0, -20.0, 30.0, 90.0], [-5.0, -2.0, 1.5]]


@query("gbt_quantile_fit_predict", tree_sql.boosted_predictions(with_quotes(f", {PRED_SQL}"), "pred", "row_nr", ["p", "q0"], _TARGET, _EDGES, [0.1, 0.75], 2, 2, 0.5))
def _(s, d):
    """Two rounds of trees of depth two for each quantile, on fixed bins."""
    df = predictions(s, d).withColumn("t", 2 * F.col("p") - F.col("q0") + 0.1 * F.col("y"))
    model = boosting.fit(df, ["p", "q0"], "t", [0.1, 0.75], rounds=2, depth=2, learning_rate=0.5, edges=_EDGES)
    return model.predict(df, ["q0_", "q1_"]).select("row_nr", F.round("q0_", 6).alias("q0"), F.round("q1_", 6).alias("q1"))


@query("mlp_fit_predict")
def _(s, d):
    """A small network's predictions on the rows that it was fitted to."""
    df = predictions(s, d).withColumn("t", 2 * F.col("p") - F.col("q0") + 0.1 * F.col("y"))
    model = neural.fit(df, ["p", "q0", "y"], "t", hidden=(8,), epochs=2, steps=2, seed=1)
    return model.predict(df).select("row_nr", F.round("prediction", 6).alias("prediction"))


@query("expanding_folds_scores", with_quotes(f", {PRED_SQL}, c AS (SELECT *, row_nr % 4 AS chunk FROM pred) SELECT CAST(f AS INTEGER) AS fold, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM c, range(3) r(f) WHERE chunk = f + 1 GROUP BY f"))
def _(s, d):
    df = predictions(s, d).withColumn("date", (F.col("row_nr") % 4).cast("string"))
    roles = df.select("*", F.explode(search.fold_column([["0"], ["1"], ["2"], ["3"]])).alias("f")).where("f.role = 'valid'")
    return scores.evaluate(roles.withColumn("fold", F.col("f.fold")), [scores.rmse("y", "p")], ["fold"]).select("fold", F.round("rmse", 6).alias("rmse"))


_RANKED = "r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk, count(*) OVER () AS n FROM pred), dc AS (SELECT *, CAST(least(greatest(floor((rk - 1) * 10 / n), 0), 9) AS INTEGER) AS decile FROM r)"


@query("decile_report", with_quotes(f", {PRED_SQL}, {_RANKED} SELECT decile, count(*) AS n, round(avg(p), 6) AS mean_prediction, round(avg(y), 6) AS mean_return, round(avg(sign(p) * y), 6) AS mean_signed_return FROM dc GROUP BY decile"))
def _(s, d):
    out = reports.decile_report(predictions(s, d), "p", "y")
    return out.select("decile", "n", *(F.round(c, 6).alias(c) for c in ("mean_prediction", "mean_return", "mean_signed_return")))


@query("interval_coverage", with_quotes(f", {PRED_SQL} SELECT round(avg(CASE WHEN y >= q0 AND y <= q1 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(q1 - q0), 6) AS mean_width FROM pred"))
def _(s, d):
    return reports.interval_coverage(predictions(s, d), "y", "q0", "q1").select(F.round("coverage", 6).alias("coverage"), F.round("mean_width", 6).alias("mean_width"))


@query("feature_score_table", with_quotes(f", {PRED_SQL} SELECT * FROM (SELECT 'p' AS feature, round(corr(y, p), 6) AS score FROM pred UNION ALL SELECT 'q0', round(corr(y, q0), 6) FROM pred UNION ALL SELECT 'q1', round(corr(y, q1), 6) FROM pred)"))
def _(s, d):
    return reports.feature_scores(predictions(s, d), ["p", "q0", "q1"], "y", scores.correlation).select("feature", F.round("score", 6).alias("score"))


@query("corr_matrix", with_quotes(f", {PRED_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM pred" for i, a in enumerate(("y", "p", "q0")) for b in ("y", "p", "q0")[i:])))
def _(s, d):
    return reports.correlation_matrix(predictions(s, d), ["y", "p", "q0"]).select("a", "b", F.round("correlation", 6).alias("correlation"))


_CUM = "OVER (PARTITION BY instrument_id ORDER BY row_nr ROWS UNBOUNDED PRECEDING)"


@query("cumulative_unit_pnl", with_quotes(f", {PRED_SQL}, g AS (SELECT *, CASE WHEN abs(p) > 5 THEN sign(p) * y ELSE 0 END AS g, CASE WHEN abs(p) > 5 THEN 1.0 ELSE 0 END AS n FROM pred) SELECT row_nr, round(CASE WHEN sum(n) {_CUM} > 0 THEN sum(g) {_CUM} / nullif(sum(n) {_CUM}, 0) ELSE 0 END, 6) AS value FROM g"))
def _(s, d):
    one = scores.unit_pnl("y", "p", 5.0)
    return reports.cumulative(predictions(s, d).withColumns({"g": one.sums["pnl"], "nn": one.sums["norm"]}), "g", "nn", "value").select("row_nr", F.round("value", 6).alias("value"))


@query("cumulative_quantile_pnl", with_quotes(f", {PRED_SQL}, g AS (SELECT *, coalesce({_QP}, 0) AS g, CASE WHEN {_QP} IS NULL THEN 0.0 ELSE 1.0 END AS n FROM pred) SELECT row_nr, round(CASE WHEN sum(n) {_CUM} > 0 THEN sum(g) {_CUM} / nullif(sum(n) {_CUM}, 0) ELSE 0 END, 6) AS value FROM g"))
def _(s, d):
    one = scores.quantile_pnl("y", ["q0", "q1"], -1, 0, 1.0, -1.0)
    return reports.cumulative(predictions(s, d).withColumns({"g": one.sums["pnl"], "nn": one.sums["norm"]}), "g", "nn", "value").select("row_nr", F.round("value", 6).alias("value"))


@query("action_side_counts", f"WITH {MBO_SQL} SELECT action, side, count(*) AS n FROM mbo GROUP BY ALL")
def _(s, d):
    return reports.action_side_counts(mbo(s, d))


@query("window_summary", with_quotes(f"SELECT count(*) AS n, count(*) FILTER ({VALID}) AS n_valid, round(median(bid_sz_0), 6) AS median_bid_sz_0 FROM quotes"))
def _(s, d):
    return reports.summary(quotes(s, d).withColumn("valid", X.bbo_valid()), ["valid"], ["bid_sz_0"])


# ---------------------------------------------------------------- quality and views


@query("sequence_regressions", f"WITH {MBO_SQL}, l AS (SELECT instrument_id, price - lag(price) OVER w AS p, sequence - lag(sequence) OVER w AS q FROM mbo WINDOW w AS (PARTITION BY instrument_id ORDER BY row_nr)) SELECT instrument_id, count(*) FILTER (p < 0) AS price_regressions, count(*) FILTER (q < 0) AS sequence_regressions, count(*) FILTER (p > 1) AS price_jumps, count(*) FILTER (q > 1) AS sequence_jumps FROM l GROUP BY 1")
def _(s, d):
    return quality.regressions(mbo(s, d), ["price", "sequence"], ["instrument_id"])


@query("flag_checks", f"WITH {MBO_SQL} SELECT instrument_id, count(*) AS n_rows, count(*) FILTER (flags & 128 <> 0) AS n_last, count(*) FILTER (flags & 32 <> 0) AS n_snapshot, count(*) FILTER (flags & 32 <> 0 AND action = 'R') AS n_snapshot_reset, count(*) FILTER (flags & 160 = 160) AS n_snapshot_last, count(*) FILTER (flags & 8 <> 0) AS n_bad_ts, count(*) FILTER (flags & 4 <> 0) AS n_maybe_bad FROM mbo GROUP BY 1")
def _(s, d):
    return quality.flag_counts(mbo(s, d), ["instrument_id"])


@query("segment_bounds", f"WITH {MBO_SQL}, x AS (SELECT *, (ts_ns // 1000000000) % 86400 AS sec FROM mbo) SELECT instrument_id, CASE WHEN sec < 47700 THEN 'gap_before' WHEN sec < 72300 THEN 'window' ELSE 'gap_after' END AS segment, count(*) AS n, min(ts_ns) AS min, max(ts_ns) AS max FROM x GROUP BY ALL")
def _(s, d):
    return quality.segment_bounds(mbo(s, d), ["instrument_id"])


@query("time_bounds", f"WITH {MBO_SQL} SELECT instrument_id, count(*) AS n, arg_min(ts_ns, row_nr) AS first, arg_max(ts_ns, row_nr) AS last, min(ts_ns) AS min, max(ts_ns) AS max, count(DISTINCT ts_ns) AS n_unique FROM mbo GROUP BY 1")
def _(s, d):
    return quality.bounds(mbo(s, d), ["instrument_id"])


@query("stride_sample", with_quotes("SELECT row_nr, bid_sz_0 FROM quotes WHERE row_nr % 100 = 0"))
def _(s, d):
    return sampling.stride(quotes(s, d), 100).select("row_nr", "bid_sz_0")


@query("uniform_downsample", with_quotes(", p AS (SELECT row_nr, instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY row_nr) - 1 AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM quotes), k AS (SELECT DISTINCT instrument_id, CASE WHEN n <= 50 THEN x.k ELSE CAST(floor(x.k * (n - 1) / 49.0) AS BIGINT) END AS i FROM p, range(50) x(k)) SELECT row_nr FROM p JOIN k USING (instrument_id, i)"))
def _(s, d):
    return sampling.uniform(quotes(s, d), 50).select("row_nr")


@query("level_downsample", with_quotes(", p AS (SELECT row_nr, bid_px_1, lag(bid_px_1) OVER w AS was, row_number() OVER w AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM quotes WINDOW w AS (PARTITION BY instrument_id ORDER BY row_nr)) SELECT row_nr, bid_px_1 FROM p WHERE i = 1 OR i = n OR bid_px_1 IS DISTINCT FROM was"))
def _(s, d):
    return sampling.level_changes(quotes(s, d), "bid_px_1").select("row_nr", "bid_px_1")


@query(
    "level_downsample_budget",
    with_quotes(
        ", p AS (SELECT row_nr, instrument_id, bid_px_1, lag(bid_px_1) OVER w AS was, row_number() OVER w AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM quotes WINDOW w AS (PARTITION BY instrument_id ORDER BY row_nr)), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY row_nr) - 1 AS j, count(*) OVER (PARTITION BY instrument_id) - 1 AS m FROM p WHERE i = 1 OR i = n OR bid_px_1 <> was) "
        "SELECT row_nr, bid_px_1 FROM k WHERE m < 50 OR j = 0 OR j IN (SELECT CASE WHEN e = 49 THEN k.m ELSE floor(e * (k.m / CAST(49 AS DOUBLE)))::BIGINT END FROM range(1, 50) t(e))"
    ),
)
def _(s, d):
    return sampling.level_changes(quotes(s, d), "bid_px_1", 50).select("row_nr", "bid_px_1")


@query("over_budget", with_quotes("SELECT count(*) > 500 AS over FROM quotes WHERE trade_side = 0"))
def _(s, d):
    return sampling.over_budget(quotes(s, d).where("trade_side = 0"), 500)


@query("segment_overlaps", f"WITH {MBO_SQL}, x AS (SELECT *, (ts_ns // 1000000000) % 86400 AS sec FROM mbo), g AS (SELECT instrument_id, CASE WHEN sec < 47700 THEN 'gap_before' WHEN sec < 72300 THEN 'window' ELSE 'gap_after' END AS segment, min(ts_ns) AS a, max(ts_ns) AS b FROM x GROUP BY ALL) SELECT instrument_id, segment, coalesce(a <= max(b) OVER (PARTITION BY instrument_id ORDER BY a, b, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM g")
def _(s, d):
    return quality.segment_overlaps(quality.segment_bounds(mbo(s, d), ["instrument_id"]), ["instrument_id"])


@query("segment_row_sums", f"WITH {MBO_SQL} SELECT instrument_id, count(*) AS n_segments, count(*) AS n_whole, true AS equal FROM mbo GROUP BY 1")
def _(s, d):
    return quality.row_sums(quality.segment_bounds(mbo(s, d), ["instrument_id"]), mbo(s, d), ["instrument_id"])


@query("integrity_issues", f"WITH {MBO_SQL}, c AS (SELECT instrument_id, count(*) FILTER (flags & 128 <> 0) AS l, count(*) AS n, count(*) FILTER (flags & 32 <> 0) AS snap FROM mbo GROUP BY 1) SELECT instrument_id, 'error' AS severity, 'few_blocks' AS rule FROM c WHERE 4 * l < n UNION ALL SELECT instrument_id, 'warning', 'no_snapshot' FROM c WHERE snap = 0")
def _(s, d):
    rules = [("error", "few_blocks", 4 * F.col("n_last") < F.col("n_rows")), ("warning", "no_snapshot", F.col("n_snapshot") == 0)]
    return quality.issues(quality.flag_counts(mbo(s, d), ["instrument_id"]), rules, ["instrument_id"])


# ---------------------------------------------------------------- rows, columns and sources


@query("row_positions", with_quotes(f"SELECT instrument_id, row_nr, row_number() {OVER} AS position FROM quotes"))
def _(s, d):
    return quotes(s, d).select("instrument_id", "row_nr", F.row_number().over(by_row()).alias("position"))


@query("average_ranks", with_quotes("SELECT row_nr, CASE WHEN trade_sz IS NOT NULL THEN rank() OVER (PARTITION BY trade_sz IS NULL ORDER BY trade_sz) + (count(*) OVER (PARTITION BY trade_sz) - 1) / 2.0 END AS rank FROM quotes"))
def _(s, d):
    return reports.ranked(quotes(s, d), "trade_sz").select("row_nr", F.col("rank").cast("double").alias("rank"))


@query("average_ranks_of_groups", with_quotes(", g AS (SELECT instrument_id, trade_sz, count(*) AS n FROM quotes GROUP BY ALL) SELECT instrument_id, trade_sz, n, CAST(rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS DOUBLE) AS rank FROM g"))
def _(s, d):
    groups = quotes(s, d).groupBy("instrument_id", "trade_sz").agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("rank", average_rank(F.col("n")).cast("double"))


@query("row_index", "SELECT event_id, event_id AS row_nr FROM events")
def _(s, d):
    return with_row_nr(s.read.parquet(f"{d}/events.parquet")).select("event_id", "row_nr")


@query("valid_size", with_quotes(f"SELECT row_nr, CASE WHEN bid_px_0 > 0 AND bid_px_0 < {UND} AND bid_sz_0 > 0 THEN CAST(bid_sz_0 AS DOUBLE) END AS size FROM quotes"))
def _(s, d):
    return quotes(s, d).select("row_nr", filters.valid_size("bid_sz_0", "bid_px_0").alias("size"))


@query("all_filters", with_quotes(f"SELECT row_nr FROM quotes WHERE trade_side = 0 AND trade_sz > 3 AND {VALID}"))
def _(s, d):
    return quotes(s, d).where(filters.all_of([F.col("trade_side") == 0, F.col("trade_sz") > 3, X.bbo_valid()])).select("row_nr")


@query("optional_columns", with_quotes("SELECT row_nr, bid_px_0, ask_px_2 FROM quotes"))
def _(s, d):
    q = quotes(s, d)
    return q.select(relational.existing(q, ["row_nr", "bid_px_0", "bid_px_9", "ask_px_2", "symbol"]))


@query("drop_nulls", with_quotes("SELECT row_nr, trade_side, trade_sz FROM quotes WHERE trade_side IS NOT NULL AND trade_sz IS NOT NULL"))
def _(s, d):
    return quotes(s, d).select("row_nr", "trade_side", "trade_sz").dropna()


@query("display_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS shown FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", sampling.display_time(F.col("ts"), "UTC").alias("shown"))


@query("relative_times", with_quotes("SELECT row_nr, ts_ns - min(ts_ns) OVER () AS x_ns FROM quotes"))
def _(s, d):
    return sampling.relative_ns(quotes(s, d)).select("row_nr", "x_ns")


@query("rows_between", with_quotes("SELECT row_nr, ts_ns FROM quotes WHERE row_nr >= 100 AND row_nr < 300"))
def _(s, d):
    return sampling.rows_between(quotes(s, d), 100, 300).select("row_nr", "ts_ns")


@query("union_of_days", with_quotes("SELECT row_nr, instrument_id FROM quotes UNION ALL SELECT row_nr, instrument_id FROM quotes WHERE trade_side = 1"))
def _(s, d):
    q = quotes(s, d).select("row_nr", "instrument_id", "trade_side")
    return relational.union_same(q, q.where("trade_side = 1")).select("row_nr", "instrument_id")


@query("union_missing_columns", with_quotes("SELECT row_nr, bid_sz_0, CAST(NULL AS BIGINT) AS trade_sz FROM quotes UNION ALL SELECT row_nr, CAST(NULL AS BIGINT), trade_sz FROM quotes"))
def _(s, d):
    q = quotes(s, d)
    return relational.union_relaxed(q.select("row_nr", F.col("bid_sz_0").cast("bigint").alias("bid_sz_0")), q.select("row_nr", F.col("trade_sz").cast("bigint").alias("trade_sz")))


@query("context_join", f"WITH {QUOTES_SQL}, {MBO_SQL} SELECT q.row_nr, q.bid_px_0, m.action, m.size FROM quotes q LEFT JOIN mbo m ON m.row_nr = q.row_nr AND m.instrument_id = q.instrument_id AND m.publisher_id = q.publisher_id")
def _(s, d):
    q = quotes(s, d).select(*KEYS, "row_nr", "bid_px_0")
    return book.with_context(q, mbo(s, d), ["action", "size"]).select("row_nr", "bid_px_0", "action", "size")


@query("nature_tags", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'stress' WHEN event_type = 'click' THEN 'normal' ELSE event_type END AS nature FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    tag = F.when(F.col("event_type") == "view", "Stress_a").when(F.col("event_type") == "click", "b_NORMAL_c").otherwise(F.col("event_type"))
    return e.select("event_id", nature(tag).alias("nature"))


@query("session_days", "SELECT CAST(g AS DATE) AS date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) t(g) WHERE isodow(g) < 6 AND CAST(g AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'signup')")
def _(s, d):
    closed = s.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'").select(F.to_date("ts").alias("date")).distinct()
    return session_days(s, "2024-01-01", "2024-12-31", closed)


# The days that the stock exchange of New York was closed.
_CLOSED = (
    "2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25 2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 "
    "2024-11-28 2024-12-25 2025-01-01 2025-01-09 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27 2025-12-25"
)


@query("calendar_sessions", f"SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE isodow(ts) < 6 AND strftime(ts, '%Y-%m-%d') NOT IN ({', '.join(repr(x) for x in _CLOSED.split())}) GROUP BY 1")
def _(s, d):
    """Events of the days on which the exchange trades."""
    days = s.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("date"))
    return calendars.sessions(days, "us", 2023, 2025).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def _source(s, d) -> DataSource:
    loader = lambda dates: quotes(s, d).withColumn("date", F.date_format("ts_event", "yyyyMMdd"))
    return DataSource(loader, (), "bid_sz_0", ["ask_sz_0", "bid_sz_1"], [F.col("trade_side") == 0, F.col("trade_sz") > 5], weight="trade_sz")


_SOURCE = "SELECT *, strftime(ts_event, '%Y%m%d') AS date FROM quotes WHERE trade_side = 0 OR trade_sz > 5"


@query("source_frame", with_quotes(f"SELECT CAST(ask_sz_0 AS DOUBLE) AS ask_sz_0, CAST(bid_sz_1 AS DOUBLE) AS bid_sz_1, CAST(bid_sz_0 AS DOUBLE) AS bid_sz_0, CAST(trade_sz AS DOUBLE) AS trade_sz, date, row_nr FROM ({_SOURCE})"))
def _(s, d):
    return _source(s, d).frame()


@query("source_labels", with_quotes(f"SELECT date, count(*) AS n, sum(CAST(bid_sz_0 AS DOUBLE)) AS total FROM ({_SOURCE}) GROUP BY 1"))
def _(s, d):
    return _source(s, d).labels().groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("bid_sz_0").alias("total"))


# ---------------------------------------------------------------- books


@query("book_depth", book_sql.depth_rows(3))
def _(s, d):
    return book.build_depth(mbo(s, d), 3)


@query("book_depth_by_ranges", book_sql.depth_rows(3))
def _(s, d):
    """The same rows, each book in many tasks."""
    return build_depth_by_ranges(mbo(s, d), 3, rows=1000, blocks=200)


@query("book_top_of_book", book_sql.replaced_tops())
def _(s, d):
    """Every event as the new top of its side."""
    events = mbo(s, d).withColumns({"action": F.lit("A"), "order_id": F.lit(0), "flags": F.col("flags") + book.TOB})
    return build_depth_by_ranges(events, 1, rows=1000, blocks=200)


@query("book_depth_sql", book_sql.depth_rows(3))
def _(s, d):
    """The same rows from SQL, by a table function."""
    book_sql_function.register(s)
    mbo(s, d).createOrReplaceTempView("depthforge_events")
    return s.sql("SELECT * FROM book_depth(TABLE(depthforge_events), 3)")


@query("book_validation", f"SELECT instrument_id, row_nr, CASE WHEN row_nr % 5 = 0 THEN 'missing_row' ELSE 'different_row' END AS issue FROM ({book_sql.depth_rows(2)}) WHERE row_nr % 5 = 0 OR row_nr % 7 = 0")
def _(s, d):
    """A depth table without every fifth row number, and with other sizes in every seventh, against its events."""
    events = mbo(s, d)
    faulty = book.build_depth(events, 2).where("row_nr % 5 <> 0").withColumn("bid_sz_0", F.col("bid_sz_0") + (F.col("row_nr") % 7 == 0).cast("int"))
    found = validation.validate(faulty, events, 2, rows=1000, blocks=200)
    return found.where("issue not like 'traded%'").select("instrument_id", "row_nr", "issue")


@query("binary_records", f"WITH {MBO_SQL} SELECT instrument_id, action, side, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, max(price) AS price FROM mbo WHERE row_nr >= 100 GROUP BY 1, 2, 3")
def _(s, d):
    """The events written as fixed-width records, and read back."""
    records.register(s)
    path = shared_path(s, "records")
    mbo(s, d).write.format("records").option("width", 1).mode("append").save(path)
    back = s.read.format("records").option("columns", "instrument_id,action,side,size,price,row_nr").load(path)
    return back.where("row_nr >= 100").groupBy("instrument_id", "action", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("price").alias("price"))


@query("book_stats", book_sql.replay_counters(3))
def _(s, d):
    return book.book_stats(mbo(s, d), 3)


@query("book_trades", f"WITH {MBO_SQL} SELECT instrument_id, CAST(sum(size) AS BIGINT) AS traded, count(*) AS trades FROM mbo WHERE action = 'T' GROUP BY 1")
def _(s, d):
    """What the depth rows say was traded is what the events traded."""
    return book.build_depth(mbo(s, d), 1).where("trade_sz is not null").groupBy("instrument_id").agg(F.sum("trade_sz").alias("traded"), F.sum("trade_levels").cast("bigint").alias("trades"))


# ---------------------------------------------------------------- streams


def _drained(s: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream over the files there are gives, written by its tasks to the folder that all executors share."""
    path = shared_path(s, name)
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/offsets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{path}/rows")


@query("stream_ewma", with_quotes(f", {decay_sql('c_a', 'quotes', 'trade_sz', HOUR)} SELECT row_nr, round(c_a.s, 6) AS value FROM c_a"))
def _(s, d):
    q = quotes_of(event_stream(s, d)).select(*KEYS, "row_nr", "ts_ns", F.col("trade_sz").cast("double").alias("x"))
    return _drained(s, states.stream_decayed(q, [Decay("value", "x", HOUR)], KEYS), "stream_ewma").select("row_nr", F.round("value", 6).alias("value"))


@query("stream_future_return", with_quotes(f", {asof_sql('f', 'quotes', GOOD, HOUR)} SELECT q.row_nr, round((f.v / ({GOOD}) - 1) * 1e4, 6) AS value, false AS late FROM quotes q JOIN f ON f.row_nr = q.row_nr JOIN f_p ON f_p.row_nr = q.row_nr WHERE f_p.t + {HOUR} <= f_p.e"))
def _(s, d):
    """The label of every row whose hour has closed an hour before its key's last row."""
    q = quotes_of(event_stream(s, d)).select(*KEYS, "row_nr", "ts_ns", good_mid().alias("price"))
    out = _drained(s, event_time.stream_future_price(q, "price", "1h", delay="1h"), "stream_future_return")
    return out.select("row_nr", F.round((X.fdiv(F.col("future_price"), F.col("price")) - 1.0) * 1e4, 6).alias("value"), "late")


@query("stream_ewma_in_order", with_quotes(f", {decay_sql('c_a', 'quotes', 'trade_sz', HOUR)}, e AS (SELECT row_nr, ts_ns, max(ts_ns) OVER (PARTITION BY instrument_id) AS e FROM quotes) SELECT row_nr, round(c_a.s, 6) AS value FROM c_a JOIN e USING (row_nr) WHERE ts_ns + {6 * HOUR} <= e"))
def _(s, d):
    """Decayed sums of a stream whose rows may be six hours out of order."""
    q = quotes_of(event_stream(s, d)).select(*KEYS, "row_nr", "ts_ns", F.col("trade_sz").cast("double").alias("x"))
    out = _drained(s, event_time.stream_decayed_in_order(q, [Decay("value", "x", HOUR)], "6h"), "stream_ewma_in_order")
    return out.select("row_nr", F.round("value", 6).alias("value"))


@query("stream_book", book_sql.closed_depth_rows(3))
def _(s, d):
    return _drained(s, states.stream_depth(mbo_of(event_stream(s, d)), 3), "stream_book")


# ---------------------------------------------------------------- flagship


FLAGSHIP_SQL = with_quotes(
    f", {asof_sql('f', 'quotes', GOOD, HOUR)}, pred AS (SELECT q.row_nr, {balance_sql(depth_sql('bid', 3), depth_sql('ask', 3), True)} AS p, (f.v / ({GOOD}) - 1) * 1e4 AS y FROM quotes q JOIN f ON f.row_nr = q.row_nr WHERE {VALID} AND f.v IS NOT NULL), {_RANKED} "
    "SELECT decile, count(*) AS n, round(avg(p), 6) AS mean_signal, round(avg(y), 6) AS mean_return FROM dc GROUP BY decile"
)


@query("imbalance_decile_returns", FLAGSHIP_SQL)
def flagship(s: SparkSession, d: str) -> DataFrame:
    """Mean return an hour ahead by decile of the book's imbalance."""
    df = asof.add_return(quotes(s, d), good_mid(), "1h").withColumn("signal", F.round(X.book_imbalance(3, log=True), 12))
    ok = df.where(X.bbo_valid() & F.col("return_bps").isNotNull())
    return reports.decile_report(ok, "signal", "return_bps").select("decile", "n", F.round("mean_prediction", 6).alias("mean_signal"), F.round("mean_return", 6).alias("mean_return"))


