"""SQL of the book replay and of the linear models, written from their definitions and not from the operators.

The replay is a recursive table of each book's resting orders after each event; levels are sums over the orders.  It
knows what the view of events has: sides A and B, priced events, no top-of-book rows.
"""

from __future__ import annotations

from depthforge.functions.exprs import UNDEF
from depthforge.sources.views import MBO_SQL, QUOTES_SQL

_KEPT = "list_filter(r.orders, lambda x: x.o <> e.order_id)"
_PUT = f"list_append({_KEPT}, {{'o': e.order_id, 'b': e.side, 'p': e.price, 's': CAST(e.size AS BIGINT)}})"
_CUT = "list_filter(list_transform(r.orders, lambda x: {'o': x.o, 'b': x.b, 'p': x.p, 's': CASE WHEN x.o = e.order_id THEN x.s - least(x.s, e.size) ELSE x.s END}), lambda x: x.s > 0)"


def _replay(levels: int) -> str:
    """Tables ev (events with place k and block), replay (orders, known: whether the event's order rested before), ends (last event of each block), book (top levels at the ends), trades (per block and side)."""
    top = [f"{s}_{kind}_{i}" for i in range(levels) for s in ("bid", "ask") for kind in ("px", "sz", "ct")]
    picked = []
    for i in range(levels):
        for s, code in (("bid", "B"), ("ask", "A")):
            picked += [f"CAST(coalesce(max({v}) FILTER (side = '{code}' AND i = {i}), {none}) AS {kind}) AS {s}_{n}_{i}" for n, v, none, kind in (("px", "p", UNDEF, "BIGINT"), ("sz", "s", 0, "BIGINT"), ("ct", "c", 0, "INTEGER"))]
    empty = ", ".join(str(UNDEF if "_px_" in c else 0) for c in top)
    return f"""WITH RECURSIVE {MBO_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY row_nr) AS k, (flags & 128) <> 0 AS ends FROM mbo),
ev AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY instrument_id ORDER BY k) - CASE WHEN ends THEN 1 ELSE 0 END AS block FROM placed),
replay AS (
  SELECT DISTINCT instrument_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(o BIGINT, b VARCHAR, p BIGINT, s BIGINT)[]) AS orders, false AS known FROM mbo
  UNION ALL
  SELECT e.instrument_id, e.k,
    CASE WHEN e.action = 'R' THEN CAST([] AS STRUCT(o BIGINT, b VARCHAR, p BIGINT, s BIGINT)[])
      WHEN e.action IN ('A', 'M') AND e.size > 0 THEN {_PUT} WHEN e.action = 'M' THEN {_KEPT} WHEN e.action = 'C' THEN {_CUT} ELSE r.orders END,
    len({_KEPT}) < len(r.orders)
  FROM replay r JOIN ev e ON e.instrument_id = r.instrument_id AND e.k = r.k + 1
),
last_of AS (SELECT instrument_id, block, max(k) AS k, bool_or(ends) AS closed FROM ev GROUP BY ALL),
ends AS (SELECT l.instrument_id, l.block, l.k, l.closed, e.ts_ns, e.row_nr, e.sequence, r.orders FROM last_of l JOIN ev e USING (instrument_id, k) JOIN replay r USING (instrument_id, k)),
resting AS (SELECT instrument_id, block, unnest(orders) AS x FROM ends),
level AS (SELECT instrument_id, block, x.b AS side, x.p AS p, sum(x.s) AS s, count(*) AS c FROM resting GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, block, side ORDER BY CASE WHEN side = 'B' THEN -p ELSE p END) - 1 AS i FROM level),
tops AS (SELECT e.instrument_id, e.block, {', '.join(picked)} FROM ends e LEFT JOIN ranked USING (instrument_id, block) GROUP BY ALL),
book AS (SELECT *, [{', '.join(top)}] IS DISTINCT FROM lag([{', '.join(top)}], 1, [{empty}]) OVER (PARTITION BY instrument_id ORDER BY block) AS moved FROM tops),
deals AS (
  SELECT instrument_id, block, side, min(k) AS first_k, arg_min(ts_ns, k) AS ts_ns, arg_min(row_nr, k) AS row_nr, arg_min(sequence, k) AS sequence,
    sum(size) AS qty, count(*) AS n, min(price) AS low, max(price) AS high, sum(CAST(price AS DOUBLE) * size) / nullif(sum(size), 0) AS vwap
  FROM ev WHERE action = 'T' GROUP BY ALL
),
trades AS (
  SELECT d.*, first_k = max(first_k) OVER (PARTITION BY instrument_id, block) AS newest,
    (SELECT count(*) FROM ev f WHERE f.instrument_id = d.instrument_id AND f.block = d.block AND f.action = 'F' AND f.side <> d.side AND f.k > d.first_k) AS fills,
    (SELECT coalesce(sum(a.size), 0) FROM ev a WHERE a.instrument_id = d.instrument_id AND a.block = d.block AND a.action = 'A' AND EXISTS (
      SELECT 1 FROM ev t WHERE t.instrument_id = a.instrument_id AND t.block = a.block AND t.action = 'T' AND t.side = d.side AND t.order_id = a.order_id AND t.k < a.k)) AS posted
  FROM deals d
),
out_rows AS (
  SELECT CASE WHEN t.newest IS NOT false THEN e.ts_ns ELSE t.ts_ns END AS ts_ns, CASE WHEN t.newest IS NOT false THEN e.row_nr ELSE t.row_nr END AS row_nr,
    CASE WHEN t.newest IS NOT false THEN e.sequence ELSE t.sequence END AS sequence, CAST(1 AS INTEGER) AS publisher_id, CAST(e.instrument_id AS BIGINT) AS instrument_id, e.block, e.closed,
    CASE WHEN t.side = 'B' THEN t.low ELSE t.high END AS trade_px, CAST(t.qty AS BIGINT) AS trade_sz, CAST(CASE t.side WHEN 'B' THEN 0 WHEN 'A' THEN 1 END AS INTEGER) AS trade_side,
    CASE WHEN t.side = 'B' THEN t.high ELSE t.low END AS trade_px_last, t.vwap AS trade_vwap, CAST(t.n AS INTEGER) AS trade_levels, CAST(t.fills AS INTEGER) AS trade_fills,
    CAST(t.posted AS BIGINT) AS trade_posted_sz, {', '.join(top)}
  FROM ends e JOIN book b USING (instrument_id, block) LEFT JOIN trades t USING (instrument_id, block) WHERE t.side IS NOT NULL OR b.moved
)"""


def depth_rows(levels: int) -> str:
    return f"{_replay(levels)} SELECT * EXCLUDE (block, closed) FROM out_rows"


def closed_depth_rows(levels: int) -> str:
    """Without the block that is open at the end, as a stream leaves it."""
    return f"{_replay(levels)} SELECT * EXCLUDE (block, closed) FROM out_rows WHERE closed"


def replaced_tops() -> str:
    """One level, every event being the new top of its side: the last ones of both sides at the ends of blocks."""
    last = lambda s, c: f"last_value(CASE WHEN side = '{s}' THEN {c} END IGNORE NULLS) OVER w"
    cols = []
    for s in ("bid", "ask"):
        there = f"{s}_s > 0"
        cols += [f"CAST(CASE WHEN {there} THEN {s}_p ELSE {UNDEF} END AS BIGINT) AS {s}_px_0", f"CAST(CASE WHEN {there} THEN {s}_s ELSE 0 END AS BIGINT) AS {s}_sz_0", f"CAST(CASE WHEN {there} THEN 1 ELSE 0 END AS INTEGER) AS {s}_ct_0"]
    top = "[bid_px_0, bid_sz_0, ask_px_0, ask_sz_0]"
    kinds = (("px", "BIGINT"), ("sz", "BIGINT"), ("side", "INTEGER"), ("px_last", "BIGINT"), ("vwap", "DOUBLE"), ("levels", "INTEGER"), ("fills", "INTEGER"), ("posted_sz", "BIGINT"))
    trade = ", ".join(f"CAST(NULL AS {k}) AS trade_{c}" for c, k in kinds)
    return f"""WITH {MBO_SQL},
held AS (SELECT *, {last('B', 'price')} AS bid_p, {last('B', 'size')} AS bid_s, {last('A', 'price')} AS ask_p, {last('A', 'size')} AS ask_s, lead(row_nr) OVER (PARTITION BY instrument_id ORDER BY row_nr) IS NULL AS open_end
  FROM mbo WINDOW w AS (PARTITION BY instrument_id ORDER BY row_nr ROWS UNBOUNDED PRECEDING)),
tops AS (SELECT ts_ns, row_nr, sequence, CAST(1 AS INTEGER) AS publisher_id, CAST(instrument_id AS BIGINT) AS instrument_id, {trade}, {', '.join(cols)} FROM held WHERE flags & 128 <> 0 OR open_end),
moved AS (SELECT *, {top} IS DISTINCT FROM lag({top}, 1, [{UNDEF}, 0, {UNDEF}, 0]) OVER (PARTITION BY instrument_id ORDER BY row_nr) AS moved FROM tops)
SELECT * EXCLUDE (moved) FROM moved WHERE moved"""


def replay_counters(levels: int) -> str:
    n = lambda rule: f"count(*) FILTER ({rule})"
    return f"""{_replay(levels)},
seen AS (SELECT e.*, r.known, e.ts_ns < lag(e.ts_ns) OVER (PARTITION BY e.instrument_id ORDER BY e.k) AS back FROM ev e JOIN replay r USING (instrument_id, k)),
by_event AS (SELECT instrument_id, count(*) AS "rows", {n("action = 'A'")} AS adds, {n("action = 'C'")} AS cancels, {n("action = 'M'")} AS modifies, {n("action = 'R'")} AS clears,
  {n("action IN ('T', 'F', 'N')")} AS trades_or_fills, {n("action = 'T' AND side = 'N'")} AS sideless_trades, {n("action = 'C' AND NOT known")} AS missing_cancels,
  {n("action = 'M' AND NOT known")} AS missing_modifies, {n("action = 'A' AND size > 0 AND known")} AS duplicate_adds, {n("action = 'A' AND size = 0")} AS zero_size_adds,
  {n("action IN ('A', 'M') AND side NOT IN ('A', 'B')")} AS bad_sides, {n("action NOT IN ('A', 'C', 'M', 'R', 'T', 'F', 'N')")} AS unknown_actions, {n('back')} AS ts_regressions FROM seen GROUP BY ALL),
sides AS (SELECT instrument_id, block, count(*) AS n FROM deals GROUP BY ALL),
by_block AS (SELECT instrument_id, count(*) AS blocks, count(n) AS trade_blocks, {n('n > 1')} AS mixed_side_trade_blocks, {n('NOT closed')} AS unterminated_blocks FROM ends LEFT JOIN sides USING (instrument_id, block) GROUP BY ALL),
by_row AS (SELECT instrument_id, count(*) AS emitted FROM out_rows GROUP BY ALL)
SELECT CAST(1 AS INTEGER) AS publisher_id, CAST(e.instrument_id AS BIGINT) AS instrument_id, e.* EXCLUDE (instrument_id), b.* EXCLUDE (instrument_id), coalesce(r.emitted, 0) AS emitted
FROM by_event e JOIN by_block b USING (instrument_id) LEFT JOIN by_row r USING (instrument_id)"""


# ---------------------------------------------------------------- linear models


def _moments(features: tuple[str, ...], target: str, pred: str) -> str:
    """Tables quotes, pred, t (with the target), m (means, centred cross products g_ij and c_i, rows n)."""
    k = range(len(features))
    cells = [f"avg({f}) AS m{i}" for i, f in enumerate(features)] + [f"count(*) * covar_pop({f}, t) AS c{i}" for i, f in enumerate(features)]
    cells += [f"count(*) * covar_pop({features[i]}, {features[j]}) AS g{i}{j}" for i in k for j in k if i <= j]
    return f"WITH RECURSIVE {QUOTES_SQL}, {pred}, tt AS (SELECT *, {target} AS t FROM pred), m AS (SELECT avg(t) AS mt, count(*) AS n, {', '.join(cells)} FROM tt)"


def ridge_predictions(pred: str, target: str, alpha: float) -> str:
    """Two features: the normal equations by Cramer's rule."""
    a, c = f"(g00 + {alpha})", f"(g11 + {alpha})"
    det = f"({a} * {c} - g01 * g01)"
    return f"{_moments(('p', 'q0'), target, pred)} SELECT row_nr, round(mt + ({c} * c0 - g01 * c1) / {det} * (p - m0) + ({a} * c1 - g01 * c0) / {det} * (q0 - m1), 6) AS prediction FROM tt, m"


def lasso_scores(pred: str, target: str, alphas: list[float], rounds: int = 200) -> str:
    """Three features: rounds of coordinate descent, each coefficient's correlation shrunk towards zero by the penalty."""
    shrunk = lambda c, g: f"(sign({c}) * greatest(abs({c}) - n * alpha, 0) / {g})"
    step0 = f"SELECT * REPLACE ({shrunk('(c0 - g01 * b1 - g02 * b2)', 'g00')} AS b0) FROM (SELECT d.*, m.* FROM descent d, m WHERE d.r < {rounds})"
    step1 = f"SELECT * REPLACE ({shrunk('(c1 - g01 * b0 - g12 * b2)', 'g11')} AS b1) FROM ({step0})"
    step2 = f"SELECT * REPLACE ({shrunk('(c2 - g02 * b0 - g12 * b1)', 'g22')} AS b2) FROM ({step1})"
    starts = ", ".join(f"({i}, CAST({a} AS DOUBLE))" for i, a in enumerate(alphas))
    error = "t - (mt + b0 * (p - m0) + b1 * (q0 - m1) + b2 * (q1 - m2))"
    return (
        f"{_moments(('p', 'q0', 'q1'), target, pred)}, descent AS (SELECT CAST(0 AS INTEGER) AS r, i, alpha, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM (VALUES {starts}) v(i, alpha) "
        f"UNION ALL SELECT r + 1, i, alpha, b0, b1, b2 FROM ({step2})), "
        f"e AS (SELECT i, sqrt(avg(({error}) * ({error}))) AS rmse FROM tt, m, (SELECT * FROM descent WHERE r = {rounds}) d GROUP BY i) "
        f"SELECT {', '.join(f'round(max(rmse) FILTER (i = {i}), 6) AS alpha_{i}' for i in range(len(alphas)))} FROM e"
    )
