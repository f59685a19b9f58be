"""Order books from market-by-order events.

Events of a book (publisher, instrument) are applied in row order.  Rows come out only at the end of a block (a row
with the LAST flag) and only if the block traded or moved the first ``levels`` prices: one row per aggressor side
that traded, else one.

State is sequential per book, so events are dealt out by book (and by date, if given: books restart each day), sorted
and folded from Arrow batches; memory is one book per task, not one day of events.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthforge.functions.exprs import UNDEF

LAST, TOB, SNAPSHOT, BAD_TS, MAYBE_BAD = 128, 64, 32, 8, 4
U32 = 4294967295

#: Counters of a replay.
STATS = (
    "rows", "blocks", "trade_blocks", "mixed_side_trade_blocks", "emitted", "unterminated_blocks", "adds", "cancels", "modifies", "clears", "trades_or_fills",
    "sideless_trades", "missing_cancels", "missing_modifies", "duplicate_adds", "zero_size_adds", "bad_sides", "unknown_actions", "ts_regressions",
)


class Side:
    """Price levels of one side: size and order count by price, prices sorted."""

    __slots__ = ("levels", "prices")

    def __init__(self):
        self.levels, self.prices = {}, []

    def clear(self):
        self.levels.clear()
        self.prices.clear()

    def put(self, price: int, size: int):
        level = self.levels.get(price)
        if level is None:
            self.levels[price] = [size, 1]
            insort(self.prices, price)
        else:
            level[0] += size
            level[1] += 1

    def take(self, price: int, size: int, order_gone: bool):
        level = self.levels.get(price)
        if level is None:
            return
        level[0] = max(0, level[0] - size)
        if order_gone:
            level[1] = max(0, level[1] - 1)
        if not level[0] or not level[1]:
            del self.levels[price]
            del self.prices[bisect_left(self.prices, price)]

    def top(self, n: int, highest: bool) -> list[tuple[int, int, int]]:
        best = self.prices[: -n - 1 : -1] if highest else self.prices[:n]
        out = [(p, *self.levels[p]) for p in best]
        return out + [(UNDEF, 0, 0)] * (n - len(out))


class Trade:
    """What one aggressor side traded in a block."""

    __slots__ = ("side", "meta", "qty", "priced", "notional", "prices", "levels", "fills", "posted", "ids")

    def __init__(self, side: str, meta: tuple):
        self.side, self.meta = side, meta
        self.qty = self.priced = self.levels = self.fills = self.posted = 0
        self.notional, self.prices, self.ids = 0.0, [], set()

    def add(self, price: int, size: int, order: int):
        self.qty += size
        self.levels += 1
        if price != UNDEF:
            self.priced += size
            self.notional += float(price) * float(size)
            # first, last, lowest, highest
            p = self.prices
            self.prices = [p[0], price, min(p[2], price), max(p[3], price)] if p else [price] * 4
        if order:
            self.ids.add(order)

    def columns(self) -> tuple:
        best = worst = None
        if self.prices:
            first, last, low, high = self.prices
            best, worst = {"B": (low, high), "A": (high, low)}.get(self.side, (first, last))
        code = {"B": 0, "A": 1}.get(self.side)
        vwap = self.notional / self.priced if self.priced else None
        return best, min(self.qty, U32), code, worst, vwap, self.levels, self.fills, min(self.posted, U32)


class Book:
    """One book and its open block."""

    def __init__(self, levels: int):
        self.n = levels
        self.orders: dict[int, tuple[str, int, int]] = {}
        self.sides = {"B": Side(), "A": Side()}
        self.pending: list[Trade] = []
        self.dirty, self.meta, self.prev_ts = False, None, None
        self.last_top = self.top()
        self.stats = dict.fromkeys(STATS, 0)

    def top(self) -> tuple:
        return self.sides["B"].top(self.n, True), self.sides["A"].top(self.n, False)

    def _add(self, order: int, side: str, price: int, size: int):
        if order and price != UNDEF and size:
            self.orders[order] = (side, price, size)
            self.sides[side].put(price, size)

    def _drop(self, order: int) -> bool:
        old = self.orders.pop(order, None)
        if old:
            self.sides[old[0]].take(old[1], old[2], True)
        return old is not None

    def _apply(self, action: str, side: str, price: int, size: int, order: int, flags: int):
        s = self.stats
        if action == "R":
            s["clears"] += 1
            self.orders.clear()
            for x in self.sides.values():
                x.clear()
        elif action == "A":
            s["adds"] += 1
            if side not in self.sides:
                s["bad_sides"] += 1
            elif flags & TOB:
                self.sides[side].clear()
                if price != UNDEF and size:
                    self.sides[side].put(price, size)
            elif not size:
                s["zero_size_adds"] += 1
            else:
                s["duplicate_adds"] += self._drop(order)
                self._add(order, side, price, size)
        elif action == "C":
            s["cancels"] += 1
            old = self.orders.get(order)
            if old is None:
                s["missing_cancels"] += 1
                return
            gone = min(size, old[2])
            rest = old[2] - gone
            self.sides[old[0]].take(old[1], gone, False)
            if rest:
                self.orders[order] = (old[0], old[1], rest)
            else:
                self.sides[old[0]].take(old[1], 0, True)
                del self.orders[order]
        elif action == "M":
            s["modifies"] += 1
            if side not in self.sides:
                s["bad_sides"] += 1
                return
            s["missing_modifies"] += not self._drop(order)
            self._add(order, side, price, size)
        else:
            s["unknown_actions"] += 1

    def push(self, ts: int, row_nr: int, sequence: int, action: str, side: str, price: int, size: int, order: int, flags: int) -> list[tuple]:
        """Rows that this event's block gives, usually none."""
        s = self.stats
        s["rows"] += 1
        s["ts_regressions"] += self.prev_ts is not None and ts < self.prev_ts
        self.prev_ts, self.dirty, self.meta = ts, True, (ts, row_nr, sequence)
        if action == "T":
            s["trades_or_fills"] += 1
            s["sideless_trades"] += side == "N"
            mine = next((t for t in self.pending if t.side == side), None)
            if mine is None:
                mine = Trade(side, self.meta)
                self.pending.append(mine)
            mine.add(price, size, order)
        elif action == "F":
            s["trades_or_fills"] += 1
            met = next((t for t in self.pending if t.side not in (side, "N")), None)
            if met:
                met.fills += 1
        elif action == "N":
            s["trades_or_fills"] += 1
        else:
            if action == "A" and order:
                for t in self.pending:
                    if order in t.ids:
                        t.posted += size
            self._apply(action, side, price, size, order, flags)
        return self.close() if flags & LAST else []

    def close(self) -> list[tuple]:
        s, top = self.stats, self.top()
        s["blocks"] += 1
        changed = top != self.last_top
        flat = [x for side in zip(*top, strict=True) for level in side for x in level]
        rows = []
        if self.pending:
            s["trade_blocks"] += 1
            s["mixed_side_trade_blocks"] += len(self.pending) > 1
            for t in self.pending:
                meta = self.meta if t is self.pending[-1] else t.meta
                rows.append((*meta, *t.columns(), *flat))
            self.pending = []
        elif changed:
            rows.append((*self.meta, *[None] * 8, *flat))
        s["emitted"] += len(rows)
        self.last_top, self.dirty = top, False
        return rows

    def finish(self) -> list[tuple]:
        """The block left open at the end."""
        if not self.dirty:
            return []
        self.stats["unterminated_blocks"] += 1
        return self.close()


KEYS = (("publisher_id", T.IntegerType()), ("instrument_id", T.LongType()))
TRADE = (
    ("trade_px", T.LongType()), ("trade_sz", T.LongType()), ("trade_side", T.IntegerType()), ("trade_px_last", T.LongType()),
    ("trade_vwap", T.DoubleType()), ("trade_levels", T.IntegerType()), ("trade_fills", T.IntegerType()), ("trade_posted_sz", T.LongType()),
)
EVENTS = ("ts_ns", "row_nr", "sequence", "action", "side", "price", "size", "order_id", "flags")


def depth_schema(levels: int, date: str | None = None) -> T.StructType:
    kinds = (("px", T.LongType()), ("sz", T.LongType()), ("ct", T.IntegerType()))
    meta = [("ts_ns", T.LongType()), ("row_nr", T.LongType()), ("sequence", T.LongType())]
    book = [(f"{s}_{k}_{i}", t) for i in range(levels) for s in ("bid", "ask") for k, t in kinds]
    return T.StructType([T.StructField(n, t) for n, t in [*([(date, T.StringType())] if date else []), *KEYS, *meta, *TRADE, *book]])


def depth_columns(levels: int) -> list[str]:
    return depth_schema(levels).names


def _replay(events: DataFrame, levels: int, date: str | None, rows_out: bool):
    """mapInArrow function over events sorted by book and row."""
    keys = [*([date] if date else []), *(k for k, _ in KEYS)]
    schema = depth_schema(levels, date) if rows_out else _stats_schema(date)
    from pyspark.sql.pandas.types import to_arrow_schema

    def fold(batches):
        kind = to_arrow_schema(schema)
        current, book, out = None, None, []

        def table():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
            out.clear()
            return made

        def done():
            if book is not None:
                last = book.finish()
                out.extend((*current, *r) for r in last) if rows_out else out.append((*current, *book.stats.values()))

        for batch in batches:
            for key, event in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in EVENTS), strict=True), strict=True):
                if key != current:
                    done()
                    current, book = key, Book(levels)
                made = book.push(*event)
                if made and rows_out:
                    out.extend((*key, *r) for r in made)
                if len(out) >= 20_000:
                    yield table()
        done()
        if out:
            yield table()

    return fold, schema


def _stats_schema(date: str | None) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in [*([(date, T.StringType())] if date else []), *KEYS, *((s, T.LongType()) for s in STATS)]])


def typed_events(events: DataFrame, date: str | None = None) -> DataFrame:
    """The keys and columns of a replay, in the types it counts in."""
    kinds = {"ts_ns": "bigint", "row_nr": "bigint", "sequence": "bigint", "price": "bigint", "size": "bigint", "order_id": "decimal(20,0)", "flags": "int", "publisher_id": "int", "instrument_id": "bigint"}
    keys = [*([date] if date else []), *(k for k, _ in KEYS)]
    return events.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in [*keys, *EVENTS]))


def _dealt(events: DataFrame, date: str | None) -> DataFrame:
    keys = [*([date] if date else []), *(k for k, _ in KEYS)]
    return typed_events(events, date).repartition(*keys).sortWithinPartitions(*keys, "row_nr")


def build_depth(events: DataFrame, levels: int = 5, date: str | None = None) -> DataFrame:
    """The depth table of ``events``; see the module."""
    if levels < 1:
        raise ValueError("one level at least")
    fold, schema = _replay(events, levels, date, True)
    return _dealt(events, date).mapInArrow(fold, schema)


def book_stats(events: DataFrame, levels: int = 5, date: str | None = None) -> DataFrame:
    """The counters of each book's replay."""
    fold, schema = _replay(events, levels, date, False)
    return _dealt(events, date).mapInArrow(fold, schema)


def with_context(depth: DataFrame, events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Depth rows with further columns of the event they are named after: by date and book, where both have them, and row."""
    on = [c for c in ("date", *(k for k, _ in KEYS), "row_nr") if c in depth.columns and c in events.columns]
    return depth.join(events.select(*on, *columns), on, "left").select(*depth.columns, *columns)


def write_depth(depth: DataFrame, path: str) -> None:
    depth.write.option("compression", "zstd").parquet(path)
