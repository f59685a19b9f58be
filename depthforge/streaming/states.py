"""Streaming forms of the decayed sum and of the book: one state per key, kept by Structured Streaming.

Rows of a key must reach the stream in order across micro-batches; inside one they are sorted, in runs on the worker's
disk that are merged, so that no task holds a micro-batch.  The state of a key that isn't seen for ``idle_ms`` of processing time is dropped, and the key starts anew; without it, state stays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from depthforge.operators.book import EVENTS, KEYS, Book, depth_schema
from depthforge.operators.kernels import Decay, State
from depthforge.streaming.runs import Runs


def stream_decayed(df: DataFrame, decays: Sequence[Decay], keys: Sequence[str], order: str = "row_nr", time: str = "ts_ns", idle_ms: int | None = None) -> DataFrame:
    """The stream ``df`` with a column for each decay; same values as the batch form."""
    decays, keys = list(decays), list(keys)
    out = StructType([*df.schema.fields, *(StructField(d.name, DoubleType()) for d in decays)])
    kept = StructType([StructField("state", BinaryType())])

    def step(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        held = [State(d) for d in decays]
        if state.exists:
            for s, (t, v) in zip(held, pickle.loads(bytes(state.get[0])), strict=True):
                s.time, s.value = t, v
        for rows in _in_order(frames, order):
            t, new = rows[time].to_numpy("int64"), {}
            for s, d in zip(held, decays, strict=True):
                x = pd.to_numeric(rows[d.value]).to_numpy("float64", na_value=float("nan"))
                values, void = s.run(x, rows[d.value].isna().to_numpy(), t)
                new[d.name] = pd.Series(values, index=rows.index).mask(void)
            yield rows.assign(**new)[out.names]
        state.update((pickle.dumps([(s.time, s.value) for s in held]),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return df.groupBy(*keys).applyInPandasWithState(step, out, kept, "append", _timeout(idle_ms))


def _in_order(frames: Iterator[pd.DataFrame], order: str) -> Iterator[pd.DataFrame]:
    runs = Runs([order])
    for rows in frames:
        runs.add(rows)
    return runs.merged()


def _timeout(idle_ms: int | None) -> str:
    return "ProcessingTimeTimeout" if idle_ms else "NoTimeout"


def stream_depth(events: DataFrame, levels: int = 5, idle_ms: int | None = None) -> DataFrame:
    """Depth rows of a stream of events as blocks end; an open block waits for its end, or goes with its book's state."""
    out, kept = depth_schema(levels), StructType([StructField("state", BinaryType())])

    def step(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        book = pickle.loads(bytes(state.get[0])) if state.exists else Book(levels)
        for came in _in_order(frames, "row_nr"):
            rows = []
            for event in came[list(EVENTS)].itertuples(index=False, name=None):
                ts, row_nr, sequence, action, side, price, size, order, flags = event
                rows += [(*key, *r) for r in book.push(int(ts), int(row_nr), int(sequence), action, side, int(price), int(size), int(order), int(flags))]
            frame = pd.DataFrame(rows, columns=out.names)
            for c in ("trade_px", "trade_sz", "trade_side", "trade_px_last", "trade_levels", "trade_fills", "trade_posted_sz"):
                frame[c] = frame[c].astype("Int64")
            yield frame
        state.update((pickle.dumps(book),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return events.groupBy(*(k for k, _ in KEYS)).applyInPandasWithState(step, out, kept, "append", _timeout(idle_ms))
