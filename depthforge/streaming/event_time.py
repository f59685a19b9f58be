"""Streams by event time: rows in order again, and labels that look ahead.

A key's watermark is its latest time of earlier micro-batches less a delay.  Rows before it are late: they come out at
once, marked, and enter nothing.  The other rows wait in the key's buffer until the time they need has passed the
watermark, so they may arrive in any order within the delay.  A buffer holds the rows of the delay and the horizon, no
more.  Rows of a micro-batch are merged from sorted runs on disk and leave piece by piece, so it may be of any size.  It is kept as an Arrow stream with its own schema, beside plain numbers, so any reader of the state can use it.

Rows alike in time are ordered by their row number, repeated rows come out as often as they came.  A null time is late.  A key that isn't seen for
``idle_ms`` of processing time is closed: what waits comes out in order, labels beyond its end are null, and the key
starts anew.  Without it rows that wait for later ones stay in the state.  Integer columns other than the keys mustn't be
null, and a NaN price comes out as a null label, since rows pass through pandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from depthforge.functions.durations import horizon_ns
from depthforge.operators.asof import weighted_horizons
from depthforge.operators.kernels import Decay, State
from depthforge.operators.ordering import KEYS, ORDER
from depthforge.streaming.runs import Runs

#: Latest time, late rows so far, the rows that wait, and time and value of each decayed sum.
STATE = StructType([StructField("latest", LongType()), StructField("n_late", LongType()), StructField("rows", BinaryType()), StructField("times", ArrayType(LongType())), StructField("sums", ArrayType(DoubleType()))])

#: Times and values of the sums so far.
Carry = tuple[list, list]


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


def _buffered(
    df: DataFrame, delay_ns: int, ahead_ns: int, added: Sequence[StructField], values: Callable[[pd.DataFrame, int, Carry], tuple[pd.DataFrame, Carry]], keys: Sequence[str], time: str, order: str, idle_ms: int | None
) -> DataFrame:
    """``df`` with columns ``added``, ``late`` and ``n_late``: rows come out once the watermark has passed their time plus ``ahead_ns``.

    ``values`` gets the waiting rows in order, how many of them are complete and what is carried, and returns the columns
    of those and what to carry on.
    """
    keys = list(keys)
    taken = {c.lower() for c in df.columns} & {f.name.lower() for f in (*added, StructField("late", BooleanType()), StructField("n_late", LongType()))}
    if taken:
        raise ValueError(f"columns exist: {sorted(taken)}")
    out = StructType([*df.schema.fields, *added, StructField("late", BooleanType()), StructField("n_late", LongType())])

    def shown(rows: pd.DataFrame, late: bool, n_late: int) -> pd.DataFrame:
        rows = rows.assign(late=late, n_late=n_late)
        for f in added:
            if f.name not in rows:
                rows[f.name] = pd.Series([None] * len(rows), index=rows.index, dtype=object)
        return rows[out.names]

    def step(key, frames: Iterator[pd.DataFrame], state):
        latest, n_late, packed, *carry = state.get if state.exists else (None, 0, None, [], [])
        waiting = _unpack(bytes(packed)) if packed is not None else None
        if state.hasTimedOut:
            state.remove()
            if waiting is not None and len(waiting):
                yield shown(waiting.join(values(waiting, len(waiting), carry)[0]), False, n_late)
            return
        floor = None if latest is None else latest - delay_ns
        runs, marked, blank = Runs([time, order]), Runs([]), waiting
        if waiting is not None and len(waiting):
            runs.add(waiting)
        for came in frames:
            blank = came.iloc[:0] if blank is None else blank
            late = came[time].isna().to_numpy()
            if floor is not None:
                late |= (came[time] < floor).to_numpy()
            if late.any():
                n_late += int(late.sum())
                marked.add(came[late])
                came = came[~late]
            if len(came):
                came = came.assign(**{time: came[time].astype("int64")})
                runs.add(came)
                end = int(came[time].max())
                latest = end if latest is None else max(latest, end)
        for rows in marked.merged():
            yield shown(rows, True, n_late)
        parts, n, kept = [], 0, 0
        for rows in chain(runs.merged(), [blank.iloc[:0]]):
            parts.append(rows)
            n += len(rows)
            if len(rows) and n < 2 * kept:
                continue  # what waits is looked through anew when it has doubled
            rows = pd.concat([x for x in parts if len(x)] or parts, ignore_index=True)
            if n:
                until = latest - delay_ns - ahead_ns
                if len(parts[-1]):  # more may come: what these look ahead to has to be there
                    until = min(until, int(rows[time].iloc[-1]) - (ahead_ns + 1 if ahead_ns else 0))
                done = int(np.searchsorted(rows[time].to_numpy(), until, "right"))
                if done:
                    made, carry = values(rows, done, carry)
                    yield shown(rows.iloc[:done].join(made), False, n_late)
                rows = rows.iloc[done:]
            parts, n, kept = [rows], len(rows), len(rows)
        state.update((latest, n_late, _pack(rows), *carry))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return df.groupBy(*keys).applyInPandasWithState(step, out, STATE, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def _delay(delay: str | None) -> int:
    return horizon_ns(delay) if delay else 0


def stream_in_order(df: DataFrame, delay: str | None = None, keys: Sequence[str] = KEYS, time: str = "ts_ns", order: str = ORDER, idle_ms: int | None = None) -> DataFrame:
    """The rows of the stream ``df`` in the order of time within their key, each micro-batch after the one before, with ``late`` and ``n_late``.

    Rows marked late are out of order.
    """
    return _buffered(df, _delay(delay), 0, [], lambda rows, done, carry: (pd.DataFrame(index=rows.index[:done]), carry), keys, time, order, idle_ms)


def stream_decayed_in_order(
    df: DataFrame, decays: Sequence[Decay], delay: str | None = None, keys: Sequence[str] = KEYS, time: str = "ts_ns", order: str = ORDER, idle_ms: int | None = None
) -> DataFrame:
    """The stream ``df`` with a column for each decay along the order of time: rows wait for those that may yet come before them.

    Late rows enter no sum, and theirs are null.
    """
    decays = list(decays)

    def values(rows: pd.DataFrame, done: int, carry: Carry) -> tuple[pd.DataFrame, Carry]:
        states = [State(d) for d in decays]
        for s, at, value in zip(states, *carry, strict=False):
            s.time, s.value = at, value
        own = rows.iloc[:done]
        t, out = own[time].to_numpy(np.int64), {}
        for s, d in zip(states, decays, strict=True):
            x = pd.to_numeric(own[d.value]).to_numpy(np.float64, na_value=np.nan)
            sums, void = s.run(x, own[d.value].isna().to_numpy(), t)
            out[d.name] = pd.Series(sums, index=own.index).mask(void)
        return pd.DataFrame(out, index=own.index), ([s.time for s in states], [s.value for s in states])

    return _buffered(df, _delay(delay), 0, [StructField(d.name, DoubleType()) for d in decays], values, keys, time, order, idle_ms)


def stream_future_price(
    df: DataFrame, price: str, horizons, weights=1.0, delay: str | None = None, name: str = "future_price", keys: Sequence[str] = KEYS, time: str = "ts_ns", order: str = ORDER, idle_ms: int | None = None
) -> DataFrame:
    """The stream ``df`` with the weighted price as of each horizon, as in the batch form: a row comes out when its longest horizon has closed.

    The price as of t + h is that of the last row at or before it, whatever its value, and a null one makes the label
    null.  Labels of late rows are null, and late rows aren't prices of others.
    """
    pairs = [(h, w) for h, w in weighted_horizons(horizons, weights) if w]
    total = sum(w for _, w in pairs)
    if not pairs or not total:
        raise ValueError("the weights must not add up to zero")

    def values(rows: pd.DataFrame, done: int, carry: Carry) -> tuple[pd.DataFrame, Carry]:
        t = rows[time].to_numpy(np.int64)
        p = pd.to_numeric(rows[price]).to_numpy(np.float64, na_value=np.nan)
        label = np.zeros(len(t))
        for h, w in pairs:
            at = np.searchsorted(t, t + h, "right") - 1
            label += np.where(t + h <= t[-1], p[at], np.nan) * w if len(t) else 0.0
        return pd.DataFrame({name: pd.Series(label / total, index=rows.index).mask(np.isnan(label))}).iloc[:done], carry

    return _buffered(df, _delay(delay), max(h for h, _ in pairs), [StructField(name, DoubleType())], values, keys, time, order, idle_ms)
