"""The decayed sum, the one sequential function that windows can't express.

``s_i = s_(i-1) * exp(-rate * max(t_i - t_(i-1), 0)) + x_i`` along the rows of a key.  Rows are dealt out and sorted by
key once and folded batch by batch, any number of inputs and half-lives in one pass, with one number of state each;
inside a batch the recurrence is a prefix sum over blocks in which the weights stay in range.

Normalised averages ``y_i = a x_i + (1 - a) y_(i-1)``, ``a = 1 - exp(-rate * dt)``, over the rows that aren't null,
are the same sum of ``a_i x_i``; other rows keep the last value.  A second value at one time has weight 0.
Times that run backwards count as no time, and the later time is compared with them.  A NaN stays in the sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from depthforge.operators.ordering import KEYS, ORDER

#: Exponents in a block: e**600 times any sum of practical values is finite.
RANGE = 600.0


@dataclass(frozen=True)
class Decay:
    """One output column of the kernel."""

    name: str
    value: str
    half_life_ns: int
    normalized: bool = False


def scan(x: np.ndarray, step: np.ndarray, start: float) -> np.ndarray:
    """s_i = s_(i-1) * exp(-step_i) + x_i from s_(-1) = start."""
    out = np.empty(len(x))
    level = np.cumsum(step)  # finds the blocks; inside one, steps are summed anew, so that far gaps before it cost no digits
    a, s = 0, start
    while a < len(x):
        b = int(np.searchsorted(level, level[a] + RANGE, "right"))
        head = s * math.exp(-min(step[a], 745.0)) + x[a]
        rise = np.zeros(b - a)
        np.cumsum(step[a + 1 : b], out=rise[1:])
        grown = x[a:b] * np.exp(rise)
        grown[0] = head
        with np.errstate(over="ignore", invalid="ignore"):
            out[a:b] = np.cumsum(grown) * np.exp(-rise)
        s, a = float(out[b - 1]), b
    return out


class State:
    """What a decay remembers of a key: last time and value."""

    __slots__ = ("rate", "normalized", "time", "value")

    def __init__(self, decay: Decay):
        self.rate, self.normalized = math.log(2.0) / decay.half_life_ns, decay.normalized
        self.reset()

    def reset(self):
        self.time, self.value = None, None

    def run(self, x: np.ndarray, null: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, nulls) of consecutive rows of one key."""
        if self.normalized:
            at = np.flatnonzero(~null)
            out, void = np.full(len(x), np.nan if self.value is None else self.value), np.full(len(x), self.value is None)
            if not len(at):
                return out, void
            y = self._sum(x[at], t[at])
            which = np.cumsum(~null) - 1
            seen = which >= 0
            out[seen], void[seen] = y[which[seen]], False
            return out, void
        return self._sum(np.where(null, 0.0, x), t), np.zeros(len(x), bool)

    def _sum(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        first = self.time is None
        dt = np.diff(t, prepend=t[0] if first else self.time)
        step = self.rate * np.maximum(dt, 0)
        u = -np.expm1(-step) * x if self.normalized else x.astype(float)
        if self.normalized and first:
            u[0] = x[0]
        out = scan(u, step, 0.0 if first else self.value)
        self.time, self.value = int(t[-1]), float(out[-1])
        return out


def segments(batch: pa.RecordBatch, keys: list[str], current):
    """(starts and the end, whether each start is a new key, the last key) of the runs of one key in a batch."""
    n = batch.num_rows
    rows = pa.RecordBatch.from_arrays([batch.column(k) for k in keys], names=keys) if keys else None
    change = np.zeros(n, bool)
    if keys:
        firsts = tuple(c[0].as_py() for c in rows.columns)
        for c in rows.columns:
            codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        change[0] = firsts != current
        current = tuple(c[n - 1].as_py() for c in rows.columns)
    return [0, *(int(i) for i in np.flatnonzero(change) if i), n], change, current


def _input(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = batch.column(name)
    return np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float), nan=np.nan), np.asarray(c.is_null())


def _times(batch: pa.RecordBatch, time: str) -> np.ndarray:
    return batch.column(time).to_numpy(zero_copy_only=False).astype(np.int64)


def _folded(df: DataFrame, decays: list[Decay], keys: list[str], time: str, carried: list[tuple[str, str]] = (), precision: str = "float64") -> DataFrame:
    """The sorted rows of ``df`` with their decays.

    ``carried`` names each decay's columns of a time and a value, the last columns but a flag.  A run of a key then begins
    with a row whose flag is 0, none of the table's: the states begin with what it says.
    """
    own = df.schema.fields[: len(df.schema.fields) - 2 * len(carried) - 1] if carried else df.schema.fields
    kind = {"float64": DoubleType(), "float32": FloatType()}[precision]
    schema = StructType([*own, *(StructField(d.name, kind) for d in decays)])
    flag = df.columns[-1]

    def fold(batches):
        states, current = [State(d) for d in decays], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cuts, change, current = segments(batch, keys, current)
            rows = batch.column(flag).to_numpy(zero_copy_only=False) > 0 if carried else np.ones(n, bool)
            t = np.zeros(n, np.int64)
            t[rows] = _times(batch.filter(pa.array(rows)), time)
            inputs = {d.value: _input(batch, d.value) for d in decays}
            outs = [np.empty(n) for _ in decays]
            voids = [np.zeros(n, bool) for _ in decays]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if change[a]:
                    for s in states:
                        s.reset()
                    if not rows[a]:
                        for s, (at, value) in zip(states, carried, strict=True):
                            s.time, s.value = batch.column(at)[a].as_py(), batch.column(value)[a].as_py()
                        a += 1
                if a < b:
                    for s, d, o, v in zip(states, decays, outs, voids, strict=True):
                        x, null = inputs[d.value]
                        o[a:b], v[a:b] = s.run(x[a:b], null[a:b], t[a:b])
            done = pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *(pa.array(o.astype(precision), mask=v) for o, v in zip(outs, voids, strict=True))], names=schema.names)
            yield done.filter(pa.array(rows)) if carried else done

    return df.mapInArrow(fold, schema)


def decayed(df: DataFrame, decays: Sequence[Decay], keys: Sequence[str] = KEYS, order: str = ORDER, time: str = "ts_ns", placed: bool = False, width: int | None = None, precision: str = "float64") -> DataFrame:
    """``df`` with a column for each decay, along ``order`` within ``keys``; ``placed``: its rows are dealt out by them already.

    One key's rows pass through one task in order (state is sequential), in Arrow batches, not as a group in memory.
    With ``width`` they pass through as many as there are ranges of so many steps of ``order`` (a number): see
    :func:`decayed_by_ranges`.  States are doubles; ``precision`` float32 rounds what comes out.
    """
    decays, keys = list(decays), list(keys)
    if not decays:
        return df
    if width:
        return decayed_by_ranges(df, decays, width, keys, order, time, precision)
    dealt = df if placed else df.repartition(*keys) if keys else df.repartition(1)
    return _folded(dealt.sortWithinPartitions(*keys, order), decays, keys, time, precision=precision)


# ---------------------------------------------------------------- ranges of a key


def effect(decay: Decay, x: np.ndarray, null: np.ndarray, t: np.ndarray) -> tuple | None:
    """What rows of a key do to whatever came before: (first time, last time, exponent, head, rest); None if nothing.

    A value v at time u before them becomes v * exp(-exponent - rate * (first - u)) + weight * head + rest, where the
    weight of the first row is 1, or for an average that of the time since u.  Effects of neighbours compose.
    """
    if decay.normalized:
        x, t = x[~null], t[~null]
    else:
        x = np.where(null, 0.0, x)
    if not len(x):
        return None
    state = State(decay)
    exponent = float((state.rate * np.maximum(np.diff(t), 0)).sum())
    zero = np.zeros(len(x), bool)
    tail = x.copy()
    tail[0] = 0.0
    state.run(tail, zero, t)
    return int(t[0]), int(t[-1]), exponent, float(x[0] * math.exp(-min(exponent, 745.0))), state.value


def followed(decay: Decay, time: int | None, value: float | None, first: int, last: int, exponent: float, head: float, rest: float) -> tuple[int, float]:
    """Time and value after rows of that effect."""
    if time is None:
        return last, head + rest
    gap = math.log(2.0) / decay.half_life_ns * max(first - time, 0)
    weight = -math.expm1(-gap) if decay.normalized else 1.0
    return last, value * math.exp(-min(gap + exponent, 745.0)) + weight * head + rest


def decayed_by_ranges(df: DataFrame, decays: Sequence[Decay], width: int, keys: Sequence[str] = KEYS, order: str = ORDER, time: str = "ts_ns", precision: str = "float64") -> DataFrame:
    """:func:`decayed`, the rows of a key being dealt out by ranges of ``width`` steps of ``order``.

    The sums are an associative scan.  A pass over the ranges gives each one's effect, a few numbers; these small rows
    are composed along each key, and a second pass starts every range from what came before it.  A key may hold all
    rows: no task gets more than a range at a time.  Rows alike in ``order`` are in one range, so ties at its borders
    and times that run backwards over them come out as in one fold.  A null order is a range of its own, the first.
    """
    decays, keys = list(decays), list(keys)
    if width < 1:
        raise ValueError("a range is one step wide at least")
    part = "_range" + "_" * max(len(c) for c in df.columns)  # longer than any column
    ranged = df.withColumn(part, F.floor(F.col(order) / width).cast("bigint"))
    runs = [*keys, part]
    parts = ("first", "last", "exponent", "head", "rest")
    kinds = ("bigint", "bigint", "double", "double", "double")
    fields = [(f"{part}{p}{i}", k) for i in range(len(decays)) for p, k in zip(parts, kinds, strict=True)]
    key_kinds = [(f.name, f.dataType.simpleString()) for f in ranged.schema.fields if f.name in runs]
    key_kinds.sort(key=lambda x: runs.index(x[0]))
    ddl = lambda pairs: ", ".join(f"`{n}` {k}" for n, k in pairs)
    arrow = {"bigint": pa.int64(), "double": pa.float64()}

    def summed(batches):
        current, held = None, None  # effects of the range that is open
        out: list[tuple] = []

        def joined(old, new, d):
            if old is None or new is None:
                return new if old is None else old
            last, rest = followed(d, old[1], old[4], *new)  # what follows the rest of the old rows
            head = old[3] * math.exp(-min(new[2] + math.log(2.0) / d.half_life_ns * max(new[0] - old[1], 0), 745.0))
            exponent = old[2] + new[2] + math.log(2.0) / d.half_life_ns * max(new[0] - old[1], 0)
            return old[0], last, exponent, head, rest

        def table(key_batch):
            cols = [pa.array([k[j] for k, _ in out], key_batch.schema.field(n).type) for j, n in enumerate(runs)]
            flat = [[v for e in es for v in (e or (None,) * 5)] for _, es in out]
            cols += [pa.array([f[j] for f in flat], arrow[k]) for j, (_, k) in enumerate(fields)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*runs, *(n for n, _ in fields)])

        last_batch = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last_batch = batch
            before = current
            cuts, change, current = segments(batch, runs, current)
            t = _times(batch, time)
            inputs = {d.value: _input(batch, d.value) for d in decays}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if change[a]:
                    if held is not None:
                        out.append((before, held))
                    held = [None] * len(decays)
                    before = tuple(batch.column(k)[a].as_py() for k in runs)
                held = [joined(h, effect(d, inputs[d.value][0][a:b], inputs[d.value][1][a:b], t[a:b]), d) for h, d in zip(held, decays, strict=True)]
            if len(out) > 10_000:
                yield table(batch)
        if held is not None:
            out.append((current, held))
        if out:
            yield table(last_batch)

    def carried(batches):
        states, current = [(None, None)] * len(decays), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            cuts, change, current = segments(batch, keys, current)
            starts = set(np.flatnonzero(change).tolist())
            cells = [batch.column(n).to_pylist() for n, _ in fields]
            for r in range(batch.num_rows):
                if r in starts:
                    states = [(None, None)] * len(decays)
                rows.append([x for s in states for x in s])
                for i, d in enumerate(decays):
                    e = [c[r] for c in cells[5 * i : 5 * i + 5]]
                    if e[0] is not None:
                        states[i] = followed(d, *states[i], *e)
            cols = [pa.array([x[j] for x in rows], pa.int64() if j % 2 == 0 else pa.float64()) for j in range(2 * len(decays))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in runs), *cols], names=[*runs, *(n for pair in names for n in pair)])

    names = [(f"{part}time{i}", f"{part}value{i}") for i in range(len(decays))]
    needed = ranged.select(*dict.fromkeys([*runs, time, order, *(d.value for d in decays)])).repartition(*runs)
    effects = needed.sortWithinPartitions(*runs, order).mapInArrow(summed, f"{ddl(key_kinds)}, {ddl(fields)}")
    placed = (effects.repartition(*keys) if keys else effects.repartition(1)).sortWithinPartitions(*runs)
    begins = [x for a, b in names for x in ((a, "bigint"), (b, "double"))]
    carries = placed.mapInArrow(carried, f"{ddl(key_kinds)}, {ddl(begins)}")
    flag = f"{part}flag"
    none = {f.name: F.lit(None).cast(f.dataType) for f in ranged.schema.fields if f.name not in runs}
    both = ranged.select(*ranged.columns, *(F.lit(None).cast(k).alias(n) for n, k in begins), F.lit(1).alias(flag)).unionByName(
        carries.withColumns(none | {flag: F.lit(0)}) if none else carries.withColumn(flag, F.lit(0))
    )
    back = both.repartition(*runs).sortWithinPartitions(*runs, flag, order)
    return _folded(back, decays, runs, time, names, precision).drop(part)
