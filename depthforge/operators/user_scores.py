"""A user's own score in Python, as an aggregate of mergeable states.

Tasks fold their Arrow batches into one state per group, states of a group meet sorted by group and are combined one
after another, and the score is a value of the last.  A task holds the states of ``GROUPS`` groups at most and hands
them on when there are more; it never holds a group's rows.  States of parts, kept by :func:`state`, add up by
:func:`merge` like those of the built-in scores.

A state is a dictionary of numbers.  Null values reach the score as NaN.  Null groups are groups.  An empty table has
no groups, and without grouping columns the value of the first state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.functions.exprs import num

State = dict[str, float]
GROUPS = 10_000


@dataclass(frozen=True)
class UserScore:
    """``update(state, *arrays)`` takes rows in, ``combine(a, b)`` joins two states, ``value(state)`` is the score."""

    name: str
    columns: Sequence[str]
    start: Callable[[], State]
    update: Callable[..., State]
    combine: Callable[[State, State], State]
    value: Callable[[State], float]


def state(df: DataFrame, score: UserScore, by: Sequence[str] = ()) -> DataFrame:
    """(by, state): a row per group, or one row."""
    by = list(by)
    hidden = [f"_v{i}" for i in range(len(score.columns))]
    slim = df.select(*by, *(num(F.col(c)).alias(h) for c, h in zip(score.columns, hidden, strict=True)))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def run(batches):
        held: dict[tuple, State] = {}
        seen = None

        def table():
            keys = [pa.array([k[j] for k in held], seen.schema.field(n).type) for j, n in enumerate(by)]
            made = pa.array([[*s.items()] for s in held.values()], pa.map_(pa.string(), pa.float64()))
            held.clear()
            return pa.RecordBatch.from_arrays([*keys, made], names=[*by, "state"])

        for batch in batches:
            seen = batch
            n = batch.num_rows
            if not n:
                continue
            values = [batch.column(h).to_numpy(zero_copy_only=False).astype(float) for h in hidden]
            code = np.zeros(n, np.int64)
            for k in by:
                one = batch.column(k).dictionary_encode(null_encoding="encode")
                code = np.unique(code * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                key = tuple(batch.column(k)[int(own[0])].as_py() for k in by)
                held[key] = score.update(held[key] if key in held else score.start(), *(v[own] for v in values))
            if len(held) > GROUPS:
                yield table()
        if held:
            yield table()

    parts = slim.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "state map<string,double>"]))
    return merge(parts, score, by)


def merge(states: DataFrame, score: UserScore, by: Sequence[str] = ()) -> DataFrame:
    """The states of each group combined."""
    by = list(by)

    def run(batches):
        current, held, kinds, out = None, None, None, []

        def table():
            keys = [pa.array([k[j] for k, _ in out], kinds[j]) for j in range(len(by))]
            made = pa.array([[*s.items()] for _, s in out], pa.map_(pa.string(), pa.float64()))
            out.clear()
            return pa.RecordBatch.from_arrays([*keys, made], names=[*by, "state"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in by]
            for r in range(batch.num_rows):
                key = tuple(batch.column(k)[r].as_py() for k in by)
                one = dict(batch.column("state")[r].as_py())
                if held is not None and key == current:
                    held = score.combine(held, one)
                else:
                    if held is not None:
                        out.append((current, held))
                    current, held = key, one
            if len(out) >= GROUPS:
                yield table()
        if held is not None:
            out.append((current, held))
        if out:
            yield table()

    dealt = states.select(*by, "state")
    dealt = dealt.repartition(*by).sortWithinPartitions(*by) if by else dealt.repartition(1)  # a state per task
    return dealt.mapInArrow(run, dealt.schema)


def values(states: DataFrame, score: UserScore, by: Sequence[str] = ()) -> DataFrame:
    """(by, score) of the groups' states."""
    by = list(by)

    def run(batches):
        for batch in batches:
            done = pa.array([float(score.value(dict(s.as_py()))) for s in batch.column("state")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in by), done], names=[*by, score.name])

    kinds = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    out = states.select(*by, "state").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), f"`{score.name}` double"]))
    if by:
        return out
    first = states.sparkSession.createDataFrame([(float(score.value(score.start())),)], f"`{score.name}` double")
    one = out.withColumn("_i", F.lit(0)).unionByName(first.withColumn("_i", F.lit(1)))  # two rows at most
    return one.orderBy("_i").limit(1).drop("_i")


def evaluate(df: DataFrame, score: UserScore, by: Sequence[str] = ()) -> DataFrame:
    return values(state(df, score, by), score, by)
