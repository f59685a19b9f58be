"""A key's rows of a micro-batch in order, however many they are: sorted runs on the worker's disk, merged piece by piece."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

#: Rows of a run, the most that are sorted at once, and rows of a run that are in memory while runs are merged.
RUN, PIECE = 250_000, 5_000


def _pieces(file) -> Iterator[pd.DataFrame]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _cut(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (rows.iloc[a : a + PIECE] for a in range(0, len(rows), PIECE))


class Runs:
    """Takes frames of rows, and gives their rows back in ``order``, ties as they came, in frames of bounded size."""

    def __init__(self, order: Sequence[str]):
        self.order, self.held, self.n, self.files = list(order), [], 0, []

    def add(self, rows: pd.DataFrame) -> None:
        self.held.append(rows)
        self.n += len(rows)
        if self.n >= RUN:
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            file = tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None)
            for piece in _cut(self._sorted()):
                pickle.dump(piece.reset_index(drop=True), file, pickle.HIGHEST_PROTOCOL)
            self.files.append(file)

    def _sorted(self) -> pd.DataFrame:
        rows = pd.concat(self.held, ignore_index=True) if self.held else pd.DataFrame()
        self.held, self.n = [], 0
        return rows.sort_values(self.order, kind="stable", ignore_index=True) if self.order and len(rows) else rows

    def _upto(self, rows: pd.DataFrame, bound: tuple, ties: bool) -> int:
        """How many of the sorted ``rows`` come before ``bound``, or with ``ties`` not after it."""
        a, b = 0, len(rows)
        for c, x in zip(self.order, bound, strict=True):
            values = rows[c].to_numpy()[a:b]
            a, b = a + int(np.searchsorted(values, x, "left")), a + int(np.searchsorted(values, x, "right"))
        return b if ties else a

    def merged(self) -> Iterator[pd.DataFrame]:
        runs = [*map(_pieces, self.files), _cut(self._sorted())]
        self.files = []
        if len(runs) == 1:
            yield from runs[0]
            return
        heads = [next(r, None) for r in runs]
        while any(h is not None for h in heads):
            ends = {i: tuple(h[c].iloc[-1] for c in self.order) for i, h in enumerate(heads) if h is not None}
            first = min(ends, key=ends.get)  # the first of the runs whose pieces end first
            taken = {i: self._upto(heads[i], ends[first], i <= first) for i in ends}
            parts = [heads[i].iloc[:n] for i, n in taken.items() if n]
            rows = pd.concat(parts, ignore_index=True)
            yield from _cut(rows.sort_values(self.order, kind="stable", ignore_index=True) if self.order and len(parts) > 1 else rows)
            for i, n in taken.items():
                heads[i] = heads[i].iloc[n:] if n < len(heads[i]) else next(runs[i], None)
