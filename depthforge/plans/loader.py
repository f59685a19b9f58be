"""From events or depth rows to a frame of features and labels, as one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from depthforge.functions.exprs import mid
from depthforge.operators.asof import add_executable_return, add_return
from depthforge.operators.book import build_depth, with_context
from depthforge.operators.filters import any_of, where_level
from depthforge.operators.ordering import KEYS, ORDER, by_row
from depthforge.plans.expressions import Tree
from depthforge.plans.features import add_features


@dataclass(frozen=True)
class FeatureLoader:
    """What to compute for each row, in this order: book, static columns, stateful features, returns, filters, projection.

    States and labels see all rows of a key; filters (alternatives) drop rows after both.  ``partition`` comes before
    the book's keys (the date), so states restart there.
    """

    static: Mapping[str, Column | Tree] = field(default_factory=dict)
    stateful: Sequence = ()
    horizons: Sequence[str] = ()
    weights: Sequence[float] | float = 1.0
    price: Column | None = None
    executable: tuple[int, float] | None = None
    target: str = "return_bps"
    levels: int | None = None
    filters: Sequence[Column] = ()
    context: Sequence[str] = ()
    keep: Sequence[str] = ()
    partition: Sequence[str] = ()
    time: str = "ts_ns"

    def __call__(self, rows: DataFrame) -> DataFrame:
        keys = [*self.partition, *KEYS]
        df = rows
        if self.levels:
            df = build_depth(rows, self.levels, self.partition[0] if self.partition else None)
            df = with_context(df, rows, self.context) if self.context else df
        df = df.withColumns({n: c(by_row(keys)) if isinstance(c, Tree) else c for n, c in self.static.items()}) if self.static else df
        df = add_features(df, self.stateful, keys, ORDER, self.time) if self.stateful else df
        if self.horizons:
            at = {"name": self.target, "keys": keys, "time": self.time}
            df = add_executable_return(df, *self.executable, self.horizons, self.weights, **at) if self.executable else add_return(df, self.price if self.price is not None else mid(), self.horizons, self.weights, **at)
        df = where_level(df, any_of(self.filters)) if self.filters else df
        wanted = [*keys, ORDER, self.time, *self.context, *self.keep, *self.static, *(f.name for f in self.stateful), *([self.target] if self.horizons else [])]
        return df.select(*dict.fromkeys(c for c in wanted if c in df.columns))
