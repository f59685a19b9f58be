"""Fitted and stateless frame transforms, kept as JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.functions.exprs import num


class Transform:
    def fit(self, df: DataFrame) -> Transform:
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def config(self) -> dict:
        return {"kind": type(self).__name__, **asdict(self)}


@dataclass
class Passthrough(Transform):
    def apply(self, df):
        return df


@dataclass
class FunctionTransform(Transform):
    fn: Callable[[DataFrame], DataFrame]

    def apply(self, df):
        return self.fn(df)

    def config(self):
        return {"kind": "FunctionTransform", "fn": self.fn.__name__}


@dataclass
class ReturnNormalizer(Transform):
    """The target over a feature that is at least eps."""

    feature: str
    target: str
    eps: float = 1e-12

    def apply(self, df):
        return df.withColumn(self.target, num(F.col(self.target)) / F.greatest(num(F.col(self.feature)), F.lit(self.eps)))


@dataclass
class Standardizer(Transform):
    """(x - mean) / deviation; NaN and null don't count; no deviation, or fewer than two values: 1."""

    columns: Sequence[str]
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)

    def statistics(self, df: DataFrame) -> DataFrame:
        """One row: (mean, deviation) of every column, in one pass."""
        seen = lambda c: F.when(~F.isnan(num(F.col(c))), num(F.col(c)))
        spread = lambda c: F.coalesce(F.stddev_samp(seen(c)), F.lit(1.0))
        out = [F.coalesce(F.avg(seen(c)), F.lit(0.0)).alias(f"{c}_mean") for c in self.columns]
        return df.agg(*out, *(F.when(spread(c) == 0, 1.0).otherwise(spread(c)).alias(f"{c}_std") for c in self.columns))

    def fit(self, df):
        row = self.statistics(df).first()
        return Standardizer(list(self.columns), {c: row[f"{c}_mean"] for c in self.columns}, {c: row[f"{c}_std"] for c in self.columns})

    def apply(self, df):
        return df.withColumns({c: (num(F.col(c)) - self.means[c]) / self.deviations[c] for c in self.columns})


@dataclass
class Chain(Transform):
    """Steps, each fitted to what those before it return."""

    steps: Sequence[Transform]

    def fit(self, df):
        done = []
        for step in self.steps:
            done.append(step.fit(df))
            df = done[-1].apply(df)
        return Chain(done)

    def apply(self, df):
        for step in self.steps:
            df = step.apply(df)
        return df

    def config(self):
        return {"kind": "Chain", "steps": [s.config() for s in self.steps]}


def compose(*steps: Transform | None) -> Transform:
    steps = [s for s in steps if s is not None and not isinstance(s, Passthrough)]
    return Passthrough() if not steps else steps[0] if len(steps) == 1 else Chain(steps)


def save_transform(transform: Transform, path: str) -> str:
    """Write as JSON; returns the sha256 of what was written."""
    text = json.dumps(transform.config(), sort_keys=True)
    with open(path, "w") as f:
        f.write(text)
    return hashlib.sha256(text.encode()).hexdigest()


def load_transform(path: str, sha256: str | None = None) -> Transform:
    with open(path) as f:
        text = f.read()
    if sha256 and hashlib.sha256(text.encode()).hexdigest() != sha256:
        raise ValueError(f"{path} has changed")
    return from_config(json.loads(text))


def from_config(config: dict) -> Transform:
    config = dict(config)
    kind = config.pop("kind")
    if kind == "Chain":
        return Chain([from_config(c) for c in config["steps"]])
    kinds = {k.__name__: k for k in (Passthrough, ReturnNormalizer, Standardizer)}
    if kind not in kinds:
        raise ValueError(f"{kind} can't be loaded")
    return kinds[kind](**config)
