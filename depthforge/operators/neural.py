"""Regression by a layered network whose gradients Spark sums.

Rows are written once, dealt over ``steps`` parts by a hash of their order number.  A step is one job over one part: tasks
add up the gradients of their batches in numpy, a group-by adds up the tasks, and the driver takes a step of Adam on as
many numbers as the network has weights.  An epoch visits the parts in an order drawn from the seed, so the rows and the
seed decide the weights, up to the rounding of sums, and not how the rows are dealt out.

Inputs are standardised by the means and deviations of the training rows.  Losses are squared or, with quantiles, pinball
losses of one output each.  The weights after an epoch are a snapshot: those of the last epoch are kept, or of the best one
on the validation rows, or the best few, whose outputs are averaged.

Rows with a null or NaN among features, target or weight, or an infinite one, are left out when fitting; their predictions are null
where a feature is missing.  Negative weights are an error.  No rows are an error.  Repeated rows count as often as they come.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from depthforge.functions.exprs import finite, num
from depthforge.operators.ordering import ORDER
from depthforge.sources.shared import shared_path

ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda z, a: (z > 0).astype(float)),
    "tanh": (np.tanh, lambda z, a: 1.0 - a * a),
}


@dataclass
class Layers:
    """Weights in one vector: for each layer its matrix, row by row, and its offsets."""

    sizes: list[int]
    activation: str = "relu"

    def __post_init__(self):
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"activation is one of {sorted(ACTIVATIONS)}")
        if any(n < 1 for n in self.sizes):
            raise ValueError("layers have a unit at least")

    @property
    def count(self) -> int:
        return sum(a * b + b for a, b in zip(self.sizes, self.sizes[1:], strict=False))

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            parts += [rng.normal(0.0, math.sqrt(2.0 / a), a * b), np.zeros(b)]
        return np.concatenate(parts)

    def split(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Outputs, and inputs and sums of each layer."""
        act, seen, layers = ACTIVATIONS[self.activation][0], [], self.split(flat)
        for i, (m, c) in enumerate(layers):
            z = x @ m + c
            seen.append((x, z))
            x = act(z) if i + 1 < len(layers) else z
        return x, seen

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, quantiles: Sequence[float] | None) -> tuple[float, np.ndarray]:
        """Weighted sum of the losses and its gradient."""
        out, seen = self.forward(flat, x)
        loss, back = losses(out, y, w, quantiles)
        slope, parts, layers = ACTIVATIONS[self.activation][1], [], self.split(flat)
        for i in range(len(layers) - 1, -1, -1):
            inputs, _ = seen[i]
            parts = [(inputs.T @ back).ravel(), back.sum(0), *parts]
            if i:
                back = (back @ layers[i][0].T) * slope(seen[i - 1][1], inputs)
        return loss, np.concatenate(parts)


def losses(out: np.ndarray, y: np.ndarray, w: np.ndarray, quantiles: Sequence[float] | None) -> tuple[float, np.ndarray]:
    """Weighted sum over rows of the mean loss of the outputs, and its slope by output."""
    e, k = y[:, None] - out, out.shape[1]
    if quantiles is None:
        return float((w[:, None] * e * e).sum() / k), -2.0 * w[:, None] * e / k
    q = np.asarray(quantiles)
    return float((w[:, None] * np.maximum(q * e, (q - 1.0) * e)).sum() / k), w[:, None] * np.where(e > 0, -q, 1.0 - q) / k


@dataclass
class Network:
    features: list[str]
    layers: Layers
    mean: np.ndarray
    scale: np.ndarray
    quantiles: list[float] | None = None
    #: What is predicted with: the mean of the outputs of these weights.
    weights: list[np.ndarray] = field(default_factory=list)
    #: Mean training and validation loss of each epoch; the training loss is that of the weights before its steps.
    history: list[dict] = field(default_factory=list)

    def outputs(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        x = (np.column_stack(columns) - self.mean) / self.scale
        return sum(self.layers.forward(w, x)[0] for w in self.weights) / len(self.weights)

    def predict(self, df: DataFrame, names: Sequence[str] | str = "prediction") -> DataFrame:
        names = [names] if isinstance(names, str) else list(names)
        if len(names) != self.layers.sizes[-1]:
            raise ValueError("as many names as outputs")
        hidden = [f"_x{i}_{uuid.uuid4().hex[:6]}" for i in range(len(self.features))]
        wide = df.select("*", *(num(F.col(c)).alias(h) for c, h in zip(self.features, hidden, strict=True)))
        schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])
        model, own = self, len(df.columns)

        def run(batches):
            for b in batches:
                made = model.outputs([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[own:]])
                yield pa.RecordBatch.from_arrays([*b.columns[:own], *(pa.array(c, mask=np.isnan(c)) for c in made.T)], names=schema.names)

        return wide.mapInArrow(run, schema)

    def to_json(self) -> str:
        body = {"features": self.features, "sizes": self.layers.sizes, "activation": self.layers.activation, "mean": self.mean.tolist(), "scale": self.scale.tolist(), "quantiles": self.quantiles}
        return json.dumps(body | {"weights": [w.tolist() for w in self.weights], "history": self.history})

    @staticmethod
    def from_json(text: str) -> Network:
        b = json.loads(text)
        return Network(b["features"], Layers(b["sizes"], b["activation"]), np.array(b["mean"]), np.array(b["scale"]), b["quantiles"], [np.array(w) for w in b["weights"]], b["history"])


def usable(df: DataFrame, features: Sequence[str], target: str, weight: str | None) -> DataFrame:
    cols = [*features, target, *([weight] if weight else [])]
    ok = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in cols])
    return df.where(F.coalesce(ok, F.lit(False)))


def _summed(rows: DataFrame, model: Network, flat: np.ndarray, slopes: bool) -> tuple[float, float, np.ndarray]:
    """(loss, weight, gradient) over ``rows`` (y, w, x0, ...)."""
    layers, mean, scale, quantiles = model.layers, model.mean, model.scale, model.quantiles

    def add(batches):
        loss = mass = 0.0
        total = np.zeros(layers.count)
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            x = (np.column_stack(cols[2:]) - mean) / scale
            mass += cols[1].sum()
            if slopes:
                one, g = layers.gradient(flat, x, cols[0], cols[1], quantiles)
                total += g
            else:
                one, _ = losses(layers.forward(flat, x)[0], cols[0], cols[1], quantiles)
            loss += one
        sums = [loss, mass, *total] if slopes else [loss, mass]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], names=["i", "value"])

    out = np.zeros(2 + layers.count)
    for r in rows.mapInArrow(add, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():  # a row per weight
        out[r.i] = r.value
    return out[0], out[1], out[2:]


class Adam:
    def __init__(self, n: int, rate: float, decay: float):
        self.m, self.v, self.t, self.rate, self.decay = np.zeros(n), np.zeros(n), 0, rate, decay

    def step(self, flat: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return flat - self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay * flat)


def fit(
    df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, valid: DataFrame | None = None, hidden: Sequence[int] = (32,), activation: str = "relu", quantiles: Sequence[float] | None = None,
    epochs: int = 10, steps: int = 8, learning_rate: float = 1e-2, weight_decay: float = 0.0, patience: int | None = None, least_gain: float = 0.0, keep: str = "best", kept: int = 1, seed: int = 0, order: str = ORDER,
) -> Network:
    """A network after ``epochs`` of ``steps`` steps, or fewer if the validation loss hasn't fallen by ``least_gain`` for ``patience`` epochs.

    ``keep``: "last" weights, the "best" epoch's, or "ensemble" of the ``kept`` best ones; without ``valid`` the last.
    """
    if keep not in ("last", "best", "ensemble"):
        raise ValueError("keep is last, best or ensemble")
    if epochs < 1 or steps < 1 or kept < 1:
        raise ValueError("epochs, steps and kept are positive")
    features = list(features)
    layers = Layers([len(features), *hidden, len(quantiles) if quantiles else 1], activation)
    w = num(F.col(weight)) if weight else F.lit(1.0)
    w = F.when(w >= 0, w).otherwise(F.raise_error(F.lit("weights aren't negative")).cast("double"))
    cols = [num(F.col(target)).alias("y"), w.alias("w"), *(num(F.col(c)).alias(f"x{i}") for i, c in enumerate(features))]
    part = F.pmod(F.xxhash64(F.col(order), F.lit(seed)), F.lit(steps)).cast("int").alias("part")
    spark, path = df.sparkSession, shared_path(df.sparkSession, "network")
    usable(df, features, target, weight).select(*cols, part).write.partitionBy("part").parquet(path)
    names = ["y", "w", *(f"x{i}" for i in range(len(features)))]
    rows = spark.read.schema(", ".join([*(f"{n} double" for n in names), "part int"])).parquet(path)
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *(f(f"x{i}").alias(f"{k}{i}") for i in range(len(features)) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).head()  # one row
    if not moments.n:
        raise ValueError("no rows to fit to")
    mean = np.array([moments[f"m{i}"] for i in range(len(features))], float)
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(len(features))], float)
    model = Network(features, layers, mean, scale, [float(q) for q in quantiles] if quantiles else None)
    held = usable(valid, features, target, weight).select(*cols) if valid is not None else None
    rng = np.random.default_rng(seed)
    flat = layers.draw(rng)
    adam = Adam(layers.count, learning_rate, weight_decay)
    snapshots: list[tuple[float, int, np.ndarray]] = []
    best, stale = math.inf, 0
    for epoch in range(epochs):
        loss = mass = 0.0
        for p in rng.permutation(steps):
            one, m, g = _summed(rows.where(F.col("part") == int(p)).select(names), model, flat, True)
            if m > 0:  # a part may have no rows
                flat = adam.step(flat, g / m)
            loss, mass = loss + one, mass + m
        record = {"epoch": epoch, "train": loss / mass if mass else None}
        if held is not None:
            one, m, _ = _summed(held, model, flat, False)
            record["valid"] = one / m if m else math.inf
            snapshots = sorted([*snapshots, (record["valid"], epoch, flat)], key=lambda s: s[:2])[: kept if keep == "ensemble" else 1]
            stale = 0 if record["valid"] < best - least_gain else stale + 1
            best = min(best, record["valid"])
        model.history.append(record)
        if patience and held is not None and stale >= patience:
            break
    model.weights = [flat] if keep == "last" or not snapshots else [s[2] for s in snapshots]
    return model
