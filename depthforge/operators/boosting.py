"""Boosted regression trees for quantiles, grown from histograms.

Features are cut into bins at approximate quantiles, once.  A round grows one tree for each quantile, level by level: a
pass sums, for every open node, feature and bin, the weight of the rows and of those predicted too high, which is all
that the gradients of the pinball loss depend on; the sums of tasks are added up by a group-by, and the driver sees nodes x
features x bins, whatever the rows.  A leaf's value is the quantile of what is left of its rows, times the learning rate.

Trees are arrays of splits that the tasks apply to their batches.  Every ``STORE`` rounds the rows are written with their
predictions so far, so neither a pass nor its lineage grows with the rounds.

Null and NaN features go left.  Rows with a null or NaN target, or a weight that isn't a positive number, are left out.  Equal gains, to
nine digits, go to the first feature and bin, so the same rows give the same trees however they are dealt out, up to the
rounding of sums of weights.  Quantiles of at most ``ACCURACY`` rows are exact: the value of rank ceil(q * n).  With
weights a leaf's quantile is read off a grid of ``GRID`` ranks; the value that growing starts from counts each row once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.functions.exprs import num
from depthforge.sources.shared import written

ACCURACY = 100_000
GRID = 512
#: Rounds between two written tables.
STORE = 10
#: Trees that are compiled to columns at most; more are applied by tasks.
COMPILED = 64
#: A split gains more than this.
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes in heap order: a node's children are 2 i + 1 and 2 i + 2.  ``feature`` is -1 at leaves; bins below ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row of ``bins`` ends."""
        at = np.zeros(len(bins), int)
        rows = np.arange(len(bins))
        while True:
            split = self.feature[at]
            open_ = split >= 0
            if not open_.any():
                return at
            right = bins[rows, np.maximum(split, 0)] >= self.cut[at]
            at = np.where(open_, 2 * at + 1 + right, at)

    def column(self, features: Sequence[str], edges: Sequence[np.ndarray], i: int = 0) -> Column:
        if self.feature[i] < 0:
            return F.lit(float(self.value[i]))
        x = num(F.col(features[self.feature[i]]))
        left = x.isNull() | F.isnan(x) | (x < float(edges[self.feature[i]][self.cut[i] - 1]))
        return F.when(left, self.column(features, edges, 2 * i + 1)).otherwise(self.column(features, edges, 2 * i + 2))


@dataclass
class BoostedQuantiles:
    features: list[str]
    quantiles: list[float]
    edges: list[np.ndarray]
    base: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)
    #: Mean pinball loss on the validation rows after each round; the first entry is that of the base.
    history: list[float] = field(default_factory=list)

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Row x feature: how many edges are at or below the value; missing ones have none."""
        out = [np.where(np.isnan(c), 0, np.searchsorted(e, c, "right")) for c, e in zip(columns, self.edges, strict=True)]
        return np.column_stack(out) if out else np.zeros((0, 0), int)

    def columns(self) -> list[Column]:
        """The predictions as expressions."""
        out = []
        for k, b in enumerate(self.base):
            total = F.lit(float(b))
            for trees in self.rounds:
                total = total + trees[k].column(self.features, self.edges)
            out.append(total)
        return out

    def predict(self, df: DataFrame, names: Sequence[str], compiled: int = COMPILED) -> DataFrame:
        """``df`` with a column for each quantile; models of more than ``compiled`` trees are applied by tasks."""
        if len(names) != len(self.quantiles):
            raise ValueError("as many names as quantiles")
        if len(self.rounds) * len(self.quantiles) <= compiled:
            return df.withColumns(dict(zip(names, self.columns(), strict=True)))
        from pyspark.sql.types import DoubleType, StructField, StructType

        hidden = [f"_x{i}_{uuid.uuid4().hex[:6]}" for i in range(len(self.features))]
        wide = df.select("*", *(num(F.col(c)).alias(h) for c, h in zip(self.features, hidden, strict=True)))
        schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])
        model, n_own = self, len(df.columns)

        def run(batches):
            for b in batches:
                bins = model.binned([_floats(c) for c in b.columns[n_own:]])
                made = [pa.array(model.base[k] + sum((t[k].value[t[k].leaves(bins)] for t in model.rounds), np.zeros(len(bins)))) for k in range(len(model.base))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n_own], *made], names=schema.names)

        return wide.mapInArrow(run, schema)

    def to_json(self) -> str:
        tree = lambda t: {"feature": t.feature.tolist(), "cut": t.cut.tolist(), "value": t.value.tolist()}
        body = {"features": self.features, "quantiles": self.quantiles, "edges": [e.tolist() for e in self.edges], "base": self.base, "history": self.history}
        return json.dumps(body | {"rounds": [[tree(t) for t in r] for r in self.rounds]})

    @staticmethod
    def from_json(text: str) -> BoostedQuantiles:
        body = json.loads(text)
        rounds = [[Tree(np.array(t["feature"]), np.array(t["cut"]), np.array(t["value"], float)) for t in r] for r in body["rounds"]]
        return BoostedQuantiles(body["features"], body["quantiles"], [np.array(e, float) for e in body["edges"]], body["base"], rounds, body["history"])


def _floats(c: pa.Array) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False).astype(float)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 64) -> list[np.ndarray]:
    """For each feature at most ``bins`` - 1 increasing values that cut its rows into parts of about equal size."""
    if not features:
        return []
    shares = [i / bins for i in range(1, bins)]
    cols = [F.percentile_approx(F.when(~F.isnan(num(F.col(c))), num(F.col(c))), shares, ACCURACY).alias(f"e{i}") for i, c in enumerate(features)]
    row = df.agg(*cols).head()  # features x bins
    return [np.unique(np.array(x if x is not None else [], float)) for x in row]


# ---------------------------------------------------------------- growing


def usable(df: DataFrame, target: str, weight: str | None) -> DataFrame:
    """Rows with a target, and a weight that is a positive number."""
    y, w = num(F.col(target)), num(F.col(weight)) if weight else F.lit(1.0)
    return df.where(y.isNotNull() & ~F.isnan(y) & (w > 0) & (w < float("inf")))


class _Rows:
    """Binned rows with target, weight and the predictions of the trees up to the last writing."""

    def __init__(self, df: DataFrame, model: BoostedQuantiles, target: str, weight: str | None):
        self.model, self.done = model, 0
        k = len(model.quantiles)
        wanted = usable(df, target, weight).select(num(F.col(target)).alias("y"), (num(F.col(weight)) if weight else F.lit(1.0)).alias("w"), *(num(F.col(c)).alias(f"x{i}") for i, c in enumerate(model.features)))
        names = ["y", "w", *(f"b{i}" for i in range(len(model.features))), *(f"p{j}" for j in range(k))]
        kinds = ", ".join([*(f"{n} double" for n in names[:2]), *(f"{n} smallint" for n in names[2 : 2 + len(model.features)]), *(f"{n} double" for n in names[2 + len(model.features) :])])
        edges = model

        def run(batches):
            for b in batches:
                bins = edges.binned([_floats(c) for c in b.columns[2:]])
                cols = [b.column(0), b.column(1), *(pa.array(bins[:, i].astype(np.int16)) for i in range(bins.shape[1])), *(pa.array(np.full(b.num_rows, float(v))) for v in edges.base)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        self.table = written(wanted.mapInArrow(run, kinds), "boosting")

    def batches(self, work, schema: str) -> DataFrame:
        """``work(parts)`` over (y, w, bins, predictions) of each batch, the predictions up to date."""
        trees, n = self.model.rounds[self.done :], len(self.model.features)

        def run(batches):
            def parts():
                for b in batches:
                    cols = [_floats(c) for c in b.columns]
                    bins = np.column_stack(cols[2 : 2 + n]).astype(int) if n else np.zeros((b.num_rows, 0), int)
                    p = [c.copy() for c in cols[2 + n :]]
                    for t in trees:
                        for k, one in enumerate(t):
                            p[k] += one.value[one.leaves(bins)]
                    yield cols[0], cols[1], bins, p

            yield from work(parts())

        return self.table.mapInArrow(run, schema)

    def store(self) -> None:
        """Write the rows with the predictions so far."""
        names, n = self.table.columns, len(self.model.features)

        def work(parts):
            for y, w, bins, p in parts:
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(w), *(pa.array(bins[:, i].astype(np.int16)) for i in range(n)), *(pa.array(x) for x in p)], names=names)

        self.table = written(self.batches(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.table.schema)), "boosting")
        self.done = len(self.model.rounds)


def _histogram(rows: _Rows, trees: list[Tree], level: int, kept: list[np.ndarray], share: float, salt: int) -> dict[int, np.ndarray]:
    """For each quantile (node of the level, feature, bin, (weight, weight predicted too high))."""
    first, n_nodes, n = 2**level - 1, 2**level, len(rows.model.features)
    size = max((len(e) for e in rows.model.edges), default=0) + 1
    cells = n_nodes * n * size

    def work(parts):
        total = np.zeros((len(trees), 2, cells))
        for y, w, bins, p in parts:
            mine = _sampled(y, bins, share, salt)
            for k, tree in enumerate(trees):
                at = tree.leaves(bins) - first
                own = (at >= 0) & mine
                high = w * (p[k] >= y)
                for f in kept[k]:
                    cell = ((at[own] * n) + f) * size + bins[own, f]
                    total[k, 0] += np.bincount(cell, w[own], cells)
                    total[k, 1] += np.bincount(cell, high[own], cells)
        k, cell = np.nonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(cell), pa.array(total[k, 0, cell]), pa.array(total[k, 1, cell])], names=["k", "cell", "w", "high"])

    sums = rows.batches(work, "k int, cell bigint, w double, high double").groupBy("k", "cell").agg(F.sum("w").alias("w"), F.sum("high").alias("high"))
    out = {k: np.zeros((2, cells)) for k in range(len(trees))}
    for r in sums.collect():  # nodes x features x bins
        out[r.k][:, r.cell] = r.w, r.high
    return {k: h.reshape(2, n_nodes, n, size) for k, h in out.items()}


def _sampled(y: np.ndarray, bins: np.ndarray, share: float, salt: int) -> np.ndarray:
    """The rows of a round's sample: by a hash of their values, so that a rerun of the task takes the same ones."""
    if share >= 1.0:
        return np.ones(len(y), bool)
    h = y.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for i in range(bins.shape[1]):
        h = (h ^ bins[:, i].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)) / 2.0**53 < share


def best_splits(weight: np.ndarray, high: np.ndarray, q: float, penalty: float, least_weight: float, least_gain: float) -> list[tuple[int, int, int]]:
    """(node, feature, cut) of the nodes worth splitting, from sums by (node, feature, bin)."""
    grad = high * (1.0 - q) - (weight - high) * q
    lw, lg = np.cumsum(weight, 2)[:, :, :-1], np.cumsum(grad, 2)[:, :, :-1]
    tw, tg = weight.sum(2, keepdims=True), grad.sum(2, keepdims=True)
    rw, rg = tw - lw, tg - lg
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (lg * lg / (lw + penalty) + rg * rg / (rw + penalty) - tg * tg / (tw + penalty)) - least_gain
    ok = (lw >= least_weight) & (rw >= least_weight) & (lw > 0) & (rw > 0)
    gain = np.where(ok, np.round(gain, 9), -np.inf)
    out = []
    for node in range(len(weight)):
        if gain[node].size:
            f, cut = np.unravel_index(int(np.argmax(gain[node])), gain[node].shape)
            if gain[node, f, cut] > LEAST_GAIN:
                out.append((node, int(f), int(cut) + 1))
    return out


def _leaf_values(rows: _Rows, trees: list[Tree], weighted: bool) -> None:
    """Put the quantiles of the leaves' residuals into ``trees``."""
    quantiles = rows.model.quantiles

    def work(parts):
        for y, w, bins, p in parts:
            for k, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), pa.array(tree.leaves(bins)), pa.array(y - p[k]), pa.array(w)], names=["k", "leaf", "r", "w"])

    left = rows.batches(work, "k int, leaf bigint, r double, w double")
    if not weighted:
        found = left.groupBy("k", "leaf").agg(F.percentile_approx("r", quantiles, ACCURACY).alias("v")).collect()  # leaves x quantiles
        for r in found:
            trees[r.k].value[r.leaf] = r.v[r.k]
        return
    left = written(left, "boosting")
    grid = left.groupBy("k", "leaf").agg(F.array_distinct(F.percentile_approx("r", [(i + 1) / GRID for i in range(GRID)], ACCURACY)).alias("grid"))
    spot = left.join(F.broadcast(grid), ["k", "leaf"]).withColumn("i", F.size(F.filter("grid", lambda g: g < F.col("r"))))
    sums: dict = {}
    for r in spot.groupBy("k", "leaf", "i").agg(F.sum("w").alias("w"), F.max(F.get("grid", F.col("i"))).alias("v")).collect():  # leaves x grid
        sums.setdefault((r.k, r.leaf), []).append((r.i, r.w, r.v))
    for (k, leaf), cells in sums.items():
        cells.sort()
        reached = np.cumsum([w for _, w, _ in cells])
        trees[k].value[leaf] = cells[min(int(np.searchsorted(reached, quantiles[k] * reached[-1] * (1 - 1e-12))), len(cells) - 1)][2]


def _loss(rows: _Rows) -> float:
    """Mean pinball loss over rows and quantiles."""
    quantiles = rows.model.quantiles

    def work(parts):
        total = weight = 0.0
        for y, w, _, p in parts:
            weight += w.sum()
            for q, x in zip(quantiles, p, strict=True):
                e = y - x
                total += (w * np.maximum(q * e, (q - 1.0) * e)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([weight])], names=["loss", "w"])

    r = rows.batches(work, "loss double, w double").agg(F.sum("loss").alias("loss"), F.sum("w").alias("w")).head()
    return r.loss / r.w / len(quantiles) if r.w else float("nan")


def fit(
    df: DataFrame, features: Sequence[str], target: str, quantiles: Sequence[float], weight: str | None = None, valid: DataFrame | None = None, rounds: int = 100, depth: int = 6, learning_rate: float = 0.3,
    penalty: float = 1.0, least_weight: float = 1.0, least_gain: float = 0.0, row_share: float = 1.0, feature_share: float = 1.0, bins: int = 64, edges: Sequence[Sequence[float]] | None = None,
    patience: int | None = None, seed: int = 0, stop=None,
) -> BoostedQuantiles:
    """A model of ``rounds`` trees for each quantile, or of those up to the best round on ``valid``.

    With ``patience`` growing ends when the loss on ``valid`` hasn't fallen for as many rounds.  ``stop(round, loss)``
    ends it too, by raising, if the caller gives up on the model.  ``edges`` fixes the bins.
    """
    quantiles, features = [float(q) for q in quantiles], list(features)
    if not quantiles or any(not 0.0 < q < 1.0 for q in quantiles):
        raise ValueError("quantiles are between 0 and 1")
    if rounds < 0 or depth < 1 or not 0.0 < learning_rate:
        raise ValueError("rounds, depth and learning rate are positive")
    cuts = [np.unique(np.array(e, float)) for e in edges] if edges is not None else bin_edges(df, features, bins)
    first = usable(df, target, weight).agg(F.percentile_approx(num(F.col(target)), quantiles, ACCURACY).alias("v")).head().v
    if first is None:
        raise ValueError("no rows to fit to")
    model = BoostedQuantiles(features, quantiles, cuts, [float(v) for v in first])
    rows = _Rows(df, model, target, weight)
    held = _Rows(valid, model, target, weight) if valid is not None else None
    if held:
        model.history.append(_loss(held))
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        trees = [Tree.empty(depth) for _ in quantiles]
        n_kept = max(1, round(feature_share * len(features)))
        kept = [np.sort(rng.choice(len(features), n_kept, replace=False)) if n_kept < len(features) else np.arange(len(features)) for _ in quantiles]
        for level in range(depth):
            sums = _histogram(rows, trees, level, kept, row_share, seed + r + 1)
            grown = False
            for k, q in enumerate(quantiles):
                for node, f, cut in best_splits(*sums[k], q, penalty, least_weight, least_gain):
                    at = 2**level - 1 + node
                    trees[k].feature[at], trees[k].cut[at] = f, cut
                    grown = True
            if not grown:
                break
        _leaf_values(rows, trees, weight is not None)
        for t in trees:
            t.value *= learning_rate
        model.rounds.append(trees)
        if held:
            model.history.append(_loss(held))
            best = int(np.nanargmin(model.history)) if not np.isnan(model.history).all() else 0
            if stop:
                stop(r, model.history[-1])
            if patience and len(model.rounds) - best >= patience:
                break
        if len(model.rounds) - rows.done >= STORE and r + 1 < rounds:
            rows.store()
            if held:
                held.store()
    if held and patience and not np.isnan(model.history).all():
        del model.rounds[int(np.nanargmin(model.history)) :]
    return model
