"""Linear models from additive Gram statistics: mean, least squares, ridge, and the whole lasso path.

Statistics are summed per Arrow batch with numpy, once per task, and added up by a group-by; the driver solves a system
as large as the features.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.functions.exprs import num


@dataclass
class Gram:
    xtx: np.ndarray
    xty: np.ndarray
    x_sum: np.ndarray
    y_sum: float
    weight: float
    n: int

    def centered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(X'X, X'y, mean x, mean y) about the weighted means."""
        w = self.weight or 1.0
        mx, my = self.x_sum / w, self.y_sum / w
        return self.xtx - w * np.outer(mx, mx), self.xty - w * mx * my, mx, my

    def __add__(self, other: Gram) -> Gram:
        return Gram(*(getattr(self, f) + getattr(other, f) for f in ("xtx", "xty", "x_sum", "y_sum", "weight", "n")))


def gram_rows(df: DataFrame, features: Sequence[str], target: str, weight: str | None = None) -> DataFrame:
    """(i, j, value): entry of the weighted cross products of (features, target, 1); rows with a null are left out."""
    features = list(features)
    k = len(features)
    cols = [*(num(F.col(c)).alias(f"c{i}") for i, c in enumerate([*features, target])), (num(F.col(weight)) if weight else F.lit(1.0)).alias("w")]

    def add(batches):
        total, n = np.zeros((k + 2, k + 2)), 0
        for b in batches:
            m = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]), np.ones(b.num_rows)])
            total += m.T @ (m * b.columns[-1].to_numpy(zero_copy_only=False)[:, None])
            n += b.num_rows
        i, j = np.triu_indices(k + 2)
        yield pa.RecordBatch.from_arrays([pa.array([*i, -1]).cast(pa.int32()), pa.array([*j, -1]).cast(pa.int32()), pa.array([*total[i, j], float(n)])], names=["i", "j", "value"])

    parts = df.select(*cols).dropna().mapInArrow(add, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram(df: DataFrame, features: Sequence[str], target: str, weight: str | None = None) -> Gram:
    k = len(features)
    m, n = np.zeros((k + 2, k + 2)), 0
    for r in gram_rows(df, features, target, weight).collect():  # (features + 2) ** 2 / 2 rows
        if r.i < 0:
            n = int(r.value)
        else:
            m[r.i, r.j] = m[r.j, r.i] = r.value
    return Gram(m[:k, :k], m[:k, k], m[:k, k + 1], m[k, k + 1], m[k + 1, k + 1], n)


def grams_by(df: DataFrame, features: Sequence[str], target: str, weight: str | None, by: str) -> dict:
    """{value of ``by``: its Gram} in one job; for columns of few values, as dates."""
    features = list(features)
    k = len(features)
    cols = [*(num(F.col(c)).alias(f"c{i}") for i, c in enumerate([*features, target])), (num(F.col(weight)) if weight else F.lit(1.0)).alias("w"), F.col(by).cast("string").alias("by")]

    def add(batches):
        totals: dict[str, list] = {}
        for b in batches:
            m = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns[:-2]), np.ones(b.num_rows)])
            w = b.columns[-2].to_numpy(zero_copy_only=False)
            names, which = np.unique(b.columns[-1].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for j, name in enumerate(names.tolist()):
                own = which == j
                one = totals.setdefault(name, [np.zeros((k + 2, k + 2)), 0])
                one[0] += m[own].T @ (m[own] * w[own, None])
                one[1] += int(own.sum())
        i, j = np.triu_indices(k + 2)
        for name, (total, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(i) + 1)), pa.array([*i, -1]).cast(pa.int32()), pa.array([*j, -1]).cast(pa.int32()), pa.array([*total[i, j], float(n)])], names=["by", "i", "j", "value"])

    parts = df.select(*cols).dropna().mapInArrow(add, "by string, i int, j int, value double")
    out: dict = {}
    for r in parts.groupBy("by", "i", "j").agg(F.sum("value").alias("value")).collect():  # values x (features + 2) ** 2 / 2 rows
        m, n = out.setdefault(r.by, (np.zeros((k + 2, k + 2)), [0]))
        if r.i < 0:
            n[0] = int(r.value)
        else:
            m[r.i, r.j] = m[r.j, r.i] = r.value
    return {v: Gram(m[:k, :k], m[:k, k], m[:k, k + 1], m[k, k + 1], m[k + 1, k + 1], n[0]) for v, (m, n) in sorted(out.items())}


@dataclass
class LinearModel:
    features: list[str]
    coef: np.ndarray
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coef, strict=True):
            out = out + num(F.col(c)) * float(b)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.column())

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "coef": list(map(float, self.coef)), "intercept": float(self.intercept)})

    @staticmethod
    def from_json(text: str) -> LinearModel:
        d = json.loads(text)
        return LinearModel(d["features"], np.array(d["coef"]), d["intercept"])


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(stats: Gram, features: Sequence[str], alpha: float = 0.0, fit_intercept: bool = True) -> LinearModel:
    g, c, mx, my = stats.centered() if fit_intercept else (stats.xtx, stats.xty, np.zeros(len(features)), 0.0)
    beta = _solve(g + alpha * np.eye(len(features)), c)
    return LinearModel(list(features), beta, my - mx @ beta)


def mean_model(stats: Gram) -> LinearModel:
    return LinearModel([], np.zeros(0), stats.y_sum / stats.weight if stats.weight else 0.0)


@dataclass
class LassoPath:
    """Coefficients at the knots of the path, penalties falling; in between they are linear."""

    features: list[str]
    alphas: np.ndarray
    coefs: np.ndarray
    mean_x: np.ndarray
    mean_y: float

    def at(self, alpha: float) -> LinearModel:
        beta = np.array([np.interp(alpha, self.alphas[::-1], row[::-1]) for row in self.coefs.T])
        return LinearModel(self.features, beta, self.mean_y - self.mean_x @ beta)


def lasso_path(
    stats: Gram, features: Sequence[str], max_knots: int | None = None, method: str = "lasso", positive: bool = False, alpha_min: float = 0.0, fit_intercept: bool = True
) -> LassoPath:
    """Least angle steps from centred statistics; a penalty counts per unit of weight.

    ``method``: "lasso" drops coefficients that reach 0, "lar" goes on through it.  ``positive`` keeps coefficients from
    falling below 0.  The path ends at the penalty ``alpha_min``.  Without an intercept the statistics stay uncentred.
    """
    if method not in ("lasso", "lar"):
        raise ValueError("method is lasso or lar")
    if positive and method == "lar":
        raise ValueError("least angle steps alone don't keep coefficients positive")
    k = len(features)
    g, c, mx, my = stats.centered() if fit_intercept else (stats.xtx, stats.xty, np.zeros(k), 0.0)
    n = stats.weight or 1.0
    size = (lambda x: x) if positive else np.abs
    beta, active, corr = np.zeros(k), [], c.copy()
    level, floor = max(float(np.max(size(corr))), 0.0) if k else 0.0, alpha_min * n
    alphas, coefs, dropped = [level / n], [beta.copy()], None
    for _ in range(max_knots or 8 * k):
        if level <= max(1e-12 * max(1.0, float(np.max(np.abs(c)))), floor):
            break
        if dropped is None:
            rest = [j for j in range(k) if j not in active]
            if rest:
                j = max(rest, key=lambda j: size(corr[j]))
                if size(corr[j]) >= level * (1 - 1e-9):
                    active.append(j)
        sign = np.sign(corr[active])
        move = _solve(g[np.ix_(active, active)], sign)
        fall = g[:, active] @ move
        step, dropped = level - floor, None
        for j in range(k):
            if j not in active:
                ways = [(level - corr[j], 1 - fall[j])] + ([] if positive else [(level + corr[j], 1 + fall[j])])
                for a, b in ways:
                    if b > 1e-12 and 1e-12 < a / b < step:
                        step = a / b
        for p, j in enumerate(active if method == "lasso" else []):
            if move[p] and 1e-12 < -beta[j] / move[p] < step:
                step, dropped = -beta[j] / move[p], j
        beta[active] += step * move
        corr = c - g @ beta
        level -= step
        if dropped is not None:
            beta[dropped] = 0.0
            active.remove(dropped)
        alphas.append(max(level, 0.0) / n)
        coefs.append(beta.copy())
    return LassoPath(list(features), np.array(alphas), np.array(coefs), mx, my)


def score_path(df: DataFrame, path: LassoPath, target: str, alphas: Sequence[float], score) -> DataFrame:
    """One row: ``score(target, column, name)`` of the model at each penalty, all in one aggregate."""
    from depthforge.operators.scores import evaluate

    named = {f"p{i}": path.at(a).column() for i, a in enumerate(alphas)}
    return evaluate(df.withColumns(named), [score(target, p, f"alpha_{i}") for i, p in enumerate(named)])
