"""Folds over dates, parameter sampling, pruning, weighting of fold scores."""

from __future__ import annotations

import itertools
import math
import random
import statistics
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def expanding_folds(chunks: Sequence[Sequence[str]]) -> list[tuple[list[str], list[str]]]:
    """(training dates, validation dates): fold i trains on chunks up to i and validates on the next."""
    if len(chunks) < 2:
        raise ValueError("folds need two chunks at least")
    return [([d for c in chunks[: i + 1] for d in c], list(chunks[i + 1])) for i in range(len(chunks) - 1)]


def fold_column(chunks: Sequence[Sequence[str]], date: str = "date") -> Column:
    """The array of (fold, role) a row belongs to, so that all folds are scored in one pass."""
    roles = []
    for i, (train, valid) in enumerate(expanding_folds(chunks)):
        roles += [F.when(F.col(date).isin(*dates), F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"))) for role, dates in (("train", train), ("valid", valid))]
    return F.filter(F.array(*roles), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, rng: random.Random):
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def draw(self, rng):
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


@dataclass(frozen=True)
class Integer:
    low: int
    high: int

    def draw(self, rng):
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Choice:
    values: Sequence

    def draw(self, rng):
        return rng.choice(list(self.values))


@dataclass(frozen=True)
class Grid(Choice):
    """Values that a grid search takes in turn."""


def suggestions(space: dict, trials: int, sampler: str = "random", seed: int = 0):
    """Parameter sets: drawn with a seed, or all combinations of finite ones."""
    if sampler == "grid":
        bad = [k for k, v in space.items() if not isinstance(v, Choice)]
        if bad:
            raise ValueError(f"a grid needs finite values: {bad}")
        yield from (dict(zip(space, c, strict=True)) for c in itertools.product(*(v.values for v in space.values())))
    elif sampler == "random":
        rng = random.Random(seed)
        for _ in range(trials):
            yield {k: v.draw(rng) if hasattr(v, "draw") else v for k, v in space.items()}
    else:
        raise ValueError("sampler is random or grid")


def size_recency_weights(sizes: Sequence[float], ages: Sequence[float], half_life: float | None = None) -> list[float]:
    """Validation sizes, halved every ``half_life`` of age, adding up to 1."""
    raw = [s * (0.5 ** (a / half_life) if half_life else 1.0) for s, a in zip(sizes, ages, strict=True)]
    return [r / sum(raw) for r in raw] if sum(raw) else [1 / len(raw)] * len(raw)


def weighted_mean(values: Sequence[float], weights: Sequence[float]) -> float:
    return sum(v * w for v, w in zip(values, weights, strict=True)) / sum(weights)


# ---------------------------------------------------------------- Parzen densities


class Parzen:
    """A density on a distribution's scale from what was tried: one bell per value and a wide one over the whole range, or counts of choices."""

    def __init__(self, dist, seen: Sequence):
        self.dist = dist
        self.choices = list(dist.values) if isinstance(dist, Choice) else None
        if self.choices is not None:
            counts = [1.0 + sum(v == c for v in seen) for c in self.choices]
            self.shares = [c / sum(counts) for c in counts]
            return
        self.low, self.high = self._scale(dist.low), self._scale(dist.high)
        if isinstance(dist, Integer):
            self.low, self.high = self.low - 0.5, self.high + 0.5
        span = max(self.high - self.low, 1e-12)
        points = sorted(self._scale(v) for v in seen)
        least = span / min(100, 1 + len(points))
        self.bells = [((self.low + self.high) / 2, span)]
        for i, m in enumerate(points):
            before = m - (points[i - 1] if i else self.low)
            after = (points[i + 1] if i + 1 < len(points) else self.high) - m
            self.bells.append((m, min(max(before, after, least), span)))

    def _scale(self, v: float) -> float:
        return math.log(v) if isinstance(self.dist, LogUniform) else float(v)

    def draw(self, rng: random.Random):
        if self.choices is not None:
            return rng.choices(self.choices, self.shares)[0]
        m, s = rng.choice(self.bells)
        x = rng.gauss(m, s)
        while not self.low <= x <= self.high:
            m, s = rng.choice(self.bells)
            x = rng.gauss(m, s)
        if isinstance(self.dist, Integer):
            return min(max(round(x), self.dist.low), self.dist.high)
        return math.exp(x) if isinstance(self.dist, LogUniform) else x

    def log_density(self, value) -> float:
        if self.choices is not None:
            return math.log(self.shares[self.choices.index(value)])
        x, total = self._scale(value), 0.0
        for m, s in self.bells:
            inside = 0.5 * (math.erf((self.high - m) / s / math.sqrt(2)) - math.erf((self.low - m) / s / math.sqrt(2)))
            total += math.exp(-0.5 * ((x - m) / s) ** 2) / s / max(inside, 1e-300)
        return math.log(max(total / len(self.bells), 1e-300))


@dataclass
class Trial:
    params: dict
    value: float | None = None
    reports: list[float] = field(default_factory=list)
    state: str = "running"  # then complete or pruned


class Pruned(Exception):
    """Raised when a trial isn't worth its further folds."""


@dataclass
class MedianPruner:
    """Gives a trial up whose score after a fold is worse than the median of the finished trials' scores after it."""

    startup: int = 5
    warmup: int = 0

    def __call__(self, trials: Sequence[Trial], trial: Trial, maximize: bool) -> bool:
        step = len(trial.reports) - 1
        others = [t.reports[step] for t in trials if t.state == "complete" and len(t.reports) > step]
        done = sum(t.state == "complete" for t in trials)
        if done < self.startup or step < self.warmup or not others:
            return False
        bound = statistics.median(others)
        return trial.reports[-1] < bound if maximize else trial.reports[-1] > bound


@dataclass
class Study:
    """Trials one after another: each asks for parameters that the earlier ones suggest and reports a score per fold.

    ``tpe``: after ``startup`` random trials the best share of them, and the others, give each parameter two Parzen
    densities; of ``candidates`` draws from the first, the one that is likeliest by their ratio is tried.  A pruned trial
    counts by its last report.
    """

    space: dict
    sampler: str = "random"
    seed: int = 0
    maximize: bool = False
    pruner: Callable | None = None
    startup: int = 10
    candidates: int = 24
    trials: list[Trial] = field(default_factory=list)

    def __post_init__(self):
        if self.sampler not in ("random", "grid", "tpe"):
            raise ValueError("sampler is random, grid or tpe")
        self.rng = random.Random(self.seed)

    def ask(self, n: int):
        """``n`` trials, or as many as a grid has."""
        if self.sampler == "grid":
            every = list(suggestions(self.space, n, "grid"))
            for params in every[sum(t.state != "running" for t in self.trials) :]:
                yield self._begin(params)
            return
        for _ in range(n):
            yield self._begin(self._tpe() if self.sampler == "tpe" else {k: v.draw(self.rng) if hasattr(v, "draw") else v for k, v in self.space.items()})

    def _begin(self, params: dict) -> Trial:
        self.trials.append(Trial(params))
        return self.trials[-1]

    def _tpe(self) -> dict:
        done = [(t.value if t.state == "complete" else t.reports[-1], i, t) for i, t in enumerate(self.trials) if t.state == "complete" or t.state == "pruned" and t.reports]
        if len(done) < self.startup:
            return {k: v.draw(self.rng) if hasattr(v, "draw") else v for k, v in self.space.items()}
        ranked = [t for *_, t in sorted(done, key=lambda d: (-d[0] if self.maximize else d[0], d[1]))]
        n = min(math.ceil(0.1 * len(ranked)), 25)
        out = {}
        for k, v in self.space.items():
            if not hasattr(v, "draw"):
                out[k] = v
                continue
            good, bad = Parzen(v, [t.params[k] for t in ranked[:n]]), Parzen(v, [t.params[k] for t in ranked[n:]])
            drawn = [good.draw(self.rng) for _ in range(self.candidates)]
            out[k] = max(drawn, key=lambda x: good.log_density(x) - bad.log_density(x))
        return out

    def report(self, trial: Trial, score: float) -> None:
        """The score after one more fold; raises if the pruner gives the trial up."""
        trial.reports.append(score)
        if self.pruner and self.pruner(self.trials[:-1], trial, self.maximize):
            trial.state = "pruned"
            raise Pruned

    def best(self) -> Trial:
        """The best finished trial; the first of equals."""
        done = [t for t in self.trials if t.state == "complete"]
        if not done:
            raise ValueError("no trial was finished")
        return (max if self.maximize else min)(done, key=lambda t: t.value)

    def run(self, objective: Callable[[Trial], float], n: int) -> Trial:
        for trial in self.ask(n):
            try:
                trial.value = objective(trial)
                trial.state = "complete"
            except Pruned:
                trial.state = "pruned"
        return self.best()


def search(space: dict, objective: Callable[[dict], float], trials: int = 20, sampler: str = "random", seed: int = 0, maximize: bool = False) -> tuple[dict, float, list]:
    """(best parameters, score, history); the first of equals wins."""
    study = Study(space, sampler, seed, maximize)
    best = study.run(lambda t: objective(t.params), trials)
    return best.params, best.value, [(t.params, t.value) for t in study.trials]
