"""Search over expanding folds, refit, test, prediction frames, and saved runs.

Training statistics of all dates are one aggregate per date; any fold's are sums of its dates', so a fold costs no
further pass.  Scores are mergeable states per date for the same reason.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.functions.bounds import between
from depthforge.operators import boosting, linear, neural, scores
from depthforge.operators.filters import all_groups
from depthforge.plans.registry import NullTracker, fingerprint, read_json, write_json
from depthforge.plans.search import Study, Trial, expanding_folds, size_recency_weights, weighted_mean
from depthforge.sources.dated import DataSource


class Adapter:
    """A model kind: builds a model from statistics or a frame, given parameters."""

    name = "adapter"

    #: Whether :meth:`fit_rows` is to be used: the model needs more of the rows than their sums.
    rows = False

    def outputs(self) -> list[str]:
        """Names of what the model predicts."""
        return ["prediction"]

    def fit(self, stats: linear.Gram, features: Sequence[str], params: dict) -> linear.LinearModel:
        raise NotImplementedError

    def fit_rows(self, train: DataFrame, valid: DataFrame | None, features: Sequence[str], target: str, weight: str | None, params: dict):
        raise NotImplementedError

    def load(self, text: str):
        """A model from its JSON."""
        return linear.LinearModel.from_json(text)


class BoostedAdapter(Adapter):
    """Boosted trees for quantiles; parameters are those of :func:`depthforge.operators.boosting.fit`.

    The rounds of each fit, up to the best one on its validation rows, are in ``fits``.
    """

    name, rows = "boosted_quantiles", True

    def __init__(self, quantiles: Sequence[float] = (0.5,), rounds: int = 100, patience: int | None = None):
        self.quantiles, self.rounds, self.patience = list(quantiles), rounds, patience
        self.fits: list[int] = []

    def outputs(self):
        return [quantile_name(q) for q in self.quantiles]

    def fit_rows(self, train, valid, features, target, weight, params):
        settings = {"rounds": self.rounds, "patience": self.patience if valid is not None else None} | params
        model = boosting.fit(train, features, target, self.quantiles, weight, valid, **settings)
        self.fits.append(len(model.rounds))
        return model

    def load(self, text):
        return boosting.BoostedQuantiles.from_json(text)


class NetworkAdapter(Adapter):
    """A layered network; parameters are those of :func:`depthforge.operators.neural.fit`, set here or by the search."""

    name, rows = "network", True

    def __init__(self, quantiles: Sequence[float] | None = None, **settings):
        self.quantiles, self.settings = list(quantiles) if quantiles else None, settings

    def outputs(self):
        return [quantile_name(q) for q in self.quantiles] if self.quantiles else ["prediction"]

    def fit_rows(self, train, valid, features, target, weight, params):
        return neural.fit(train, features, target, weight, valid, quantiles=self.quantiles, **(self.settings | params))

    def load(self, text):
        return neural.Network.from_json(text)


class MeanAdapter(Adapter):
    name = "mean"

    def fit(self, stats, features, params):
        return linear.mean_model(stats)


class LeastSquaresAdapter(Adapter):
    name = "least_squares"

    def fit(self, stats, features, params):
        return linear.ridge(stats, features, 0.0)


class RidgeAdapter(Adapter):
    name = "ridge"

    def fit(self, stats, features, params):
        return linear.ridge(stats, features, params.get("alpha", 1.0), params.get("fit_intercept", True))


class LassoAdapter(Adapter):
    """One path for each set of statistics serves all penalties; further parameters are the path's options."""

    name = "lasso"

    #: Paths that are kept: those of a search's folds.
    KEPT = 64

    def __init__(self):
        self._paths: dict = {}

    def fit(self, stats, features, params):
        options = {k: params[k] for k in ("method", "positive", "alpha_min", "fit_intercept") if k in params}
        key = (id(stats), tuple(features), *sorted(options.items()))
        if key not in self._paths:
            if len(self._paths) >= self.KEPT:
                del self._paths[next(iter(self._paths))]
            self._paths[key] = (stats, linear.lasso_path(stats, features, **options))
        return self._paths[key][1].at(params.get("alpha", 0.0))


ADAPTERS = {a.name: a for a in (MeanAdapter, LeastSquaresAdapter, RidgeAdapter, LassoAdapter, BoostedAdapter, NetworkAdapter)}


def gram_by_date(df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, date: str = "date") -> dict[str, linear.Gram]:
    return linear.grams_by(df, features, target, weight, date)


@dataclass
class Pipeline:
    source: DataSource
    chunks: Sequence[Sequence[str]]
    adapter: Adapter
    space: dict
    #: Of the target's name and the prediction's, or the list of predictions of an adapter with several outputs.
    score: Callable[..., scores.Score] = scores.rmse
    maximize: bool = False
    trials: int = 20
    sampler: str = "random"
    seed: int = 0
    recency_half_life: float | None = None
    pruner: Callable | None = None
    tracker: NullTracker = field(default_factory=NullTracker)
    best: dict | None = None
    best_score: float | None = None
    history: list = field(default_factory=list)
    model: object | None = None
    study: Study | None = None

    def _dates(self) -> list[str]:
        return list(dict.fromkeys(d for c in self.chunks for d in c))

    def _frame(self, dates: Sequence[str]) -> DataFrame:
        return self.source.with_(dates=list(dates)).frame()

    def _sum(self, by_date, dates):
        return reduce(lambda a, b: a + b, [by_date[d] for d in dates if d in by_date])

    def _score(self, names: Sequence[str]) -> scores.Score:
        return self.score(self.source.target, names[0] if len(names) == 1 else list(names))

    def _predicted(self, model, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return model.predict(df, names if self.adapter.rows else names[0])

    def train(self) -> dict:
        """The best parameters by the fold-weighted score.

        Models of sums are fitted to every fold from one pass, and all folds of a trial are scored in one job.  With a
        pruner, or models of rows, folds come one after another and a trial stops when it is given up.
        """
        s = self.source
        frame = self._frame(self._dates()).persist()
        folds = expanding_folds(self.chunks)
        self.study = Study(self.space, self.sampler, self.seed, self.maximize, self.pruner)
        try:
            sizes = {str(r["date"]): r["n"] for r in frame.groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per date
            stats = None if self.adapter.rows else gram_by_date(frame, s.features, s.target, s.weight)
            sums = None if stats is None else [self._sum(stats, train) for train, _ in folds]
            if stats is not None:
                sizes = {d: g.n for d, g in stats.items()}
            weights = size_recency_weights([sum(sizes.get(d, 0) for d in valid) for _, valid in folds], range(len(folds) - 1, -1, -1), self.recency_half_life)
            used = [i for i, (_, valid) in enumerate(folds) if any(sizes.get(d) for d in valid)]  # a fold without rows has no score
            if not used:
                raise ValueError("no fold has rows to score")
            names = [f"_p{i}" for i in range(len(self.adapter.outputs()))]

            def one_by_one(trial: Trial) -> float:
                found = []
                for i in used:
                    train, valid = (frame.where(F.col("date").isin(*d)) for d in folds[i])
                    model = self.adapter.fit_rows(train, valid, s.features, s.target, s.weight, trial.params) if self.adapter.rows else self.adapter.fit(sums[i], s.features, trial.params)
                    found.append(scores.evaluate(self._predicted(model, valid, names), [self._score(names)]).head()[0])
                    running = weighted_mean(found, [weights[j] for j in used[: len(found)]])
                    self.tracker.log(len(self.study.trials) - 1, score=running, fold=i)
                    if i != used[-1]:
                        self.study.report(trial, running)
                trial.reports.append(running)
                return running

            def at_once(trial: Trial) -> float:
                models = [self.adapter.fit(g, s.features, trial.params) for g in sums]
                prediction, fold = F.lit(None).cast("double"), F.lit(None).cast("int")
                for i, (_, valid) in enumerate(folds):
                    prediction = F.when(F.col("date").isin(*valid), models[i].column()).otherwise(prediction)
                    fold = F.when(F.col("date").isin(*valid), i).otherwise(fold)
                scored = frame.withColumn("_p0", prediction).withColumn("_fold", fold).where("_fold is not null")
                one = self._score(names)
                by_fold = {r["_fold"]: r[one.name] for r in scores.evaluate(scored, [one], ["_fold"]).collect()}
                value = weighted_mean([by_fold[i] for i in used], [weights[i] for i in used])
                self.tracker.log(len(self.study.trials) - 1, score=value)
                return value

            best = self.study.run(one_by_one if self.pruner or self.adapter.rows else at_once, self.trials)
            self.best, self.best_score = best.params, best.value
            self.history = [(t.params, t.value) for t in self.study.trials]
        finally:
            frame.unpersist()
        return self.best

    def refit(self, dates: Sequence[str] | None = None, validation: Sequence[str] = ()):
        """The model of the best parameters on all dates but those of validation, on which models of rows stop early."""
        s = self.source
        use = [d for d in (dates or self._dates()) if d not in set(validation)]
        if self.adapter.rows:
            held = self._frame(list(validation)) if validation else None
            self.model = self.adapter.fit_rows(self._frame(use), held, s.features, s.target, s.weight, self.best or {})
        else:
            self.model = self.adapter.fit(linear.gram(self._frame(use), s.features, s.target, s.weight), s.features, self.best or {})
        return self.model

    def test(self, dates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        names = [f"_p{i}" for i in range(len(self.adapter.outputs()))]
        return scores.evaluate(self._predicted(self._fitted(), self._frame(dates), names), [self._score(names)], by)

    def _fitted(self):
        if self.model is None:
            raise RuntimeError("refit or load a run first")
        return self.model

    def predict(
        self, df: DataFrame, names: Sequence[str] | str | None = None, groups: Sequence[Sequence[Column]] = (), keys: Sequence[str] | None = None, start=None, end=None, timezone: str = "UTC",
        time: str = "ts_event", predicate: Column | None = None,
    ) -> DataFrame:
        """Keys, target and predictions of the rows that pass one filter of each group, the bounds and the predicate.

        Without ``names`` they are the adapter's: prediction, or one for each quantile.  Without ``keys`` they are those
        of date, time, instrument, row and sequence that ``df`` has; keys that are asked for must exist.  Bounds are
        inclusive, and local to ``timezone`` unless they name one.  A frame without rows has the same columns and types.
        """
        model = self._fitted()
        names = [names] if isinstance(names, str) else list(names) if names is not None else self.adapter.outputs()
        if len(names) != len(self.adapter.outputs()):
            raise ValueError(f"{len(self.adapter.outputs())} predictions, {len(names)} names")
        if keys is None:
            keys = [k for k in ("date", time, "instrument_id", "row_nr", "sequence") if k in df.columns]
        else:
            keys = list(dict.fromkeys([keys] if isinstance(keys, str) else keys))
            missing = [k for k in keys if k not in df.columns]
            if missing:
                raise ValueError(f"no such key columns: {missing}")
        shown = list(dict.fromkeys([*keys, *(c for c in [self.source.target] if c in df.columns)]))
        taken = [n for n in names if n in df.columns] + [n for n in set(names) if names.count(n) > 1]
        if taken:
            raise ValueError(f"columns exist: {taken}")
        out = df.where(all_groups(*groups))
        if start is not None or end is not None:
            if time not in df.columns:
                raise ValueError(f"no time column {time}")
            out = out.where(between(F.col(time), start, end, timezone))
        if predicate is not None:
            out = out.where(predicate)
        return self._predicted(model, out, names).select(*shown, *names)

    def save(self, folder: str) -> str:
        """Write the run as JSON to a new folder below ``folder``; returns its path."""
        body = {
            "version": 3, "adapter": self.adapter.name, "outputs": self.adapter.outputs(), "features": list(self.source.features), "target": self.source.target, "chunks": [list(c) for c in self.chunks],
            "weight": self.source.weight, "sampler": self.sampler, "seed": self.seed, "trials": self.trials, "maximize": self.maximize, "recency_half_life": self.recency_half_life,
            "states": [t.state for t in self.study.trials] if self.study else [], "best_params": self.best, "best_score": self.best_score, "history": self.history, "model": self.model.to_json() if self.model else None,
        }
        path = os.path.join(folder, f"pipeline_{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S}_{fingerprint(body)[:8]}")
        os.makedirs(path)
        write_json(os.path.join(path, "pipeline.json"), body)
        return path


    @classmethod
    def from_saved(cls, folder: str, source: DataSource, selector: str | None = None, adapter: Adapter | None = None, **changes) -> Pipeline:
        """The pipeline of a saved run, with its model: it predicts and tests at once.

        ``source`` brings the loader, its filters and transform, which are code; features, target and weight are the
        run's.  ``adapter`` replaces the one of the run's name, if it needs arguments or isn't in ``ADAPTERS``.
        """
        body = load_run(folder, selector)
        if adapter is None:
            if body["adapter"] not in ADAPTERS:
                raise ValueError(f"unknown adapter {body['adapter']}: pass one")
            adapter = ADAPTERS[body["adapter"]]()
        if adapter.name != body["adapter"]:
            raise ValueError(f"the run's adapter is {body['adapter']}")
        kept = {k: body[k] for k in ("sampler", "seed", "trials", "maximize", "recency_half_life") if k in body}
        run = cls(source.with_(features=body["features"], target=body["target"], weight=body.get("weight", source.weight)), body["chunks"], adapter, **({"space": {}} | kept | changes))
        run.best, run.best_score, run.history = body["best_params"], body["best_score"], [tuple(h) for h in body["history"]]
        if body.get("model"):
            run.model = adapter.load(body["model"])
            if adapter.rows:
                adapter.quantiles = run.model.quantiles
        return run


def quantile_name(q: float) -> str:
    return f"prediction_q{q * 100:g}".replace(".", "_")


def learning_curves(spark, model) -> DataFrame:
    """(step, series, loss): the losses of a model's rounds or epochs, to draw; step 0 of boosted trees is the value they begin from."""
    rows = []
    for i, h in enumerate(model.history):
        losses = {k: v for k, v in h.items() if k != "epoch"} if isinstance(h, dict) else {"valid": h}
        rows += [(i, k, None if v is None else float(v)) for k, v in losses.items()]
    return spark.createDataFrame(rows, "step int, series string, loss double")


def load_run(folder: str, selector: str | None = None) -> dict:
    """The manifest of the one run that starts with ``selector`` (None: the latest); versions 2 and 3."""
    runs = sorted(d for d in os.listdir(folder) if d.startswith(selector or "pipeline_"))
    if not runs or selector and len(runs) > 1:
        raise FileNotFoundError(f"{len(runs)} runs start with {selector}")
    body = read_json(os.path.join(folder, runs[-1], "pipeline.json"))
    if body.get("version") not in (2, 3):
        raise ValueError(f"manifest version {body.get('version')}")
    return body


def load_model(manifest: dict):
    """The model of a manifest of :func:`load_run`."""
    return ADAPTERS[manifest["adapter"]]().load(manifest["model"])
