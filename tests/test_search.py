"""Samplers and pruning on known surfaces."""

import math
import random

import pytest

from depthforge.plans.search import Choice, Grid, Integer, LogUniform, MedianPruner, Parzen, Pruned, Study, Trial, Uniform, search

SPACE = {"x": Uniform(-4.0, 4.0), "lr": LogUniform(1e-4, 1.0), "n": Integer(1, 40), "kind": Choice(["a", "b", "c"]), "fixed": 3}


def surface(p):
    return (p["x"] - 1.5) ** 2 + (math.log10(p["lr"]) + 2) ** 2 + (p["n"] - 12) ** 2 / 50 + {"a": 1.0, "b": 0.0, "c": 2.0}[p["kind"]]


def test_tpe_beats_random():
    found = {s: [search(SPACE, surface, 60, s, seed)[1] for seed in range(8)] for s in ("tpe", "random")}
    assert sum(found["tpe"]) < 0.5 * sum(found["random"]) and sum(t < r for t, r in zip(found["tpe"], found["random"], strict=True)) >= 6


def test_tpe_turns_over_for_maxima_and_is_seeded():
    up = [search(SPACE, lambda p: -surface(p), 40, "tpe", 2, True), search(SPACE, surface, 40, "tpe", 2)]
    assert up[0][0] == up[1][0] and up[0][1] == -up[1][1]
    assert search(SPACE, surface, 15, "tpe", 3)[2] == search(SPACE, surface, 15, "tpe", 3)[2]
    first = search(SPACE, surface, 10, "tpe", 4)[2]
    assert first == search(SPACE, surface, 10, "random", 4)[2]  # too few trials for densities


def test_densities():
    rng = random.Random(0)
    for dist, seen in ((Uniform(0.0, 2.0), [0.3, 0.31, 1.9]), (LogUniform(1e-3, 10.0), [0.01, 1.0]), (Uniform(1.0, 1.0), [1.0])):
        p = Parzen(dist, seen)
        assert all(dist.low <= p.draw(rng) <= dist.high for _ in range(200))
        if dist.high > dist.low:
            n = 4000
            at = [p.low + (i + 0.5) * (p.high - p.low) / n for i in range(n)]
            mass = sum(math.exp(p.log_density(math.exp(x) if isinstance(dist, LogUniform) else x)) / math.sqrt(2 * math.pi) for x in at) * (p.high - p.low) / n
            assert abs(mass - 1) < 1e-3
    assert Parzen(Uniform(0.0, 2.0), [0.3] * 9).log_density(0.3) > Parzen(Uniform(0.0, 2.0), [1.9] * 9).log_density(0.3)
    whole = Parzen(Integer(1, 3), [2, 2, 3])
    assert {whole.draw(rng) for _ in range(300)} == {1, 2, 3}
    assert Parzen(Choice("ab"), ["a"] * 8).log_density("a") == math.log(0.9)


def test_median_pruning():
    """A trial stops before its last fold when the finished ones were better after as many."""
    calls = []

    def objective(trial, study):
        running = []
        for fold in range(3):
            calls.append((trial.params["x"], fold))
            running.append(trial.params["x"])
            study.report(trial, sum(running) / len(running))
        return sum(running) / len(running)

    study = Study({"x": Grid([1.0, 2.0, 3.0, 9.0, 0.5])}, "grid", pruner=MedianPruner(startup=3))
    best = study.run(lambda t: objective(t, study), 5)
    assert best.params == {"x": 0.5} and [t.state for t in study.trials] == ["complete"] * 3 + ["pruned", "complete"]
    assert [f for x, f in calls if x == 9.0] == [0] and study.trials[3].reports == [9.0] and study.trials[3].value is None
    up = Trial({}, None, [1.0])
    assert MedianPruner(1)([Trial({}, 2.0, [2.0], "complete")], up, True) and not MedianPruner(1)([Trial({}, 2.0, [2.0], "complete")], up, False)
    assert not MedianPruner(1, warmup=1)([Trial({}, 2.0, [2.0], "complete")], up, True)


def test_all_pruned_and_unknown():
    study = Study(SPACE, "random")

    def give_up(_):
        raise Pruned

    with pytest.raises(ValueError):
        study.run(give_up, 2)
    with pytest.raises(ValueError):
        Study(SPACE, "sobol")
