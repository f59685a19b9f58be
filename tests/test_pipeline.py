"""Models of rows in the pipeline, pruning, prediction frames, runs read back."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthforge.operators import scores
from depthforge.plans import pipeline, search
from depthforge.sources import dated

QUANTILES = [0.1, 0.5, 0.9]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(480):
        a, b = rng.normal(size=2)
        day = i // 120
        rows.append((f"d{day}", "normal", dt.datetime(2024, 1, 1 + day, 9, 0) + dt.timedelta(seconds=i), 7, i, float(a), float(b), float(2 * a + abs(b) * rng.normal()), 1.0))
    return spark.createDataFrame(rows, "date string, nature string, ts_event timestamp, instrument_id int, row_nr bigint, a double, b double, y double, w double").cache()


def source(df):
    return dated.DataSource(lambda dates: df.where(F.col("date").isin(*dates)), ["d0"], "y", ["a", "b"], weight="w")


CHUNKS = [["d0"], ["d1"], ["d2"], ["d3"]]


def pinball(y, names):
    return scores.pinball(y, names, QUANTILES)


@pytest.fixture(scope="module")
def boosted(df):
    adapter = pipeline.BoostedAdapter(QUANTILES, rounds=4, patience=2)
    run = pipeline.Pipeline(source(df), CHUNKS[:3], adapter, {"depth": search.Grid([2, 1]), "learning_rate": search.Grid([0.5, 1e-6])}, score=pinball, sampler="grid", pruner=search.MedianPruner(startup=1))
    run.train()
    return run


def test_boosted_search_prunes(boosted):
    """The trials that hardly learn are given up after their first fold."""
    assert [t.params for t in boosted.study.trials][0] == {"depth": 2, "learning_rate": 0.5} and boosted.best["learning_rate"] == 0.5
    states = {(t.params["depth"], t.params["learning_rate"]): (t.state, len(t.reports)) for t in boosted.study.trials}
    assert states[2, 1e-6] == states[1, 1e-6] == ("pruned", 1) and states[2, 0.5] == ("complete", 2)
    assert [v for p, v in boosted.history if p["learning_rate"] == 1e-6] == [None, None] and boosted.best_score > 0
    assert len(boosted.adapter.fits) == sum(len(t.reports) for t in boosted.study.trials)


def test_boosted_refit_test_predict_and_read_back(boosted, df, tmp_path, spark):
    boosted.refit([d for c in CHUNKS for d in c], validation=["d3"])
    loss = boosted.test(["d3"]).head()[0]
    out = boosted.predict(df, start="2024-01-04", end="2024-01-04")
    assert out.columns == ["date", "ts_event", "instrument_id", "row_nr", "y", "prediction_q10", "prediction_q50", "prediction_q90"] and out.count() == 120
    assert abs(scores.evaluate(out, [pinball("y", ["prediction_q10", "prediction_q50", "prediction_q90"])]).head()[0] - loss) < 1e-9
    path = boosted.save(str(tmp_path))
    again = pipeline.Pipeline.from_saved(str(tmp_path), source(df), path.rsplit("/", 1)[1], score=pinball)
    assert again.best == boosted.best and again.adapter.outputs() == boosted.adapter.outputs() and again.chunks == boosted.chunks
    assert sorted(again.predict(df).collect()) == sorted(boosted.predict(df).collect()) and again.test(["d3"]).head()[0] == loss
    assert pipeline.load_model(pipeline.load_run(str(tmp_path))).quantiles == QUANTILES
    with pytest.raises(ValueError):
        pipeline.Pipeline.from_saved(str(tmp_path), source(df), adapter=pipeline.RidgeAdapter())


@pytest.fixture(scope="module")
def ridge(df):
    run = pipeline.Pipeline(source(df), CHUNKS, pipeline.RidgeAdapter(), {"alpha": search.LogUniform(1e-3, 1e5)}, sampler="tpe", trials=14, seed=1)
    run.train()
    run.refit()
    return run


def test_linear_search_by_densities(ridge, df):
    assert len(ridge.history) == 14 and ridge.best["alpha"] < 100
    one = pipeline.Pipeline(source(df), CHUNKS, pipeline.RidgeAdapter(), {"alpha": search.Grid([1e5, 1.0])}, sampler="grid", pruner=lambda trials, t, m: False)
    two = pipeline.Pipeline(source(df), CHUNKS, pipeline.RidgeAdapter(), {"alpha": search.Grid([1e5, 1.0])}, sampler="grid")
    assert one.train() == two.train() == {"alpha": 1.0} and np.allclose([v for _, v in one.history], [v for _, v in two.history])


def test_prediction_frame(ridge, df):
    assert ridge.predict(df, "p", keys=["row_nr", "row_nr"], predicate=F.col("a") > 0).columns == ["row_nr", "y", "p"]
    assert ridge.predict(df, groups=[[F.col("a") > 9, F.col("b") > 9]], start="2024-01-02").count() == 0
    empty = ridge.predict(df.where("false"))
    assert empty.count() == 0 and [f.dataType.simpleString() for f in empty.schema] == ["string", "timestamp", "int", "bigint", "double", "double"]
    local = ridge.predict(df, start="2024-01-02T04:00:00", end="2024-01-02T23:59:59", timezone="America/New_York")
    assert {r.date for r in local.collect()} == {"d1"} and ridge.predict(df.drop("y")).columns[-1] == "prediction"
    for bad in ({"names": ["p", "q"]}, {"names": "a"}, {"keys": "none"}, {"start": "2024-01-03", "end": "2024-01-02"}, {"start": "2024-01-03", "time": "none"}):
        with pytest.raises(ValueError):
            ridge.predict(df, **bad)
    with pytest.raises(RuntimeError):
        pipeline.Pipeline(source(df), CHUNKS, pipeline.RidgeAdapter(), {}).predict(df)


def test_folds_without_rows(df):
    """They have no score, and don't count as a perfect one."""
    with_gap = pipeline.Pipeline(source(df), [["d0"], ["none"], ["d1"]], pipeline.RidgeAdapter(), {"alpha": search.Grid([1.0])}, sampler="grid")
    with_gap.train()
    assert with_gap.best_score > 0.1
    with pytest.raises(ValueError):
        pipeline.Pipeline(source(df), [["d0"], ["none"]], pipeline.RidgeAdapter(), {"alpha": search.Grid([1.0])}, sampler="grid").train()


def test_lasso_paths_are_bounded(df):
    adapter = pipeline.LassoAdapter()
    adapter.KEPT = 2
    from depthforge.operators import linear

    grams = [linear.gram(df.where(F.col("date") == d), ["a", "b"], "y") for d in ("d0", "d1", "d2")]
    for g in grams:
        adapter.fit(g, ["a", "b"], {"alpha": 0.1})
    assert len(adapter._paths) == 2
