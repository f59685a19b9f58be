import datetime as dt
import json
import math

import numpy as np
import pytest
from concurrent.futures import ThreadPoolExecutor
from pyspark.sql import functions as F

from depthforge.functions.exprs import UNDEF
from depthforge.operators import filters, linear, quality, relational, reports, sampling, scores, transforms
from depthforge.plans import pipeline, registry, search
from depthforge.sources import dated


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3))
    y = x @ np.array([2.0, -1.0, 0.0]) + 0.5 + rng.normal(scale=0.1, size=n)
    rows = [(int(i), f"d{i % 4}", float(a), float(b), float(c), float(t), float(1 + i % 3)) for i, ((a, b, c), t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_nr bigint, date string, a double, b double, c double, y double, w double"), x, y


def test_scores_against_numpy(table):
    df, x, y = table
    p, e, w = x[:, 0], y - x[:, 0], np.array([1 + i % 3 for i in range(len(y))])
    wanted = [scores.rmse("y", "a"), scores.weighted_rmse("y", "a", "w"), scores.r2("y", "a"), scores.correlation("y", "a"), scores.unit_pnl("y", "a", 0.5, 1), scores.quantile_pnl("y", ["a", "b"], 1, 0, 0.2, -0.2), scores.pinball("y", ["a", "b"], [0.1, 0.9])]
    r = scores.evaluate(df, wanted).first()
    act = np.abs(p) > 0.5
    buy, sell = x[:, 1] > 0.2, p < -0.2
    buy, sell = buy & ~sell, sell & ~buy
    pin = np.maximum(0.1 * e, -0.9 * e).sum() + np.maximum(0.9 * (y - x[:, 1]), -0.1 * (y - x[:, 1])).sum()
    want = [
        np.sqrt((e**2).mean()), np.sqrt((w * e**2).sum() / w.sum()), 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), np.corrcoef(y, p)[0, 1],
        (p[act] * y[act]).sum() / np.abs(p[act]).sum(), (y[buy].sum() - y[sell].sum()) / (buy.sum() + sell.sum()), pin / (2 * len(y)),
    ]
    assert np.allclose(list(r), want)
    parts = [scores.state(df.where(F.col("row_nr") % 3 == i), wanted) for i in range(3)]
    merged = scores.values(scores.merge(relational.union_same(*parts), wanted), wanted).first()
    assert np.allclose(list(merged), want)


def test_scores_of_nothing_and_bad_weights(spark, table):
    df = table[0]
    wanted = [scores.rmse("y", "a"), scores.r2("y", "a"), scores.correlation("y", "a"), scores.unit_pnl("y", "a"), scores.pinball("y", ["a"])]
    assert list(scores.evaluate(df.limit(0), wanted).first()) == [0.0] * 5
    flat = df.withColumn("y", F.lit(1.0))
    assert scores.evaluate(flat.withColumn("a", F.lit(1.0)), [scores.r2("y", "a")]).first()[0] == 1.0
    with pytest.raises(Exception, match="nonnegative"):
        scores.evaluate(df.withColumn("w", F.lit(-1.0)), [scores.weighted_rmse("y", "a", "w")]).collect()
    with pytest.raises(ValueError):
        scores.quantile_pnl("y", ["a"], 1)
    ctx = scores.context(df.withColumn("nature", F.lit("normal"))).first()
    assert ctx.n == 400 and ctx.dates == ["d0", "d1", "d2", "d3"] and ctx.natures == ["normal"]


def test_linear_models(table):
    df, x, y = table
    g = linear.gram(df, ["a", "b", "c"], "y")
    one = np.column_stack([x, np.ones(len(y))])
    ols = np.linalg.lstsq(one, y, rcond=None)[0]
    m = linear.ridge(g, ["a", "b", "c"])
    assert np.allclose([*m.coef, m.intercept], ols) and g.n == 400
    assert np.allclose([r.prediction for r in m.predict(df).orderBy("row_nr").collect()], one @ ols)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(linear.ridge(g, ["a", "b", "c"], 7.0).coef, np.linalg.solve(xc.T @ xc + 7 * np.eye(3), xc.T @ yc))
    path = linear.lasso_path(g, ["a", "b", "c"])
    for alpha in (0.05, 0.5, 1.5):
        beta = np.zeros(3)
        for _ in range(500):
            for j in range(3):
                r = yc - xc @ beta + xc[:, j] * beta[j]
                c = xc[:, j] @ r / len(y)
                beta[j] = np.sign(c) * max(abs(c) - alpha, 0) / (xc[:, j] @ xc[:, j] / len(y))
        assert np.allclose(path.at(alpha).coef, beta, atol=1e-6)
    halves = [linear.gram(df.where(F.col("row_nr") % 2 == i), ["a", "b", "c"], "y") for i in (0, 1)]
    assert np.allclose((halves[0] + halves[1]).xtx, g.xtx) and linear.LinearModel.from_json(m.to_json()).features == ["a", "b", "c"]


def test_pipeline(table, tmp_path, spark):
    df = table[0].withColumn("nature", F.lit("normal"))
    source = dated.DataSource(lambda dates: df.where(F.col("date").isin(*dates)), ["d0"], "y", ["a", "b", "c"])
    run = pipeline.Pipeline(source, [["d0"], ["d1"], ["d2"], ["d3"]], pipeline.RidgeAdapter(), {"alpha": search.Grid([0.0, 1000.0])}, sampler="grid")
    assert run.train() == {"alpha": 0.0} and len(run.history) == 2 and run.best_score < 0.2
    run.refit(validation=["d3"])
    assert run.test(["d3"]).first()[0] < 0.2
    assert run.predict(df, groups=[[F.col("a") > 0]]).where("prediction is null").count() == 0
    with pytest.raises(ValueError):
        run.predict(df.withColumn("prediction", F.lit(1)))
    path = run.save(str(tmp_path))
    body = pipeline.load_run(str(tmp_path), path.rsplit("/", 1)[1][:20])
    assert body["best_params"] == {"alpha": 0.0} and np.allclose(pipeline.load_model(body).coef, run.model.coef)
    lasso = pipeline.Pipeline(source, [["d0", "d1"], ["d2", "d3"]], pipeline.LassoAdapter(), {"alpha": search.LogUniform(1e-3, 1)}, trials=3)
    assert lasso.train()["alpha"] > 0 and pipeline.quantile_name(0.1) == "prediction_q10"
    batches = list(source.with_(dates=["d0", "d1"]).batches(90))
    assert [len(b[1]) for b in batches] == [90, 90, 20] and source.count() == 100 and source.labels().columns == ["y", "date", "nature"]


def test_search():
    with pytest.raises(ValueError):
        search.expanding_folds([["a"]])
    assert search.expanding_folds([["a"], ["b"], ["c"]]) == [(["a"], ["b"]), (["a", "b"], ["c"])]
    assert list(search.suggestions({"x": search.Grid([1, 2]), "y": search.Grid([3])}, 0, "grid")) == [{"x": 1, "y": 3}, {"x": 2, "y": 3}]
    with pytest.raises(ValueError):
        list(search.suggestions({"x": search.Uniform(0, 1)}, 1, "grid"))
    assert list(search.suggestions({"x": search.Integer(1, 9), "z": 4}, 3)) == list(search.suggestions({"x": search.Integer(1, 9), "z": 4}, 3))
    assert np.allclose(search.size_recency_weights([1, 1], [1, 0], 1), [1 / 3, 2 / 3]) and search.weighted_mean([1, 3], [1, 1]) == 2


def test_transforms(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), 5.0), (None, None)], "x double, k double")
    fitted = transforms.compose(transforms.Standardizer(["x", "k"]), None, transforms.ReturnNormalizer("k", "x", 0.5)).fit(df)
    s = fitted.steps[0]
    assert s.means == {"x": 2.0, "k": 5.0} and s.deviations["k"] == 1.0 and math.isclose(s.deviations["x"], math.sqrt(2))
    path = str(tmp_path / "t.json")
    mark = transforms.save_transform(fitted, path)
    again = transforms.load_transform(path, mark)
    assert [str(r) for r in again.apply(df).collect()] == [str(r) for r in fitted.apply(df).collect()]
    with pytest.raises(ValueError):
        transforms.load_transform(path, "0")
    empty = transforms.Standardizer(["x"]).fit(df.limit(0))
    assert empty.means["x"] == 0 and empty.deviations["x"] == 1
    assert transforms.FunctionTransform(lambda d: d.limit(1)).apply(df).count() == 1 and isinstance(transforms.compose(), transforms.Passthrough)


def test_filters(spark):
    df = spark.createDataFrame([(0, 3, 10, 5), (1, 3, 10, 0), (None, None, 1, 1)], "trade_side int, trade_sz bigint, ask_sz_0 bigint, bid_sz_0 bigint")
    assert [r[0] for r in df.select(filters.trade_size(0.2)).collect()] == [True, False, False]
    assert df.where(filters.any_of([])).count() == 3 and df.where(filters.is_value("trade_sz", [])).count() == 0
    far = spark.createDataFrame([(UNDEF, -5), (105, 100)], "ask_px_0 bigint, bid_px_0 bigint")
    assert [r[0] for r in far.select(filters.tight_spread(5)).collect()] == [False, True]
    with pytest.raises(ValueError):
        filters.tight_spread(-1)
    with pytest.raises(ValueError):
        filters.intraday_time("9", "10")
    with pytest.raises(ValueError):
        filters.intraday_time("09:00", "10:00", closed="half")
    t = spark.createDataFrame([(dt.datetime(2024, 7, 1, 13, 30),), (dt.datetime(2024, 1, 2, 14, 30),)], "ts_event timestamp")
    assert t.where(filters.intraday_time("09:30", "09:31", timezone="America/New_York")).count() == 2


def test_relational(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 2, "b")], "k int, row_nr bigint, v string")
    assert sorted(map(str, relational.dedup_last(df, ["k"]).collect())) == sorted(map(str, df.where("row_nr > 0").collect()))
    a = spark.createDataFrame([(1, 0, 5), (3, 1, 7)], "t int, row_nr bigint, x int")
    b = spark.createDataFrame([(2, 0, 8)], "t int, row_nr bigint, x int")
    out = relational.join_products({"p": a, "q": b}, ["t"]).orderBy("t").collect()
    assert [(r.t, r.p_x, r.q_x) for r in out] == [(1, 5, None), (2, 5, 8), (3, 7, 8)]
    assert relational.existing(df, ["v", "zz"]) == ["v"] and relational.with_group_max(df, ["k"], "row_nr", "m").where("m = 1").count() == 2


def test_views(spark):
    df = spark.range(100).select(F.lit(1).alias("publisher_id"), F.lit(1).alias("instrument_id"), F.col("id").alias("row_nr"), (F.col("id") / 10).cast("int").alias("v"))
    assert [r.row_nr for r in sampling.uniform(df, 5).orderBy("row_nr").collect()] == [0, 24, 49, 74, 99]
    assert sampling.uniform(df.limit(3), 5).count() == 3 and [r.row_nr for r in sampling.uniform(df, 1).collect()] == [0]
    assert [r.row_nr for r in sampling.level_changes(df, "v").orderBy("row_nr").collect()] == [*range(0, 100, 10), 99]
    taken = lambda n: [r.row_nr for r in sampling.level_changes(df, "v", n).orderBy("row_nr").collect()]
    every = [*range(0, 100, 10), 99]
    for n in range(1, 13):
        rest, edges = every[1:], np.linspace(0, 10, max(n - 1, 1) + 1, dtype=int)
        assert taken(n) == (every if n >= 11 else [99] if n == 1 else [0, *(rest[b - 1] for b in edges[1:])])
    assert [r.over for n in (99, 100) for r in sampling.over_budget(df, n).collect()] == [True, False]
    assert sampling.sample_smallest(df, 7, 1).collect() == sampling.sample_smallest(df.repartition(5), 7, 1).collect()
    ranks = {r.v: r.rank for r in reports.ranked(df, "v").collect()}
    assert ranks[0] == 5.5 and ranks[9] == 95.5
    assert sampling.relative_ns(df, "row_nr").agg(F.max("x_ns")).first()[0] == 99


def test_quality(spark):
    df = spark.createDataFrame([(1, 0, 5, 160, "R"), (1, 1, 3, 8, "A"), (1, 2, None, 4, "A"), (1, 3, 9, 128, "A")], "f int, row_nr bigint, ts_ns bigint, flags int, action string")
    r = quality.regressions(df, ["ts_ns"], ["f"]).first()
    assert (r.ts_ns_regressions, r.ts_ns_jumps) == (1, 0)
    c = quality.flag_counts(df, ["f"]).first()
    assert (c.n_last, c.n_snapshot, c.n_snapshot_reset, c.n_snapshot_last, c.n_bad_ts, c.n_maybe_bad) == (2, 1, 1, 1, 1, 1)
    b = quality.bounds(df, ["f"]).first()
    assert (b.n, b["first"], b["last"], b.min, b.max, b.n_unique) == (4, 5, 9, 3, 9, 4)
    found = quality.issues(quality.regressions(df, ["ts_ns"], ["f"]), [("error", "time", F.col("ts_ns_regressions") > 0), ("warning", "none", F.col("ts_ns_jumps") > 5)], ["f"])
    assert [(x.severity, x.rule) for x in found.collect()] == [("error", "time")] and quality.exit_code(found) == 1 and quality.exit_code(found.limit(0), True) == 0


def test_dated_files(spark, tmp_path):
    names = ["ABM6_20240102_normal_ab_full_day.parquet", "ABM6_20240103_high_stress_ab_full_day.parquet"]
    for n in names:
        spark.range(5).coalesce(1).write.parquet(str(tmp_path / n))
    assert dated.resolve(dated.list_files(spark, str(tmp_path)), "20240103", "AB") == (names[1], "high_stress")
    with pytest.raises(FileNotFoundError):
        dated.resolve(names, "20240104", "AB")
    df = dated.scan(spark, [str(tmp_path / n) for n in names], ["id", "zz"])
    assert df.columns == ["id", "date", "nature", "row_nr"] and sorted({(r.date, r.nature) for r in df.collect()}) == [("20240102", "normal"), ("20240103", "stress")]
    assert df.where("row_nr <> id").count() == 0 and dated.nature_of("Odd") == "Odd"
    assert dated.frame_source(spark, df, ["2024-01-03"]).count() == 5
    assert dated.expand_dates("20240105-20240109", holidays=["20240108"]) == ["20240105", "20240109"] and dated.expand_dates("20240108-20240109", end_date=False) == ["20240108"] and dated.expand_dates("20240108", end_date=False) == []
    days = dated.session_days(spark, "2024-01-05", "2024-01-09", spark.createDataFrame([(dt.date(2024, 1, 8),)], "date date"))
    assert sorted(str(r.date) for r in days.collect()) == ["2024-01-05", "2024-01-09"]
    parts = ["x_20240102_normal_gap_before.parquet", "x_20240102_normal_window.parquet"]
    assert dated.plan_segments(parts) == {("x", "20240102", "normal"): {"gap_before": parts[0], "window": parts[1]}}
    for i, p in enumerate(parts):
        spark.range(i * 5, i * 5 + 5).coalesce(1).write.parquet(str(tmp_path / p))
    dated.write_full_day(spark, [str(tmp_path / p) for p in parts], str(tmp_path / "day.parquet"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "day.parquet")).orderBy("id").collect()] == list(range(10))
    m = dated.file_manifest(spark, [str(tmp_path / names[0])])
    assert m.count() == 1 and len(dated.combined_hash(m)) == 64
    assert dated.infer_features(spark.createDataFrame([(1, 2, 3)], "bid_px_0 int, f int, y int"), "y") == ["f"]


def test_registry(tmp_path):
    r = registry.Registry(str(tmp_path / "r.jsonl"))
    a, b, c = r.register("f", "x", {"k": 1}), r.register("f", "x", {"k": 2}), r.register("f", "x", {"k": 1})
    assert (a["version"], b["version"], c["version"]) == (1, 2, 1) and registry.versioned_name(r.get("f", "x")) == "x_v2" and registry.reference(a)["version"] == 1
    again = registry.Registry(str(tmp_path / "r.jsonl"))
    assert [x["version"] for x in again.versions("f", "x")] == [1, 2] and again.get("f", "x", 1) == a and not again.versions("g", "x")
    for bad in (("f", "x", 3), ("f", "x", 0), ("f", "y", None)):
        with pytest.raises(KeyError):
            again.get(*bad)
    with ThreadPoolExecutor(8) as pool:  # two writers never give a version twice
        made = list(pool.map(lambda i: registry.Registry(again.path).register("f", "many", {"k": i % 5}), range(40)))
    assert sorted({(m["version"], m["payload"]["k"]) for m in made}) == sorted((m["version"], m["payload"]["k"]) for m in again.versions("f", "many")) and len(again.versions("f", "many")) == 5
    t = registry.JsonTracker(str(tmp_path / "t.jsonl"))
    t.log(1, score=2.0)
    t.close()
    assert json.loads((tmp_path / "t.jsonl").read_text())["score"] == 2.0


def test_deciles_against_a_loop(spark):
    rng = np.random.default_rng(2)
    p = [float(v) for v in rng.integers(-20, 20, 300)] + [math.nan, math.nan]
    rows = [(i, v, None if i % 17 == 0 else float(i % 7 - 3)) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "row_nr bigint, p double, y double").repartition(5)
    key = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)
    rank = {key(v): np.mean([i + 1 for i, u in enumerate(sorted(map(key, p))) if u == key(v)]) for v in p}
    assert {(key(r.p), r["rank"]) for r in reports.ranked(df, "p").collect()} == set(rank.items())
    want = {}
    for _, v, y in rows:
        b = want.setdefault(min(max(int((rank[key(v)] - 1) * 10 // len(p)), 0), 9), [0, []])
        b[0] += 1
        b[1] += [] if y is None else [y]
    got = {r.decile: r for r in reports.decile_report(df, "p", "y").collect()}
    assert {k: r.n for k, r in got.items()} == {k: b[0] for k, b in want.items()}
    assert all(math.isclose(got[k].mean_return, np.mean(b[1]), abs_tol=1e-9) for k, b in want.items())
    assert reports.decile_report(df.limit(0), "p", "y").count() == 0
