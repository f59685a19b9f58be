"""Boosted quantile trees against a plain growth in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthforge.operators import boosting, scores

N = 600


def data(seed=0, n=N):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = (2 * x[:, 0] + np.abs(x[:, 1]) * rng.normal(size=n)).round(3)
    x[rng.random((n, 3)) < 0.05] = np.nan
    return x, y


def frame(spark, x, y, w=None, parts=3):
    w = np.ones(len(y)) if w is None else w
    rows = [(*(None if np.isnan(v) and i % 2 else float(v) for v in a), float(b), float(c), "m", i) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "x0 double, x1 double, x2 double, y double, w double, k string, p0 int").repartition(parts)


def rank(v, q):
    return np.sort(v)[max(int(np.ceil(q * len(v))), 1) - 1]


def grow(x, y, edges, q, rounds, depth, rate, penalty):
    """Predictions of each round by recursion over rows."""
    bins = np.column_stack([np.where(np.isnan(c), 0, np.searchsorted(e, c, "right")) for c, e in zip(x.T, edges, strict=True)])
    p = np.full(len(y), rank(y, q))
    for _ in range(rounds):
        leaf = np.zeros(len(y))

        def split(rows, level):
            g = np.where(p >= y, 1 - q, -q)
            score = lambda r: g[r].sum() ** 2 / (len(r) + penalty)
            best = None
            if level < depth:
                for f in range(x.shape[1]):
                    for cut in range(1, len(edges[f]) + 1):
                        left, right = rows[bins[rows, f] < cut], rows[bins[rows, f] >= cut]
                        if len(left) and len(right):
                            gain = round(0.5 * (score(left) + score(right) - score(rows)), 9)
                            if gain > 1e-6 and (best is None or gain > best[0]):
                                best = gain, left, right
            if best:
                split(best[1], level + 1)
                split(best[2], level + 1)
            else:
                leaf[rows] = rank((y - p)[rows], q)

        split(np.arange(len(y)), 0)
        p = p + rate * leaf
    return p


def test_against_recursion(spark):
    """Three rounds of depth three, missing values in; the compiled form, the form of the tasks and the form read back agree."""
    x, y = data()
    edges = [np.quantile(c[~np.isnan(c)], np.arange(1, 8) / 8).round(3) for c in x.T]
    df = frame(spark, x, y)
    model = boosting.fit(df, ["x0", "x1", "x2"], "y", [0.2, 0.5], rounds=3, depth=3, learning_rate=0.5, penalty=2.0, edges=edges)
    want = np.column_stack([grow(x, y, edges, q, 3, 3, 0.5, 2.0) for q in (0.2, 0.5)])
    for made in (model.predict(df, ["a", "b"]), model.predict(df, ["a", "b"], compiled=0), boosting.BoostedQuantiles.from_json(model.to_json()).predict(df, ["a", "b"])):
        got = {r.p0: (r.a, r.b) for r in made.collect()}
        assert np.allclose([got[i] for i in range(N)], want, rtol=0, atol=1e-9)


def test_dealt_out_otherwise(spark, monkeypatch):
    """The same trees from other partitions, and with the rows written after each round."""
    x, y = data(1)
    fit = lambda parts: boosting.fit(frame(spark, x, y, parts=parts), ["x0", "x1", "x2"], "y", [0.3], rounds=3, depth=2, bins=16, row_share=0.7, feature_share=0.6, seed=4).to_json()
    one = fit(1)
    monkeypatch.setattr(boosting, "STORE", 1)
    assert fit(4) == one


def test_loss_falls_and_growing_stops(spark):
    x, y = data(2, 900)
    train, valid = frame(spark, x[:600], y[:600]), frame(spark, x[600:], y[600:])
    quantiles = [0.1, 0.5, 0.9]
    model = boosting.fit(train, ["x0", "x1", "x2"], "y", quantiles, valid=valid, rounds=12, depth=2, learning_rate=0.4, bins=16, patience=2)
    assert model.history[5] < 0.7 * model.history[0] and len(model.rounds) == int(np.argmin(model.history)) and len(model.history) <= 13
    out = model.predict(valid, ["a", "b", "c"])
    loss = scores.evaluate(out, [scores.pinball("y", ["a", "b", "c"], quantiles)]).head()[0]
    assert abs(loss - min(model.history)) < 1e-9
    inside = out.agg(F.avg((F.col("y") <= F.col("c")).cast("int")), F.avg((F.col("y") <= F.col("a")).cast("int"))).head()
    assert inside[0] > 0.75 and inside[1] < 0.25

    class Enough(Exception):
        pass

    def stop(r, loss):
        if r == 1:
            raise Enough

    with pytest.raises(Enough):
        boosting.fit(train, ["x0"], "y", [0.5], valid=valid, rounds=5, depth=1, stop=stop)


def test_weights(spark):
    """Equal weights do what none do, whatever they are; rows without weight, target or number are left out."""
    x, y = data(3, 300)
    edges = [[-1.0, 0.0, 1.0]] * 3
    fit = lambda df, weight, scale=1.0: boosting.fit(df, ["x0", "x1", "x2"], "y", [0.3, 0.8], weight, rounds=2, depth=2, edges=edges, penalty=scale, least_weight=scale)
    plain = frame(spark, x, y)
    bad = spark.createDataFrame([(0.0, 0.0, 0.0, None, 1.0, "m", 1), (0.0, 0.0, 0.0, float("nan"), 1.0, "m", 1), *((9.0, 9.0, 9.0, 9.0, w, "m", 1) for w in (-1.0, 0.0, None, float("nan"), float("inf")))], plain.schema)
    want = fit(plain, None).to_json()
    assert fit(plain.unionByName(bad), "w").to_json() == want
    assert fit(frame(spark, x, y, np.full(300, 4.0)), "w", 4.0).to_json() == want
    # weight where the target is high draws the quantiles up
    drawn = fit(frame(spark, x, y, np.where(y > 0, 9.0, 1.0)), "w")
    mean = lambda m: plain.transform(lambda d: m.predict(d, ["a", "b"])).agg(F.avg("a"), F.avg("b")).head()
    assert all(a > b for a, b in zip(mean(drawn), mean(fit(plain, None)), strict=True))


def test_edges(spark):
    x, y = data(4, 50)
    df = frame(spark, x, y)
    flat = boosting.fit(df, [], "y", [0.5], rounds=1, depth=1)
    assert flat.predict(df, ["p"]).select("p").distinct().count() == 1
    same = boosting.fit(df.withColumn("y", F.lit(1.0)), ["x0"], "y", [0.5], rounds=2, depth=2)
    assert {r.p for r in same.predict(df, ["p"]).collect()} == {1.0}
    with pytest.raises(ValueError):
        boosting.fit(df.where("false"), ["x0"], "y", [0.5])
    with pytest.raises(ValueError):
        boosting.fit(df, ["x0"], "y", [1.5])
    with pytest.raises(ValueError):
        flat.predict(df, ["a", "b"])
