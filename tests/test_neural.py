"""The network against finite differences and against the same training in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthforge.operators import neural

N = 400


def data(seed=0, n=N):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 3.0, 1.0]
    return x, np.sin(x[:, 0]) + 0.3 * x[:, 1] + 0.05 * rng.normal(size=n)


def frame(spark, x, y, w=None, parts=3):
    w = np.ones(len(y)) if w is None else w
    rows = [(i, *map(float, a), float(b), float(c), "p") for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "row_nr bigint, a double, b double, c double, y double, w double, part string").repartition(parts)


@pytest.mark.parametrize("activation", ["relu", "tanh"])
@pytest.mark.parametrize("quantiles", [None, [0.1, 0.5, 0.8]])
def test_gradients_are_finite_differences(activation, quantiles):
    rng = np.random.default_rng(1)
    layers = neural.Layers([3, 5, 4, len(quantiles) if quantiles else 1], activation)
    flat, (x, y), w = layers.draw(rng) + 0.05 * rng.normal(size=layers.count), data(2, 40), rng.random(40)
    _, g = layers.gradient(flat, x, y, w, quantiles)
    for i in rng.choice(layers.count, 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (layers.gradient(up, x, y, w, quantiles)[0] - layers.gradient(down, x, y, w, quantiles)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-4 * max(1.0, abs(slope))


def by_hand(x, y, parts, epochs, steps, seed, rate):
    """One part after another in numpy, with Adam written out."""
    mean, scale = x.mean(0), x.std(0)
    layers = neural.Layers([3, 6, 1], "tanh")
    rng = np.random.default_rng(seed)
    flat = layers.draw(rng)
    m = v = np.zeros(layers.count)
    t = 0
    for _ in range(epochs):
        for p in rng.permutation(steps):
            own = parts == p
            hidden, out = layers.split(flat)
            z = np.tanh((x[own] - mean) / scale @ hidden[0] + hidden[1])
            e = (z @ out[0] + out[1])[:, 0] - y[own]
            back = (2 * e[:, None] @ out[0].T) * (1 - z * z)
            g = np.concatenate([((x[own] - mean) / scale).T.dot(back).ravel(), back.sum(0), (2 * z.T @ e), [2 * e.sum()]]) / own.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return flat


def test_training_is_what_numpy_does_however_rows_are_dealt_out(spark):
    x, y = data()
    how = {"hidden": (6,), "activation": "tanh", "epochs": 3, "steps": 4, "seed": 7, "learning_rate": 0.05}
    df = frame(spark, x, y)
    parts = np.array([r.p for r in df.orderBy("row_nr").select(F.pmod(F.xxhash64("row_nr", F.lit(7)), F.lit(4)).alias("p")).collect()])
    want = by_hand(x, y, parts, 3, 4, 7, 0.05)
    for n in (1, 5):
        got = neural.fit(frame(spark, x, y, parts=n), ["a", "b", "c"], "y", **how)
        assert np.allclose(got.weights[0], want, rtol=1e-8, atol=1e-10) and len(got.weights) == 1
    assert not np.allclose(neural.fit(df, ["a", "b", "c"], "y", **(how | {"seed": 8})).weights[0], want)


def test_losses_fall_and_snapshots(spark):
    x, y = data(3, 900)
    train, valid = frame(spark, x[:600], y[:600]), frame(spark, x[600:], y[600:])
    how = {"hidden": (8,), "epochs": 8, "steps": 3, "learning_rate": 0.05, "seed": 1, "valid": valid}
    best = neural.fit(train, ["a", "b", "c"], "y", **how)
    told = [h["valid"] for h in best.history]
    assert min(told) < 0.3 * told[0] and len(told) == 8 and "train" in best.history[0]
    mse = lambda m: m.predict(valid).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).head()[0]
    assert abs(mse(best) - min(told)) < 1e-9
    last = neural.fit(train, ["a", "b", "c"], "y", keep="last", **how)
    assert abs(mse(last) - told[-1]) < 1e-9
    some = neural.fit(train, ["a", "b", "c"], "y", keep="ensemble", kept=3, **how)
    assert len(some.weights) == 3 and np.array_equal(some.weights[0], best.weights[0]) and mse(some) < told[0]
    back = neural.Network.from_json(some.to_json())
    assert sorted(back.predict(valid, "p").collect()) == sorted(some.predict(valid, "p").collect())
    stopped = neural.fit(train, ["a", "b", "c"], "y", patience=1, least_gain=1e9, **how)
    assert len(stopped.history) == 2


def test_quantiles(spark):
    x, y = data(4, 600)
    df = frame(spark, x, y)
    model = neural.fit(df, ["a", "b", "c"], "y", quantiles=[0.1, 0.9], hidden=(8,), epochs=12, steps=3, learning_rate=0.08)
    out = model.predict(df, ["lo", "hi"]).agg(F.avg((F.col("y") < F.col("lo")).cast("int")), F.avg((F.col("y") < F.col("hi")).cast("int"))).head()
    assert out[0] < 0.3 and out[1] > 0.7
    with pytest.raises(ValueError):
        model.predict(df, ["lo"])


def test_weights_missing_values_and_errors(spark):
    x, y = data(5, 120)
    how = {"hidden": (4,), "epochs": 1, "steps": 1}
    df = frame(spark, x, y)
    bad = spark.createDataFrame([(900, None, 0.0, 0.0, 1.0, 1.0, "p"), (901, 0.0, float("nan"), 0.0, 1.0, 1.0, "p"), (902, 0.0, 0.0, 0.0, None, 1.0, "p"), (903, 0.0, 0.0, 0.0, 1.0, float("inf"), "p")], df.schema)
    plain = neural.fit(df, ["a", "b", "c"], "y", "w", **how)
    assert np.allclose(neural.fit(df.unionByName(bad), ["a", "b", "c"], "y", "w", **how).weights[0], plain.weights[0])
    assert np.allclose(neural.fit(frame(spark, x, y, np.full(120, 3.0)), ["a", "b", "c"], "y", "w", **how).weights[0], plain.weights[0])
    assert [r.prediction is None for r in plain.predict(bad).orderBy("row_nr").collect()] == [True, True, False, False]
    constant = neural.fit(df.withColumn("b", F.lit(2.0)), ["a", "b", "c"], "y", **how)
    assert np.isfinite(constant.weights[0]).all()
    with pytest.raises(ValueError):
        neural.fit(df.where("false"), ["a"], "y", **how)
    with pytest.raises(ValueError):
        neural.fit(df, ["a"], "y", keep="first", **how)
    with pytest.raises(ValueError):
        neural.Layers([3, 0, 1])
    with pytest.raises(Exception, match="negative"):
        neural.fit(frame(spark, x, y, -np.ones(120)), ["a"], "y", "w", **how)
