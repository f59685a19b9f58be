"""Decayed sums by ranges of a key against the fold of the whole key."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthforge.operators.kernels import Decay, decayed, decayed_by_ranges
from depthforge.sources.views import quotes

SF = "/root/testdata/sf0.001"
SPECS = [Decay("a", "x", 10**9), Decay("b", "x", 10**10, True), Decay("c", "z", 3 * 10**8), Decay("d", "z", 10**11, True)]


def rows(n=400, seed=0):
    """Ties, times that run backwards, nulls, a key of one row, a null key, far gaps."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = i * 10**8 - (5 * 10**8 if i % 37 == 0 else 0) - (i % 3 == 1) * 10**8 + (10**15 if i >= 300 else 0)
        x = None if rng.random() < 0.3 or 40 <= i < 75 else float(rng.normal())
        out.append((["u", "v", None][int(rng.integers(3))] if i else "once", i, int(t), x, float(rng.normal()), "m"))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, n bigint, t bigint, x double, z double, _range string").repartition(3)


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        for a, b in zip(got[k], w, strict=True):
            assert (a is None) == (b is None) and (b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or (a != a and b != b)), (k, got[k], w)


def values(df):
    return {r.n: (r.a, r.b, r.c, r.d) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_ranges(spark, width):
    df = frame(spark, rows())
    want = values(decayed(df, SPECS, ["k"], "n", "t"))
    got = decayed(df, SPECS, ["k"], "n", "t", width=width)
    assert got.columns == [*df.columns, "a", "b", "c", "d"]
    same(values(got), want)


def test_batches_and_no_key(spark):
    """Ranges longer than a batch, one series without a key."""
    df, name = frame(spark, rows(300, 1)), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        want = values(decayed(df, SPECS, [], "n", "t"))
        spark.conf.set(name, "9")
        same(values(decayed(df, SPECS, [], "n", "t", width=64)), want)
    finally:
        spark.conf.set(name, before)


def test_values_that_are_no_numbers(spark):
    """A NaN stays from its row on, in later ranges too; infinities stay infinite."""
    data = [("u", i, i * 10**8, float("nan") if i == 13 else 1.0, float("inf") if i == 5 else 1.0, "m") for i in range(40)]
    df = frame(spark, data)
    got = values(decayed_by_ranges(df, SPECS, 4, ["k"], "n", "t"))
    assert all(got[i][0] == got[i][0] for i in range(13)) and all(got[i][0] != got[i][0] and got[i][1] != got[i][1] for i in range(13, 40))
    assert all(got[i][2] == float("inf") for i in range(5, 40))


def test_edges(spark):
    df = frame(spark, [])
    assert decayed_by_ranges(df, SPECS, 5, ["k"], "n", "t").count() == 0
    with pytest.raises(ValueError):
        decayed_by_ranges(df, SPECS, 0, ["k"], "n", "t")
    null = frame(spark, [("u", None, 5, 1.0, 1.0, "m"), ("u", 1, 6, 2.0, 2.0, "m")])
    assert values(decayed_by_ranges(null, SPECS, 5, ["k"], "n", "t"))[None][0] == 1.0


def test_one_key_takes_many_tasks(spark):
    """Rows of one instrument are folded in as many tasks as there are ranges for."""
    df = quotes(spark, SF).where("instrument_id = 1").select("publisher_id", "instrument_id", "row_nr", "ts_ns", F.col("trade_sz").cast("double").alias("x"))
    one, many = (decayed(df, [Decay("a", "x", 3600 * 10**9)], width=w) for w in (None, 20))
    same({r.row_nr: (r.a,) for r in many.collect()}, {r.row_nr: (r.a,) for r in one.collect()})
    used = lambda d: d.select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert used(one) == 1 and used(many) == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
