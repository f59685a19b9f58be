import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthforge.functions import exprs as X
from depthforge.functions.durations import half_life_ns, horizon_ns
from depthforge.operators import asof
from depthforge.operators.kernels import Decay, State, decayed, scan
from depthforge.plans import features as P

S = 10**9


def loop(x, t, half_life, normalized):
    rate, y, last, out = math.log(2) / half_life, None, None, []
    for v, at in zip(x, t, strict=True):
        if normalized and v is None:
            out.append(y)
            continue
        d = 0.0 if last is None else rate * max(at - last, 0)
        if normalized:
            y = v if y is None else y + (1 - math.exp(-d)) * (v - y)
        else:
            y = (y or 0.0) * math.exp(-d) + (v or 0.0)
        last = at
        out.append(y)
    return out


@pytest.mark.parametrize("normalized", [False, True])
@pytest.mark.parametrize("half_life", [S // 10, 5 * S, 3000 * S])
def test_kernel_equals_the_loop_however_it_is_cut(normalized, half_life):
    rng = random.Random(5)
    t, x, at = [], [], 0
    for _ in range(500):
        at += rng.choice([0, S, 3 * S, 1000 * S, -S])
        t.append(at)
        x.append(None if rng.random() < 0.3 else rng.gauss(0, 10))
    want = loop(x, t, half_life, normalized)
    for cut in (0, 1, 250, 499):
        state, got = State(Decay("y", "x", half_life, normalized)), []
        for a, b in ((0, cut), (cut, 500)):
            if a < b:
                null = np.array([v is None for v in x[a:b]])
                y, void = state.run(np.array([v or 0.0 for v in x[a:b]]), null, np.array(t[a:b]))
                got += [None if m else v for v, m in zip(y, void, strict=True)]
        for g, w in zip(got, want, strict=True):
            assert (g is None) == (w is None) and (w is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9))


def test_scan_of_nan_stays_nan():
    out = scan(np.array([1.0, np.nan, 1.0]), np.zeros(3), 0.0)
    assert out[0] == 1 and np.isnan(out[1:]).all()


def test_kernel_over_keys_and_partitions(spark):
    rows = [(k, i, i * S, float(i % 5) if i % 3 else None) for k in range(5) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, row_nr bigint, ts_ns bigint, x double")
    specs = [Decay("a", "x", 7 * S), Decay("b", "x", 7 * S, True)]
    for parts in (1, 9):
        got = decayed(df.repartition(parts), specs, ["k"]).orderBy("k", "row_nr").collect()
        want = [loop([r[3] for r in rows[:200]], [r[2] for r in rows[:200]], 7 * S, n) for n in (False, True)]
        for r in got:
            assert math.isclose(r.a, want[0][r.row_nr], abs_tol=1e-12)
            assert r.b == want[1][r.row_nr] or math.isclose(r.b, want[1][r.row_nr], abs_tol=1e-12)
    assert decayed(df.limit(0), specs, ["k"]).count() == 0


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(50), rng.choice([None, 1.0, 2.0, 3.0])) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "instrument_id int, row_nr bigint, ts_ns bigint, p double").withColumn("publisher_id", F.lit(1))
    got = {(r.instrument_id, r.row_nr): r.v for r in df.withColumn("v", asof.asof_backward(F.col("p"), 10)).collect()}
    for k, i, t, _ in rows:
        own = [r for r in rows if r[0] == k]
        want = None
        if t + 10 <= max(r[2] for r in own):
            want = max((r for r in own if r[2] <= t + 10), key=lambda r: (r[2], r[1]))[3]
        assert got[k, i] == want
    right = df.select("instrument_id", "ts_ns", "row_nr", F.col("p").alias("q"))
    joined = asof.asof_join(df.select("instrument_id", "ts_ns", "row_nr"), right, ["instrument_id"], "ts_ns", "ts_ns", ["q"])
    for r in joined.collect():
        assert r.q == max((x for x in rows if x[0] == r.instrument_id and x[2] <= r.ts_ns), key=lambda x: (x[2], x[1]))[3]


def test_horizons(spark):
    df = spark.createDataFrame([(1, 1, i, i * S, 100.0 + i) for i in range(5)], "publisher_id int, instrument_id int, row_nr bigint, ts_ns bigint, p double")
    out = asof.add_return(df, F.col("p"), ["1s", "2s"], [1.0, 1.0]).orderBy("row_nr").collect()
    assert [None if r.return_bps is None else round(r.return_bps, 6) for r in out] == [round((101.5 / 100 - 1) * 1e4, 6), round((102.5 / 101 - 1) * 1e4, 6), round((103.5 / 102 - 1) * 1e4, 6), None, None]
    assert asof.add_return(df, F.col("p"), []).columns == df.columns
    with pytest.raises(ValueError):
        asof.add_return(df, F.col("p"), ["1s"], [1.0, 2.0])
    with pytest.raises(ValueError):
        asof.add_future_price(df, F.col("p"), ["1s", "2s"], [1.0, -1.0])


def test_durations():
    assert half_life_ns("1h30m") == 5400 * S and half_life_ns(".5s") == S // 2 and half_life_ns(2) == 2 * S and horizon_ns("100ms") == 10**8
    for bad in ("", "5", "s", "1x", "0s"):
        with pytest.raises(ValueError):
            half_life_ns(bad)
    for bad in (".5s", "3i"):
        with pytest.raises(ValueError):
            horizon_ns(bad)


def test_ieee_helpers(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (6.0, 3.0), (float("nan"), 0.0)], "a double, b double")
    got = [r.v for r in rows.select(X.fdiv(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 2 and math.isnan(got[5])
    got = [r.v for r in spark.createDataFrame([(0.0,), (-1.0,), (math.e,), (None,)], "a double").select(X.flog(F.col("a")).alias("v")).collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and math.isclose(got[2], 1) and got[3] is None


def quote(n, spark, **fixed):
    rows = [dict(publisher_id=1, instrument_id=1, row_nr=i, ts_ns=i * S, trade_side=None, trade_sz=None, bid_px_0=100 + i % 2, bid_sz_0=5 + i % 3, ask_px_0=103, ask_sz_0=4, **fixed) for i in range(n)]
    return spark.createDataFrame(rows, "publisher_id int, instrument_id int, row_nr bigint, ts_ns bigint, trade_side int, trade_sz bigint, bid_px_0 bigint, bid_sz_0 bigint, ask_px_0 bigint, ask_sz_0 bigint")


def test_feature_nodes(spark):
    df = quote(20, spark)
    with pytest.raises(ValueError):
        P.check([P.log_return("a", "1s"), P.ewma_spread("a", "1s")])
    for bad in (lambda: P.momentum("a", "1s", "other"), lambda: P.momentum("a", "1s", combine="x"), lambda: P.trade_correlation("a", "1s", "x"), lambda: P.flow_return("a", "1s", "5s"), lambda: P.flow_return("a", "1s", "10s", "x")):
        with pytest.raises(ValueError):
            bad()
    nodes = [P.push_momentum("p1", "5s"), P.pull_momentum("p2", "5s"), P.trade_momentum("p3", "5s"), P.trade_correlation("c", "5s", "volume"), P.flow_return("f", "1s", "10s"), P.ewma_var("v", "5s"), P.ewma_spread("s", "5s")]
    out = P.add_features(df, nodes)
    assert set(out.columns) == {*df.columns, "p1", "p2", "p3", "c", "f", "v", "s"}
    rows = out.orderBy("row_nr").collect()
    assert rows[0].p1 == 0 and rows[-1].p1 > 0 and all(r.c is None for r in rows) and all(r.p3 == 0 for r in rows)
    halves = P.add_features(df.repartition(3), nodes).orderBy("row_nr").collect()
    assert [r.v for r in halves] == [r.v for r in rows]
    assert nodes[0].to_config()["children"]


def test_folds_share_equal_sums(spark):
    plan = P.add_features(quote(3, spark), [P.push_momentum("a", "5s"), P.push_momentum("b", "5s", log=True)])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and "__b_buy" not in text.split("MapInArrow")[1].split("\n")[0]


def test_labels_of_one_key_in_many_tasks(spark):
    """A key's labels are made in more than one task, and are those of one window over it: gaps, ties, nulls, times before 1970."""
    g = np.random.default_rng(4)
    rows = [(k, None if g.random() < 0.01 else int(t), n, None if g.random() < 0.1 else float(g.random())) for k in (1, 2, None) for n, t in enumerate([*g.integers(-900, 1500, 700), *g.integers(4000, 4300, 200), *([77] * 20)])]
    df = spark.createDataFrame(rows, "instrument_id int, ts_ns long, row_nr long, p double").withColumn("publisher_id", F.lit(1))
    at = {"1s": 100, "3s": 300}
    want = df.withColumn("v", sum(asof.asof_backward(F.col("p"), h) * w for h, w in zip(at.values(), (2.0, 1.0), strict=True)) / 3.0)
    slow = df.withColumn("ts_ns", F.col("ts_ns") * 10**7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = asof.add_future_price(slow.where("instrument_id = 1"), F.col("p"), list(at), [2.0, 1.0], "v")
        assert one.select(F.spark_partition_id().alias("x")).distinct().count() > 1
        got = asof.add_future_price(slow, F.col("p"), list(at), [2.0, 1.0], "v")
        assert got.columns == [*df.columns, "v"]
        said = lambda d: {(r.instrument_id, r.row_nr): r.v for r in d.collect()}
        assert said(got) == said(want) and got.count() == df.count() and sum(v is not None for v in said(got).values()) > 500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_horizons_in_many_tasks(spark):
    """Returns over several horizons, one of no weight, are those of one window a key; further columns and their order stay."""
    df = spark.range(400).select(F.lit(1).alias("publisher_id"), (F.col("id") % 2).cast("int").alias("instrument_id"), F.col("id").alias("row_nr"), (F.col("id") * F.col("id") * 10**8).alias("ts_ns"), (1.0 + F.col("id") % 7).alias("p"), F.lit("x").alias("note"))
    got = asof.add_return(df, F.col("p"), ["10s", "60s", "1d"], [2.0, 1.0, 0.0], "v")
    assert got.columns == [*df.columns, "v"]
    mean = (asof.asof_backward(F.col("p"), 10 * 10**9) * 2 + asof.asof_backward(F.col("p"), 60 * 10**9) * 1) / 3.0
    want = {r.row_nr: r.v for r in df.withColumn("v", (mean / F.col("p") - 1.0) * 1e4).collect()}
    assert {r.row_nr: r.v for r in got.collect()} == want and sum(v is not None for v in want.values()) > 300
