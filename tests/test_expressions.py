"""Expressions and features written as JSON and read back."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from depthforge.operators.ordering import by_row
from depthforge.plans import features as P
from depthforge.plans.expressions import Tree, call, col, same, tree
from depthforge.plans.loader import FeatureLoader
from depthforge.sources.views import quotes

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_standard_set_from_json(spark):
    """All features of the standard set, the same rows from their text."""
    static, nodes = P.standard_set(["1h", "2h"])
    text = P.to_json(static, nodes)
    again, read = P.from_json(text)
    assert P.to_json(again, read) == text and list(again) == list(static)
    q = quotes(spark, SF)
    made = lambda s, n: P.add_features(q, n).select("row_nr", *(c(by_row()).alias(k) for k, c in s.items()), *(x.name for x in n))
    assert rows(made(again, read)) == rows(made(static, nodes))
    loaded = FeatureLoader(static=again, stateful=read)(q)
    assert set(loaded.columns) >= {*again, *(n.name for n in read)} and loaded.count() == q.count()


def test_shared_nodes_stay_shared(spark):
    """Children of one name are one node again, so sums are still computed once."""
    nodes = [P.flow_return("f", "1h", timedelta(hours=10)), P.trade_correlation("c", "1h", "volume"), P.trade_momentum("m", 60.0, combine="sum")]
    read = P.from_json(P.to_json({}, nodes))[1]
    P.check(read)
    assert read[1].children[0].children[0] is read[1].children[1].children[0]
    plan = lambda n: P.add_features(quotes(spark, SF), n)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert plan(read) == plan(nodes) and rows(P.add_features(quotes(spark, SF), read)) == rows(P.add_features(quotes(spark, SF), nodes))


def test_operators(spark):
    a, b = col("a"), col("b")
    cases = [
        (a + 1, 3.0), (2 - a, 0.0), (a * b - b, 4.0), (1 / a, 0.5), (-a / b, -0.5), (call("if", (a > 1) & ~(b < 3) | call("eq", a, 9), a, b), 2.0), (call("greatest", a, b, 3), 4.0), (call("least", a, b), 2.0),
        (call("coalesce", call("if", a > 5, a), 7.0), 7.0), (call("sqrt", b), 2.0), (call("abs", -b), 4.0), (call("lag", b), None), (call("log1p", a - 2), 0.0), (call("sign", -a), -1.0), (call("eq", a, 2), True),
        (call("is_null", call("lag", a)), True), (a / 0, float("inf")), (a >= 2, True), (b <= 2, False), (call("ne", a, b), True), (call("balance", a, b, False, 0.0), -1 / 3), (call("log", a - a), float("-inf")),
    ]
    df = spark.createDataFrame([(2.0, 4.0, 1)], "a double, b double, n int")
    w = by_row(["n"], "n")
    got = df.select(*(Tree.from_json(t.to_json())(w).alias(f"c{i}") for i, (t, _) in enumerate(cases))).head()
    for i, (t, want) in enumerate(cases):
        assert got[i] == want or abs(got[i] - want) < 1e-12, t.to_json()
        assert same(Tree.from_json(t.to_json()), t)
    assert (a + b * a).columns() == ["a", "b"] and tree(3).to_config() == ["lit", 3]


def test_what_cannot_be_read(spark):
    for bad in ('["nothing", 1]', '"a"', "[]", "[3]", '{"col": "a"}'):
        with pytest.raises(ValueError):
            Tree.from_json(bad)
    own = P.Node("mine", lambda w: F.col("bid_sz_0") * 2)
    with pytest.raises(ValueError, match="function"):
        P.from_config(own.to_config())
    config = P.ewma_spread("s", "1h").to_config()
    with pytest.raises(ValueError):
        P.from_config(config | {"kind": "Other"})
    with pytest.raises(ValueError, match="twice"):
        P.from_json(json.dumps({"version": 1, "static": {}, "features": [config, config | {"half_life": "2h"}]}))
    with pytest.raises(ValueError):
        P.from_json('{"version": 2}')


def test_a_users_feature(spark):
    """A node of one's own, from its JSON: the mean size of buys, as a share of the top."""
    size = P.Ewma("size", call("if", call("eq", col("trade_side"), 0), col("trade_sz")), half_life="1h", normalized=True)
    mine = P.Node("mine", col("size") / col("ask_sz_0"), (size,))
    read = P.from_config(json.loads(json.dumps(mine.to_config())))
    by_function = P.Node("mine", lambda w: P.X.fdiv(F.col("size"), F.col("ask_sz_0")), (P.Ewma("size", lambda w: F.when(F.col("trade_side") == 0, F.col("trade_sz")), half_life="1h", normalized=True),))
    q = quotes(spark, SF)
    assert rows(P.add_features(q, [read]).select("row_nr", "mine")) == rows(P.add_features(q, [by_function]).select("row_nr", "mine"))
