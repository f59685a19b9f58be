"""Users' scores, the book in SQL, checks of a depth table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthforge.operators import scores, user_scores, validation
from depthforge.operators.book import build_depth
from depthforge.operators.book_sql_function import register
from depthforge.operators.user_scores import UserScore
from depthforge.queries import _user_rmse
from depthforge.sources.views import mbo

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", None][i % 3], i % 2, float(rng.normal()), float(rng.normal()) if i % 7 else None) for i in range(500)]
    return spark.createDataFrame(rows, "k string, state int, y double, p double").repartition(5)


def largest() -> UserScore:
    """The largest error and the rows without a prediction."""
    none = float("-inf")
    return UserScore(
        "worst", ["y", "p"], lambda: {"top": none, "none": 0.0}, lambda s, y, p: {"top": max(s["top"], float(np.nanmax(np.abs(y - p), initial=none))), "none": s["none"] + int(np.isnan(p).sum())},
        lambda a, b: {"top": max(a["top"], b["top"]), "none": a["none"] + b["none"]}, lambda s: s["top"] + 1000 * s["none"],
    )


def test_user_score_is_the_built_in_one(spark, df, monkeypatch):
    known = df.dropna(subset=["p"])
    want = sorted(map(tuple, scores.evaluate(known, [scores.rmse("y", "p")], ["k", "state"]).collect()), key=str)
    for groups in (10_000, 1):  # states handed on early
        monkeypatch.setattr(user_scores, "GROUPS", groups)
        renamed = known.withColumnRenamed("state", "s")
        got = sorted(map(tuple, user_scores.evaluate(renamed, _user_rmse(), ["k", "s"]).collect()), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert abs(user_scores.evaluate(known, _user_rmse()).head()[0] - scores.evaluate(known, [scores.rmse("y", "p")]).head()[0]) < 1e-12


def test_user_score_states_merge_over_parts_and_batches(spark, df):
    rows = df.collect()
    want = {k: max(abs(r.y - r.p) for r in rows if r.k == k and r.p is not None) + 1000 * sum(r.p is None for r in rows if r.k == k) for k in ("a", "b", None)}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "11")
    try:
        halves = [user_scores.state(df.where(F.col("state") == i).drop("state"), largest(), ["k"]) for i in (0, 1)]
        both = user_scores.merge(halves[0].unionByName(halves[1]), largest(), ["k"])
        assert {r.k: r.worst for r in user_scores.values(both, largest(), ["k"]).collect()} == want
    finally:
        spark.conf.set(name, before)
    empty = df.where("false").drop("state")
    assert user_scores.evaluate(empty, largest(), ["k"]).count() == 0 and user_scores.evaluate(empty, _user_rmse()).head()[0] == 0.0


def test_book_in_sql(spark):
    register(spark, "depth_of")
    mbo(spark, SF).createOrReplaceTempView("their_events")
    for levels in (1, 3):
        got = spark.sql(f"SELECT * FROM depth_of(TABLE(SELECT *, 'x' AS more FROM their_events), {levels})")
        want = build_depth(mbo(spark, SF), levels)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT bid_px_0 FROM depth_of(TABLE(SELECT * FROM their_events WHERE false), 1)").count() == 0
    for bad in ("depth_of(TABLE(their_events), 0)", "depth_of(TABLE(SELECT price FROM their_events), 1)", "depth_of(1, 1)"):
        with pytest.raises(Exception, match="one level|no such columns|table"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_a_right_book_has_no_issues(spark):
    events = mbo(spark, SF)
    depth = build_depth(events, 2)
    at = depth.withColumn("_at", F.col("row_nr"))
    assert validation.validate(at, events, 2, order="_at", rows=100, blocks=20).count() == 0


def test_planted_faults(spark):
    events = mbo(spark, SF)
    depth = build_depth(events, 2)
    rows = depth.orderBy("instrument_id", "row_nr").collect()
    traded = [r for r in rows if r.trade_sz and r.trade_vwap]
    a, b, c, d = traded[3], next(r for r in rows if r.trade_sz is None), rows[40], traded[20]
    cut = depth.where(F.col("row_nr") != b.row_nr).withColumn("trade_sz", F.when(F.col("row_nr") == a.row_nr, F.col("trade_sz") + 5).otherwise(F.col("trade_sz")))
    cut = cut.withColumn("trade_vwap", F.when(F.col("row_nr") == d.row_nr, F.col("trade_vwap") * 1.001).otherwise(F.col("trade_vwap")))
    more = depth.where(F.col("row_nr") == c.row_nr).withColumn("row_nr", F.lit(10**6).cast("bigint"))
    twice = depth.where(F.col("row_nr") == traded[10].row_nr)
    faulty = cut.unionByName(more).unionByName(twice)
    found = {(r.issue, r.row_nr) for r in validation.validate(faulty, events, 2, rows=100, blocks=20).collect()}
    assert found >= {("missing_row", b.row_nr), ("different_row", a.row_nr), ("different_row", d.row_nr), ("unexpected_row", 10**6), ("repeated_row", traded[10].row_nr), ("traded_size", None), ("traded_value", None)}
    assert len(found) == 7
    details = {r.row_nr: r.detail for r in validation.compare(faulty, depth, 2).collect()}
    assert details[a.row_nr] == "trade_sz" and details[d.row_nr] == "trade_vwap"
    some = validation.compare(validation.sampled(faulty, 5), validation.sampled(depth, 5), 2).count()
    assert some < 5 and validation.sampled(depth, 5).count() < depth.count() / 2
    back = depth.withColumn("_at", F.when(F.col("row_nr") == c.row_nr, F.lit(-1)).otherwise(F.col("row_nr")))
    assert [r.issue for r in validation.disorder(back).collect()] == ["row_order"]
