import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from depthforge import cli
from depthforge.functions.bounds import between, to_utc
from depthforge.operators.filters import depth_price_filter, depth_prices
from depthforge.plans import view
from depthforge.queries import QUERIES
from depthforge.sources.views import mbo, quotes

SF = "/root/testdata/sf0.001"


def test_bounds(spark):
    assert to_utc("20240701", "America/New_York") == dt.datetime(2024, 7, 1, 4, tzinfo=dt.UTC) and to_utc(None) is None
    assert to_utc(dt.date(2024, 1, 1), end=True).time() == dt.time.max and to_utc("2024-01-01T05:00:00+05:00").hour == 0
    with pytest.raises(ValueError):
        between(F.col("t"), "2024-01-02", "2024-01-01")
    with pytest.raises(TypeError):
        to_utc(5)
    df = spark.createDataFrame([(dt.datetime(2024, 1, d, 12),) for d in (1, 2, 3)], "t timestamp")
    assert df.where(between(F.col("t"), "20240102", "2024-01-02")).count() == 1 and df.where(between(F.col("t"))).count() == 3


def test_frames(spark):
    q = quotes(spark, SF)
    v = view.View([view.book_panel(q, 2), view.Panel([view.Layer(q, [view.Series("size", "bid_sz_0"), view.Series("both", F.col("bid_sz_0") + F.col("ask_sz_0"))]), view.Layer(q, [view.Series("trades", "trade_sz", "event")], [F.col("trade_sz").isNotNull()])])], points=50, timezone="Europe/Berlin")
    frames = v.frames()
    assert [len(p) for p in frames] == [4, 2] and frames[1][0].count() == 50 and v.cut == ["trades"]
    assert all(f.count() <= 51 for p in frames for f in p)
    with pytest.raises(ValueError):
        view.Series("x", "y", "pie")


def test_event_traces(spark):
    out = view.event_traces(mbo(spark, SF), ["A", "T"], ["B"])
    assert {r.trace for r in out.select("trace").distinct().collect()} == {"add bid", "trade bid"}


def test_depth_price_modes(spark):
    q, m = quotes(spark, SF).where("row_nr < 5"), mbo(spark, SF)
    seen = {r.price for r in depth_prices(q, 2).collect()}
    assert {r.price for r in depth_price_filter(m, q, 2).collect()} <= seen
    assert depth_price_filter(m, q, 2, "range").where(~F.col("price").between(min(seen), max(seen))).count() == 0
    assert depth_price_filter(m, q, 2, None).count() == m.count()
    with pytest.raises(ValueError):
        depth_price_filter(m, q, 2, "other")


def test_depth_price_queries_use_all_quotes(spark, tmp_path):
    d = str(tmp_path)
    spark.read.parquet(f"{SF}/events.parquet").where("event_id >= 500").write.parquet(f"{d}/events.parquet")
    seen = {r[f"{s}_px_{i}"] for r in quotes(spark, d).collect() for s in ("bid", "ask") for i in range(2) if r[f"{s}_sz_{i}"] > 0}
    events = {(r.row_nr, r.price) for r in mbo(spark, d).collect()}
    assert {tuple(r) for r in QUERIES["depth_price_semi_join"](spark, d).collect()} == {e for e in events if e[1] in seen} != set()
    assert {tuple(r) for r in QUERIES["depth_price_range"](spark, d).collect()} == {e for e in events if min(seen) <= e[1] <= max(seen)} != set()


def test_cli(spark, tmp_path, capsys):
    mbo(spark, SF).coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    cli.main([str(tmp_path / "in.parquet"), "--levels", "2", "--out", str(tmp_path / "out.parquet")])
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "false")
    stats = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert stats["rows"] == 1000 and stats["emitted"] == spark.read.parquet(str(tmp_path / "out.parquet")).count()
