from pyspark.sql import functions as F

from depthforge.functions import exprs as X
from depthforge.operators import sampling
from depthforge.plans import features as P
from depthforge.plans.loader import FeatureLoader
from depthforge.sources.views import mbo, quotes

SF = "/root/testdata/sf0.001"


def test_loader_of_quotes(spark):
    load = FeatureLoader({"imbalance": X.book_imbalance(3)}, [P.trade_momentum("flow", "1h")], ["1h"], price=F.when(X.bbo_valid(), X.mid()), filters=[F.col("trade_side") == 0], keep=["bid_px_0"])
    out = load(quotes(spark, SF))
    assert out.columns == ["publisher_id", "instrument_id", "row_nr", "ts_ns", "bid_px_0", "imbalance", "flow", "return_bps"]
    every = {r.row_nr: r.flow for r in P.add_features(quotes(spark, SF), [P.trade_momentum("flow", "1h")]).collect()}
    rows = out.collect()
    assert 0 < len(rows) < 1000 and all(every[r.row_nr] == r.flow for r in rows)


def test_loader_builds_books_by_day(spark):
    events = mbo(spark, SF).withColumn("date", F.date_format(F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint")), "yyyyMMdd")).withColumn("symbol", F.lit("X"))
    load = FeatureLoader(stateful=[P.ewma_spread("spread", "1h")], horizons=["1h"], executable=(2, 5.0), levels=2, context=["symbol"], partition=["date"])
    out = load(events)
    assert out.columns == ["date", "publisher_id", "instrument_id", "row_nr", "ts_ns", "symbol", "spread", "return_bps"]
    assert out.count() > 0 and out.where("symbol is null").count() == 0


def test_orders(spark):
    assert sorted(sampling.shuffled_dates(["a", "b", "c", "d"], 1)) == ["a", "b", "c", "d"]
    assert sampling.shuffled_dates(["a", "b", "c", "d"], 3, {"c": 9, "a": 5, "b": 1, "d": 0})[0] == "c"
    df = spark.range(40).withColumnRenamed("id", "row_nr")
    got = [r.row_nr for r in sampling.shuffled_rows(df, 10, 5).collect()]
    assert got == [r.row_nr for r in sampling.shuffled_rows(df.repartition(3), 10, 5).collect()] and got != list(range(40))
    assert all(sorted(got[i : i + 10]) == list(range(i, i + 10)) for i in range(0, 40, 10))
