import math
import time

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.operators.asof import add_future_price
from depthforge.operators.book import build_depth
from depthforge.operators.kernels import Decay, decayed
from depthforge.sources.views import mbo, quotes
from depthforge.streaming.event_time import stream_decayed_in_order, stream_future_price, stream_in_order
from depthforge.streaming.states import stream_decayed, stream_depth

SF = "/root/testdata/sf0.001"


def run(spark, df, tmp_path, name, build):
    """Write ``df`` as three files in row order and stream them one by one."""
    for i in range(3):
        df.where((F.col("row_nr") % 1000 >= i * 334) & (F.col("row_nr") % 1000 < (i + 1) * 334)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_decays(spark, tmp_path):
    df = quotes(spark, SF).where("row_nr < 1000").select("publisher_id", "instrument_id", "row_nr", "ts_ns", F.col("trade_sz").cast("double").alias("x"))
    specs = [Decay("a", "x", 3600 * 10**9), Decay("b", "x", 3600 * 10**9, True)]
    got = {r.row_nr: (r.a, r.b) for r in run(spark, df, tmp_path, "decays", lambda s: stream_decayed(s, specs, ["publisher_id", "instrument_id"])).collect()}
    want = {r.row_nr: (r.a, r.b) for r in decayed(df, specs).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all((a is None) == (b is None) and (b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)) for a, b in zip(got[k], w, strict=True))


def test_depth(spark, tmp_path):
    df = mbo(spark, SF).where("row_nr < 1000")
    last = df.groupBy("instrument_id").agg(F.max(F.when(F.col("flags") == 128, F.col("row_nr"))).alias("end"))
    got = run(spark, df, tmp_path, "depth", lambda s: stream_depth(s, 2))
    want = build_depth(df, 2).join(last, "instrument_id").where("row_nr <= end").drop("end").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


HOUR = 3600 * 10**9


def stream_files(spark, df, tmp_path, arrival, n, build):
    """Write ``df`` as ``n`` files by the column ``arrival`` and stream them one by one; returns the rows, each with its micro-batch."""
    for i in range(n):
        df.where(F.col(arrival) == i).drop(arrival).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.drop(arrival).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    q = build(source).writeStream.foreachBatch(lambda b, k: got.extend((k, r) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return got


def prices(spark, rows=1000):
    df = quotes(spark, SF).where(F.col("row_nr") < rows)
    return df.select("publisher_id", "instrument_id", "row_nr", "ts_ns", F.when(F.col("row_nr") % 11 != 0, F.col("bid_sz_0").cast("double")).alias("price"))


def batch_labels(df, delay):
    """The batch form's labels of the rows that a stream has closed."""
    end = F.max("ts_ns").over(W.partitionBy("instrument_id"))
    labelled = add_future_price(df, F.col("price"), ["1h", "6h"], [2.0, 1.0]).withColumn("end", end)
    return {r.row_nr: r.future_price for r in labelled.where(F.col("ts_ns") + 6 * HOUR + delay <= F.col("end")).collect()}


def test_labels_of_shuffled_rows(spark, tmp_path):
    """Rows mixed over micro-batches, within the delay: the batch form's labels, each row once, none late."""
    df = prices(spark)
    mixed = df.withColumn("arrival", F.floor((F.col("row_nr") + F.pmod(F.xxhash64("row_nr"), F.lit(12))) / 240).cast("int"))
    got = stream_files(spark, mixed, tmp_path, "arrival", 5, lambda s: stream_future_price(s, "price", ["1h", "6h"], [2.0, 1.0], delay="24h"))
    assert not any(r.late or r.n_late for _, r in got) and len({r.row_nr for _, r in got}) == len(got)
    assert len({k for k, _ in got}) >= 4
    want = batch_labels(df, 24 * HOUR)
    assert {r.row_nr: r.future_price for _, r in got} == want and len(want) > 500
    # what waits is no older than the delay and the horizon, and any reader can open it
    state = spark.read.format("statestore").load(str(tmp_path / "ck")).select("value.*").collect()
    held = 0
    for s in state:
        s = s.groupState if "groupState" in s else s
        rows = pa.ipc.open_stream(bytes(s.rows)).read_all()
        held += rows.num_rows
        assert all(t > s.latest - 30 * HOUR for t in rows["ts_ns"].to_pylist())
    assert held == 1000 - len(got)


def test_late_rows(spark, tmp_path):
    """Rows later than the delay come out marked and counted, and no label is theirs."""
    df = prices(spark)
    late = (F.col("row_nr") % 50 == 7) & (F.col("row_nr") < 300)
    sent = df.withColumn("arrival", F.when(late, 3).otherwise(F.floor(F.col("row_nr") / 334)).cast("int"))
    got = stream_files(spark, sent, tmp_path, "arrival", 4, lambda s: stream_future_price(s, "price", ["1h", "6h"], [2.0, 1.0], delay="1h"))
    marked = [r for _, r in got if r.late]
    assert sorted(r.row_nr for r in marked) == [r.row_nr for r in df.where(late).orderBy("row_nr").collect()]
    assert all(r.future_price is None for r in marked) and sum({r.instrument_id: r.n_late for r in marked}.values()) == len(marked)
    assert {r.row_nr: r.future_price for _, r in got if not r.late} == batch_labels(df.where(~late), HOUR)


def test_rows_in_order(spark, tmp_path):
    """Each key's rows come in the order of time, over the micro-batches too; equal times by row; a null time is late."""
    df = prices(spark).withColumn("ts_ns", F.when(F.col("row_nr") != 500, F.floor(F.col("ts_ns") / HOUR).cast("bigint") * HOUR))
    mixed = df.withColumn("arrival", F.floor((F.col("row_nr") + F.pmod(F.xxhash64("row_nr"), F.lit(12))) / 240).cast("int"))
    got = stream_files(spark, mixed, tmp_path, "arrival", 5, lambda s: stream_in_order(s, "24h"))
    assert [r.row_nr for _, r in got if r.late] == [500]
    for i in range(4):
        spots = [(r.ts_ns, r.row_nr) for _, r in got if r.instrument_id == i and not r.late]
        assert spots == sorted(spots) and len(spots) > 150


def test_decays_of_shuffled_rows(spark, tmp_path):
    """Sums of mixed rows are those of the rows in order; a late row enters none."""
    df = prices(spark).withColumnRenamed("price", "x")
    sent = df.withColumn("arrival", F.when(F.col("row_nr") == 100, 4).otherwise(F.floor((F.col("row_nr") + F.pmod(F.xxhash64("row_nr"), F.lit(12))) / 240)).cast("int"))
    specs = [Decay("a", "x", 6 * HOUR), Decay("b", "x", 6 * HOUR, True)]
    got = stream_files(spark, sent, tmp_path, "arrival", 5, lambda s: stream_decayed_in_order(s, specs, "24h"))
    want = {r.row_nr: (r.a, r.b) for r in decayed(df.where("row_nr <> 100"), specs).collect()}
    assert [(r.row_nr, r.a, r.n_late) for _, r in got if r.late] == [(100, None, 1)]
    rest = {r.row_nr: (r.a, r.b) for _, r in got if not r.late}
    assert len(rest) > 800 and set(rest) <= set(want)
    for k, pair in rest.items():
        assert all((g is None) == (w is None) and (w is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-12)) for g, w in zip(pair, want[k], strict=True))


def test_idle_keys_are_closed(spark, tmp_path):
    """A key that stops is flushed: labels beyond its end are null, and it leaves no state."""
    df = prices(spark, 40).withColumn("arrival", F.lit(0))
    for i in range(3):
        (df if i == 0 else df.where("false")).drop("arrival").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.drop("arrival").schema).parquet(str(tmp_path / "in"))
    got = []
    q = stream_future_price(source, "price", "1h", idle_ms=1).writeStream.foreachBatch(lambda b, k: got.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    try:
        deadline = time.time() + 90
        while len(got) < 40 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        q.stop()
    want = {r.row_nr: r.future_price for r in add_future_price(df, F.col("price"), "1h").collect()}
    assert {r.row_nr: r.future_price for r in got} == want and len(got) == 40


def test_clashing_names(spark):
    source = spark.readStream.format("rate").load().selectExpr("1 as publisher_id", "1 as instrument_id", "value as row_nr", "value as ts_ns", "1.0D as price", "true as late")
    with pytest.raises(ValueError):
        stream_future_price(source, "price", "1h")
