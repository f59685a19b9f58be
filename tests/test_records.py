"""Binary records as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from depthforge.sources.records import records_to_parquet, register
from depthforge.sources.views import mbo

SF = "/root/testdata/sf0.001"
SCHEMA = "a bigint, b int, c smallint, d tinyint, e double, f float, g boolean, s string, t string"
ROWS = [(2**63 - 1, -5, 3, -1, 1.5, 0.25, True, "x", "é"), (None,) * 9, (-(2**63), 2**31 - 1, None, 0, float("nan"), None, False, "", "0123456789abcdef"), (0, 0, 0, 0, 0.0, 0.0, None, None, "a")]


@pytest.fixture(autouse=True)
def known(spark):
    register(spark)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_events_come_back(spark, tmp_path):
    events = mbo(spark, SF).repartition(3)
    path = str(tmp_path / "events")
    events.write.format("records").option("width", 1).mode("append").save(path)
    assert len([n for n in os.listdir(path) if n.endswith(".rec")]) == 3 and not [n for n in os.listdir(path) if n.endswith(".tmp")]
    back = spark.read.format("records").option("rows", 100).load(path)
    assert back.schema.simpleString() == events.schema.simpleString() and same(back, events) and back.rdd.getNumPartitions() >= 10
    some = spark.read.format("records").option("columns", "price, side").load(path)
    assert some.columns == ["price", "side"] and same(some, events.select("price", "side"))
    assert same(back.where("price > 1000000000000 and size <= 3 and side = 'B'"), events.where("price > 1000000000000 and size <= 3 and side = 'B'"))
    events.limit(5).write.format("records").mode("overwrite").save(path)
    assert spark.read.format("records").load(path).count() == 5


def test_nulls_bounds_and_kinds(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "r")
    df.coalesce(1).write.format("records").mode("append").save(path)
    back = spark.read.format("records").load(path)
    assert back.schema.simpleString() == df.schema.simpleString() and same(back, df)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("records").option("filters", "true").load(path)
        for test in ("a > -1", "e >= 0", "b = 0 and s is null", "c < 3 and d <= 0", "t = 'a'", "a = -9223372036854775808"):
            assert same(pushed.where(test), df.where(test))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert back.where("a > -1").count() == 2 and back.where("e >= 0").count() == df.where("e >= 0").count() and back.where("b = 0 and s is null").count() == 1
    df.coalesce(1).write.format("records").mode("append").save(path)
    assert spark.read.format("records").load(path).count() == 8


def test_parquet_of_records(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).repartition(2).write.format("records").mode("append").save(source)
    assert len(records_to_parquet(spark, source, out)) == 2 and records_to_parquet(spark, source, out) == [] and len(records_to_parquet(spark, source, out, overwrite=True)) == 2
    assert spark.read.parquet(f"{out}/*.parquet").agg(F.sum("id")).head()[0] == 190


def test_errors(spark, tmp_path):
    path = str(tmp_path / "e")
    with pytest.raises(Exception, match="more than 2 bytes"):
        spark.createDataFrame([("abc",)], "s string").write.format("records").option("width.s", 2).mode("append").save(path)
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="no fixed-width field"):
        spark.createDataFrame([([1],)], "s array<int>").write.format("records").mode("append").save(path)
    with pytest.raises(Exception, match="pass a schema"):
        spark.read.format("records").load(str(tmp_path / "none"))
    assert spark.read.format("records").schema("a int").load(str(tmp_path / "none")).count() == 0
    spark.range(3).coalesce(1).write.format("records").mode("append").save(path)
    with pytest.raises(Exception, match="no such fields"):
        spark.read.format("records").option("columns", "id,other").load(path)
    name = next(n for n in os.listdir(path) if n.endswith(".rec"))
    with open(f"{path}/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="within a record"):
        spark.read.format("records").load(path).count()
    with open(f"{path}/{name}", "wb") as f:
        f.write(b"something else")
    with pytest.raises(Exception, match="not a file of records"):
        spark.read.format("records").load(path)
