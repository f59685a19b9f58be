import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from depthforge.operators import reports
from depthforge.queries import ORACLES, QUERIES
from depthforge.sources.views import quotes

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in result.fetchall()]
    if name == "trade_corr_side":  # a ratio of differences near zero: compared with a tolerance
        flat = lambda rows: sorted((r[0], -9.0 if r[1] is None else r[1]) for r in rows)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 2e-3 for a, b in zip(flat(got), flat(want), strict=True))
        return
    plain = lambda rows: sorted(tuple("" if v is None else f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert plain(got) == plain(want)


def test_static_features_before_the_shuffle(spark):
    """The standard set's static features don't take their levels through the fold, where a book's rows are in one task."""
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = QUERIES["standard_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    shuffled = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    made = plan[plan.index(shuffled) :]
    fold = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "AS imbalance_3_lin" in made and "bid_px_2" not in fold and "ask_sz_2" not in fold


def tasks_of_books(spark, rows) -> list[int]:
    """In how many tasks each book's ``rows`` (row_nr, task) are."""
    books = {r.row_nr: r.instrument_id for r in quotes(spark, SF).select("row_nr", "instrument_id").collect()}
    return [len({r.task for r in rows if books[r.row_nr] == b}) for b in set(books.values())]


def test_decile_labels_of_a_book_in_many_tasks(spark, monkeypatch):
    """The labels that the decile report gets are made in more than one task a book."""
    taken, report = [], reports.decile_report
    monkeypatch.setattr(reports, "decile_report", lambda df, *a: taken.append(df) or report(df, *a))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        entry.flagship(spark, SF)
        assert min(tasks_of_books(spark, taken[0].select("row_nr", F.spark_partition_id().alias("task")).collect())) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_weighted_labels_of_a_book_in_many_tasks(spark):
    """Labels of several horizons are made in more than one task a book, and every row has its label once."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = QUERIES["weighted_multi_horizon_return"](spark, SF).select("row_nr", "value", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert min(tasks_of_books(spark, rows)) > 1 and sorted(r.row_nr for r in rows) == list(range(1000))
