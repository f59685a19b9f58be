"""A depth-like and an event-like view of the ``events`` table, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthforge.functions.exprs import UNDEF
from depthforge.operators.ordering import ts_ns

_BASE = "(1000000000000 + ((event_id * 7919) % 41 - 20) * 250000000)"
_EMPTY = ("event_id % 53 = 0", "event_id % 12 = 0", "event_id % 13 = 0")


def _quote_columns() -> list[str]:
    out = []
    for i, empty in enumerate(_EMPTY):
        bid, ask = f"{_BASE} - {i * 250000000}", f"{_BASE} + (1 + event_id % 2 + {i}) * 250000000"
        for side, price, k in (("bid", bid, 13 + 2 * i), ("ask", ask, 17 + 2 * i)):
            out.append(f"CASE WHEN {empty} THEN {UNDEF} ELSE {price} END AS {side}_px_{i}")
            out.append(f"CASE WHEN {empty} THEN 0 ELSE 1 + (event_id * {k}) % 50 END AS {side}_sz_{i}")
    return out


_QUOTES = [
    "event_id AS row_nr", "1 AS publisher_id", "user_id % 4 AS instrument_id",
    "CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'click' THEN 1 END AS trade_side",
    "CASE WHEN event_type IN ('purchase', 'click') THEN 1 + event_id % 9 END AS trade_sz",
    *_quote_columns(),
]
_MBO = [
    "event_id AS row_nr", "event_id AS sequence", "1 AS publisher_id", "user_id % 4 AS instrument_id",
    "CASE WHEN event_id % 2500 = 0 THEN 'R' WHEN event_type = 'signup' THEN 'A' WHEN event_type = 'view' THEN 'M' WHEN event_type = 'click' THEN 'C' WHEN event_type = 'purchase' THEN 'T' ELSE 'F' END AS action",
    "CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side", f"{_BASE} AS price", "event_id % 10 AS size",
    "1 + (event_id * 31) % 200 AS order_id", "CASE WHEN event_id % 3 = 2 THEN 128 ELSE 0 END AS flags",
]

#: The same in DuckDB, as common table expressions.
QUOTES_SQL = f"quotes AS (SELECT {', '.join(_QUOTES)}, epoch_us(ts) * 1000 AS ts_ns, ts AS ts_event FROM events)"
MBO_SQL = f"mbo AS (SELECT {', '.join(_MBO)}, epoch_us(ts) * 1000 AS ts_ns FROM events)"


def quotes_of(events: DataFrame) -> DataFrame:
    return events.select(*(F.expr(c) for c in _QUOTES), ts_ns(F.col("ts")).alias("ts_ns"), F.col("ts").alias("ts_event"))


def mbo_of(events: DataFrame) -> DataFrame:
    return events.select(*(F.expr(c) for c in _MBO), ts_ns(F.col("ts")).alias("ts_ns"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def mbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbo_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
