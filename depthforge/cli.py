"""``python -m depthforge.cli INPUT --levels N --out OUT``: event parquet to depth parquet, counters as JSON on stderr.

``--input-ipc`` reads the events as an Arrow stream from stdin instead; ``--format ipc`` writes the depth rows as an Arrow
stream, to OUT or to stdout.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from depthforge.operators.book import STATS, book_stats, build_depth, write_depth
from depthforge.operators.ordering import ts_ns, with_row_nr
from depthforge.sources.dated import arrow_batches
from depthforge.sources.shared import shared_path


def stored_stream(spark: SparkSession, stream) -> str:
    """The batches of an Arrow stream as they come, in one parquet file; no more than a batch is in memory."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = shared_path(spark, "events").removeprefix("file:") + ".parquet"  # a mounted folder
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with pa.ipc.open_stream(stream) as batches, pq.ParquetWriter(path, batches.schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return path


def write_stream(depth: DataFrame, sink) -> None:
    """The rows as an Arrow stream, book by book in order, one task's at a time."""
    import pyarrow as pa

    kind = to_arrow_schema(depth.schema)
    with pa.ipc.new_stream(sink, kind) as out:
        for batch in arrow_batches(depth.orderBy("publisher_id", "instrument_id", "row_nr")):
            out.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=kind))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("input", nargs="?")
    p.add_argument("--levels", type=int, default=5)
    p.add_argument("--out")
    p.add_argument("--format", choices=("parquet", "ipc"), default="parquet")
    p.add_argument("--input-ipc", action="store_true")
    a = p.parse_args(argv)
    if bool(a.input) == a.input_ipc:
        p.error("either a path or --input-ipc")
    if a.format == "parquet" and not a.out:
        p.error("parquet goes to --out")
    spark = SparkSession.builder.config("spark.sql.legacy.parquet.nanosAsLong", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    events = spark.read.parquet(stored_stream(spark, sys.stdin.buffer) if a.input_ipc else a.input)
    events = events if "row_nr" in events.columns else with_row_nr(events)
    if "ts_ns" not in events.columns:
        stamp = F.col("ts_event")
        events = events.withColumn("ts_ns", stamp if dict(events.dtypes)["ts_event"] == "bigint" else ts_ns(stamp))
    depth = build_depth(events, a.levels)
    if a.format == "parquet":
        write_depth(depth, a.out)
    else:
        with open(a.out, "wb") if a.out else nullcontext(sys.stdout.buffer) as sink:
            write_stream(depth, sink)
    totals = book_stats(events, a.levels).agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS)).first()
    print(json.dumps(totals.asDict()), file=sys.stderr)


if __name__ == "__main__":
    main()
