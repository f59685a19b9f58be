"""Dated parquet files: names, scans, segments of a day, manifests."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depthforge.functions.exprs import num
from depthforge.operators.filters import any_of
from depthforge.operators.ordering import ORDER, with_row_nr
from depthforge.sources.calendars import closed_days

TEMPLATE = "{prod}M6_{date}_{tag}_{prod_s}_full_day.parquet"
_SEGMENT = re.compile(r"(?P<stem>.+)_(?P<date>\d{8}|\d{4}-\d{2}-\d{2})_(?P<tag>.+?)_(?P<segment>gap_before|window|gap_after)\.parquet")


def nature(tag: Column) -> Column:
    """stress or normal where the tag has that word, else the tag."""
    parts = F.split(F.lower(tag), "_")
    return F.when(F.array_contains(parts, "stress"), "stress").when(F.array_contains(parts, "normal"), "normal").otherwise(tag)


def nature_of(tag: str) -> str:
    parts = tag.lower().split("_")
    return next((n for n in ("stress", "normal") if n in parts), tag)


def expand_dates(dates: str | Sequence[str], holidays: Iterable[str] = (), weekend: bool = False, end_date: bool = True, calendar: str | None = None, iso: bool = False) -> list[str]:
    """Sessions of days and ranges (YYYYMMDD-YYYYMMDD), as YYYYMMDD or ISO dates.

    Weekends, ``holidays`` and those of the named ``calendar`` drop out, and the last day, a single one too, without ``end_date``.
    """
    closed, out = set(holidays), []
    for item in [dates] if isinstance(dates, str) else dates:
        a, _, b = item.partition("-")
        day, last = (dt.datetime.strptime(x, "%Y%m%d").date() for x in (a, b or a))
        if last < day:
            raise ValueError(f"{item} ends before it starts")
        shut = closed_days(calendar, range(day.year, last.year + 1)) if calendar else {}
        while day <= last:
            text = day.strftime("%Y%m%d")
            if (weekend or day.weekday() < 5) and text not in closed and day not in shut and (end_date or day < last):
                out.append(day.isoformat() if iso else text)
            day += dt.timedelta(days=1)
    return list(dict.fromkeys(out))


def session_days(spark: SparkSession, start: str, end: str, calendar: DataFrame) -> DataFrame:
    """(date): days from start to end that aren't in ``calendar`` (date) of closed days."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return days.where(F.dayofweek("date").between(2, 6)).join(calendar, "date", "left_anti")


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """File names in a folder of whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in found)


def resolve(names: Sequence[str], date: str, prod: str, template: str = TEMPLATE) -> tuple[str, str]:
    """(file name, tag) of the one name that fits the template; none or several is an error."""
    slots = {"prod": prod, "prod_s": prod.lower(), "date": date, "d": date, "dnd": date.replace("-", ""), "dslash": f"{date[:4]}/{date[4:6]}/{date[6:]}"}
    pattern = re.escape(template).replace(r"\{tag\}", "(?P<tag>.+)")
    for k, v in slots.items():
        pattern = pattern.replace(rf"\{{{k}\}}", re.escape(v))
    fits = [m for n in names if (m := re.fullmatch(pattern, n))]
    if len(fits) != 1:
        raise FileNotFoundError(f"{len(fits)} files fit {template} for {prod} {date}")
    return fits[0].string, fits[0].groupdict().get("tag", "")


def scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, filters: Iterable[Column] = ()) -> DataFrame:
    """One frame of dated files, with date, tag and nature from their names and row_nr from their order.

    Filters are alternatives.  Columns and filters reach the reader; days are pruned by the paths given.
    """
    df = with_row_nr(spark.read.parquet(*paths))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*_full_day\.parquet)", 1)  # a file, or a folder of parts
    date = F.regexp_extract(name, r"_(\d{8}|\d{4}-\d{2}-\d{2})_", 1)
    tag = F.regexp_extract(name, r"_(?:\d{8}|\d{4}-\d{2}-\d{2})_(.+?)_[^_]+_full_day", 1)
    df = df.withColumn("date", F.regexp_replace(date, "-", "")).withColumn("tag", tag).withColumn("nature", nature(tag))
    filters = list(filters)
    df = df.where(any_of(filters)) if filters else df
    return df.select(*(c for c in columns if c in df.columns), "date", "nature", ORDER) if columns else df


def frame_source(spark: SparkSession, source: DataFrame | str, dates: Sequence[str] | None = None, time: str = "ts_event") -> DataFrame:
    """A frame or parquet path, cut to dates by its date column or else by the day of its time."""
    df = spark.read.parquet(source) if isinstance(source, str) else source
    if dates is None:
        return df
    day = F.regexp_replace(F.col("date").cast("string"), "-", "") if "date" in df.columns else F.date_format(time, "yyyyMMdd")
    return df.where(day.isin(*[d.replace("-", "") for d in dates]))


def ipc_blobs(df: DataFrame) -> DataFrame:
    """(ipc): the rows of ``df`` as Arrow IPC streams, one per batch; what :func:`from_ipc` reads."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    return df.mapInArrow(run, "ipc binary")


def from_ipc(blobs: DataFrame, schema: str) -> DataFrame:
    """The rows of Arrow IPC streams in the binary column ``content`` (as of files) or ``ipc``."""
    import pyarrow as pa

    name = "content" if "content" in blobs.columns else "ipc"

    def run(batches):
        for b in batches:
            for blob in b.column(0):
                yield from pa.ipc.open_stream(blob.as_py())

    return blobs.select(name).mapInArrow(run, schema)


def arrow_batches(df: DataFrame):
    """Arrow batches of ``df`` on the driver, in its order, one task's at a time."""
    import pyarrow as pa

    for row in ipc_blobs(df).toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(row.ipc)


def write_ipc(df: DataFrame, path: str) -> None:
    """Parquet-free export: a table of IPC streams below ``path``, one per Arrow batch."""
    ipc_blobs(df).write.parquet(path)


@dataclass(frozen=True)
class DataSource:
    """What a query reads: loader, target, features, filters (alternatives), transform, weight, further columns."""

    loader: Callable[[Sequence[str]], DataFrame]
    dates: Sequence[str]
    target: str
    features: Sequence[str]
    filters: Sequence[Column] = ()
    transform: object | None = None
    weight: str | None = None
    context: Sequence[str] = ("date", "nature")
    precision: str = "float64"
    options: dict = field(default_factory=dict)

    def frame(self) -> DataFrame:
        df = self.loader(self.dates)
        df = df.where(any_of(self.filters)) if self.filters else df
        df = self.transform.apply(df) if self.transform else df
        kind = {"float64": "double", "float32": "float"}[self.precision]
        cast = [num(F.col(c)).cast(kind).alias(c) for c in dict.fromkeys([*self.features, self.target, *([self.weight] if self.weight else [])])]
        kept = [c for c in dict.fromkeys([*self.context, ORDER]) if c in df.columns and c not in (*self.features, self.target)]
        return df.select(*cast, *kept)

    def with_(self, **changes) -> DataSource:
        return DataSource(**{**self.__dict__, **changes})

    def labels(self) -> DataFrame:
        df = self.frame()
        return df.select(self.target, *(c for c in ("date", "nature") if c in df.columns))

    def count(self) -> int:
        return self.frame().count()

    def batches(self, rows: int = 100_000):
        """(X, y, rest) pieces on the driver, in order: Arrow batches, one task's at a time."""
        import pyarrow as pa

        frame = self.frame()
        held, n = [], 0
        for batch in arrow_batches(frame.orderBy(*[c for c in ("date", ORDER) if c in frame.columns])):
            held.append(batch)
            n += batch.num_rows
            while n >= rows:
                every = pa.Table.from_batches(held)
                yield self._batch(every.slice(0, rows).to_pandas())
                held, n = every.slice(rows).to_batches(), n - rows
        if n:
            yield self._batch(pa.Table.from_batches(held).to_pandas())

    def _batch(self, pdf):
        return pdf[list(self.features)].to_numpy(), pdf[self.target].to_numpy(), pdf.drop(columns=[*self.features, self.target])


# The part of a day that segments name "window", in UTC.
WINDOW = ("13:15:00", "20:05:00")


def day_ranges(day: str, mode: str = "full") -> list[tuple[str, str, str]]:
    """(segment, start, end) of a day, YYYYMMDD or ISO, in UTC, ends excluded: the full day, its window, or the gaps around it."""
    first = dt.datetime.strptime(day.replace("-", ""), "%Y%m%d")
    midnight, after = (f"{d:%Y-%m-%d}T00:00:00Z" for d in (first, first + dt.timedelta(days=1)))
    opens, closes = (f"{first:%Y-%m-%d}T{t}Z" for t in WINDOW)
    ranges = {"full": [("full_day", midnight, after)], "window": [("window", opens, closes)], "gaps": [("gap_before", midnight, opens), ("gap_after", closes, after)]}
    if mode not in ranges:
        raise ValueError(f"mode is one of {sorted(ranges)}")
    return ranges[mode]


def plan_segments(names: Sequence[str], start: str | None = None, end: str | None = None, stems: Sequence[str] | None = None, limit: int | None = None) -> dict[tuple[str, str, str], dict[str, str]]:
    """{(stem, date, tag): {segment: name}} of partial days' files, of dates from start to end and the named stems; the first ``limit`` days by (stem, date, tag)."""
    plain = lambda d: d.replace("-", "") if d else d
    days: dict = {}
    for n in names:
        if m := _SEGMENT.fullmatch(n):
            date = plain(m["date"])
            if (not start or date >= plain(start)) and (not end or date <= plain(end)) and (stems is None or m["stem"] in stems):
                days.setdefault((m["stem"], m["date"], m["tag"]), {})[m["segment"]] = n
    return days if limit is None else {k: days[k] for k in sorted(days)[:limit]}


@dataclass(frozen=True)
class DayPlan:
    """What is done about a day: "write" it, "skip" what is there, or "missing" segments."""

    action: str
    dest: str
    parts: tuple[str, ...]
    missing: tuple[str, ...] = ()


def assemble_days(spark: SparkSession, folder: str, out: str, overwrite: bool = False, dry_run: bool = False, sort_by: Sequence[str] = (), **which) -> list[DayPlan]:
    """Write the full days of the segments in ``folder`` to ``out``, and say what was done; a dry run only says it.

    ``which`` are options of :func:`plan_segments`.  A day needs all three segments; days that are there stay unless
    ``overwrite``.
    """
    there = set(list_files(spark, out)) if _exists(spark, out) else set()
    plans = []
    for (stem, date, tag), found in sorted(plan_segments(list_files(spark, folder), **which).items()):
        name = f"{stem}_{date}_{tag}_full_day.parquet"
        order = ("gap_before", "window", "gap_after")
        missing = tuple(s for s in order if s not in found)
        action = "missing" if missing else "skip" if name in there and not overwrite else "write"
        plans.append(DayPlan(action, f"{out.rstrip('/')}/{name}", tuple(f"{folder.rstrip('/')}/{found[s]}" for s in order if s in found), missing))
        if action == "write" and not dry_run:
            write_full_day(spark, plans[-1].parts, plans[-1].dest, sort_by)
    return plans


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_full_day(spark: SparkSession, parts: Sequence[str], dest: str, sort_by: Sequence[str] = (), compression: str = "zstd") -> None:
    """Segments one after another as one day; Spark's committer makes it whole or not at all."""
    df = None
    for k, p in enumerate(parts):
        one = with_row_nr(spark.read.parquet(p), "_r").withColumn("_part", F.lit(k))
        df = one if df is None else df.unionByName(one)
    order = [*sort_by, "_part", "_r"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).drop("_part", "_r").write.mode("overwrite").option("compression", compression).parquet(dest)


def file_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length, sha256) per file, hashed by the executors; of a folder, its files.

    Files of mounted folders are streamed, a megabyte at a time.  Those of other stores are read as one value each, which
    Spark allows up to 2 GB.
    """
    if not all("://" not in p or p.startswith("file://") for p in paths):
        return spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.sha2("content", 256).alias("sha256"))
    found = [f for p in paths for f in _visible_files(os.path.abspath(p.removeprefix("file:").replace("//", "/")))]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            names, sizes, digests = b.column(0).to_pylist(), [], []
            for name in names:
                digest = hashlib.sha256()
                with open(name, "rb") as f:
                    while chunk := f.read(1 << 20):
                        digest.update(chunk)
                    sizes.append(f.tell())
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([f"file:{n}" for n in names], pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["path", "length", "sha256"])

    rows = spark.createDataFrame([(f,) for f in found], "path string")
    return rows.repartition(max(1, min(len(found), 10_000)), "path").mapInArrow(run, "path string, length bigint, sha256 string")


def _visible_files(path: str) -> list[str]:
    """``path``, or the files in it that readers of a folder see."""
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(at, n) for at, _, names in os.walk(path) for n in names if not n.startswith((".", "_")))


def combined_hash(manifest: DataFrame) -> str:
    rows = manifest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), ","), 256).alias("h"))
    return rows.first().h


def infer_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that aren't keys, trade or level columns, nor the target."""
    fixed = {"ts_event", "ts_recv", "ts_ns", "row_nr", "sequence", "publisher_id", "instrument_id", "symbol", "trade_px", "trade_sz", "trade_side", "date", "nature", "tag", target, *exclude}
    return [c for c in df.columns if c not in fixed and not re.fullmatch(r"(?:bid|ask)_(?:px|sz|ct)_\d+", c)]
