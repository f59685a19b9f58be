"""Files of fixed-width binary records as a data source: ``spark.read.format("records").load(folder)``.

A file begins with eight bytes that name the format, the length of its header, and the header: names, kinds and widths of
the fields as JSON.  Records follow, each a number of 64 bits that says which fields aren't null, then the fields, packed.  As
every record has the same width, a file is cut into partitions of ``rows`` records without reading it; a partition is mapped into memory
and handed on in Arrow batches.  ``columns`` (names, comma-separated) are the only ones touched: a Python source isn't told
which columns a query needs.  With the option ``filters``, and ``spark.sql.python.filterPushdown.enabled`` in the session, comparisons
of a column with a number drop records before they become rows.

Fields are long, integer, short, byte, double, float and boolean numbers and strings of at most ``width`` bytes (16; for a column
``width.NAME``); longer strings and other types are an error.  Folders are mounted ones, as records are read by Python.  Writing puts a
file per task beside the others and renames all of them when the last is whole.  A folder without files has no rows if it is read
with a schema, and else no schema, which is an error.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

MAGIC, SUFFIX = b"DEPTHREC", ".rec"
#: Records of a partition, and of a batch.
ROWS, BATCH = 1_000_000, 65_536
WIDTH = 16
KINDS = {LongType: "<i8", IntegerType: "<i4", ShortType: "<i2", ByteType: "i1", DoubleType: "<f8", FloatType: "<f4", BooleanType: "?"}
TYPES = {code: kind for kind, code in KINDS.items()}
COMPARISONS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass(frozen=True)
class Layout:
    """Names and numpy codes of the fields; strings are bytes of a width."""

    fields: tuple[tuple[str, str], ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([("_set", "<u8"), *((f"f{i}", code) for i, (_, code) in enumerate(self.fields))])

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType() if c.startswith("S") else TYPES[c]()) for n, c in self.fields])

    def header(self) -> bytes:
        body = json.dumps(self.fields).encode()
        return MAGIC + struct.pack("<I", len(body)) + body

    @staticmethod
    def of(schema: StructType, options: dict) -> Layout:
        if len(schema.fields) > 64:
            raise ValueError("a record has 64 fields at most")
        out = []
        for f in schema.fields:
            if isinstance(f.dataType, StringType):
                out.append((f.name, f"S{int(options.get(f'width.{f.name}', options.get('width', WIDTH)))}"))
            elif type(f.dataType) in KINDS:
                out.append((f.name, KINDS[type(f.dataType)]))
            else:
                raise ValueError(f"{f.name}: no fixed-width field for {f.dataType.simpleString()}")
        return Layout(tuple(out))

    @staticmethod
    def read(path: str) -> tuple[Layout, int]:
        """The layout of a file, and where its records begin."""
        with open(path, "rb") as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{path}: not a file of records")
            (n,) = struct.unpack("<I", f.read(4))
            return Layout(tuple((name, code) for name, code in json.loads(f.read(n)))), len(MAGIC) + 4 + n


def files(path: str) -> list[str]:
    path = path.removeprefix("file:")
    return [path] if os.path.isfile(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(SUFFIX)) if os.path.isdir(path) else []


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    count: int


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.rows, self.names = options["path"], int(options.get("rows", ROWS)), [f.name for f in schema.fields]
        self.wanted: list[tuple[str, str, object]] = []

    def partitions(self):
        out = []
        for path in files(self.path):
            layout, at = Layout.read(path)
            n, rest = divmod(os.path.getsize(path) - at, layout.dtype.itemsize)
            if rest:
                raise ValueError(f"{path}: ends within a record")
            out += [Piece(path, i, min(self.rows, n - i)) for i in range(0, n, self.rows)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        layout, at = Layout.read(piece.path)
        spot = {n: i for i, (n, _) in enumerate(layout.fields)}
        missing = [n for n in self.names if n not in spot]
        if missing:
            raise ValueError(f"{piece.path}: no such fields: {missing}")
        rows = np.memmap(piece.path, layout.dtype, "r", at + piece.first * layout.dtype.itemsize, (piece.count,))
        tests = {k.__name__: f for k, f in COMPARISONS.items()}
        for begin in range(0, piece.count, BATCH):
            part = rows[begin : begin + BATCH]
            there = lambda n, part=part: (part["_set"] >> np.uint64(spot[n])) & np.uint64(1) == 1
            keep = np.ones(len(part), bool)
            for name, test, value in self.wanted:
                own = part[f"f{spot[name]}"]
                hit = tests[test](own, value)
                if own.dtype.kind == "f" and test.startswith("Greater"):
                    hit = hit | np.isnan(own)  # which Spark takes for the largest number
                keep &= there(name) & hit
            cols = []
            for n in self.names:
                own, null = part[f"f{spot[n]}"][keep], ~there(n)[keep]
                if layout.fields[spot[n]][1].startswith("S"):
                    cols.append(pa.array([None if x else v.decode() for v, x in zip(own.tolist(), null.tolist(), strict=True)], pa.string()))
                else:
                    cols.append(pa.array(np.ascontiguousarray(own), mask=null))
            yield pa.RecordBatch.from_arrays(cols, names=self.names)


class FilteringReader(Reader):
    def pushFilters(self, filters):
        for f in filters:
            if type(f) in COMPARISONS and len(f.attribute) == 1 and isinstance(f.value, (int, float)) and not isinstance(f.value, bool) and f.value == f.value:
                self.wanted.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.layout, self.path, self.overwrite = Layout.of(schema, options), options["path"].removeprefix("file:"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        path = os.path.join(self.path, f"{uuid.uuid4().hex}.tmp")
        try:
            self._put(path, batches)
        except BaseException:
            os.remove(path)
            raise
        return Written(path)

    def _put(self, path: str, batches: Iterator[pa.RecordBatch]) -> None:
        with open(path, "wb") as f:
            f.write(self.layout.header())
            for b in batches:
                rows = np.zeros(b.num_rows, self.layout.dtype)
                for i, (name, code) in enumerate(self.layout.fields):
                    c = b.column(i)
                    rows["_set"] |= np.asarray(c.is_valid()).astype(np.uint64) << np.uint64(i)
                    if code.startswith("S"):
                        values = [(v or "").encode() for v in c.to_pylist()]
                        if max(map(len, values), default=0) > int(code[1:]) or any(v.endswith(b"\0") for v in values):
                            raise ValueError(f"{name}: a string of more than {code[1:]} bytes, or that ends with a zero")
                        rows[f"f{i}"] = values
                    else:
                        rows[f"f{i}"] = c.fill_null(False if code == "?" else 0).to_numpy(zero_copy_only=False)
                f.write(rows.tobytes())

    def commit(self, messages):
        old = files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.path, m.path.removesuffix(".tmp") + SUFFIX)
        for path in old:
            os.remove(path)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class Records(DataSource):
    @classmethod
    def name(cls):
        return "records"

    def schema(self):
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no files of records in {self.options['path']}: pass a schema")
        whole = Layout.read(found[0])[0].schema()
        names = [n.strip() for n in self.options["columns"].split(",")] if self.options.get("columns") else whole.names
        unknown = [n for n in names if n not in whole.names]
        if unknown:
            raise ValueError(f"no such fields: {unknown}")
        return StructType([whole[n] for n in names])

    def reader(self, schema):
        return (FilteringReader if self.options.get("filters") == "true" else Reader)(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)


def records_to_parquet(spark: SparkSession, source: str, out: str, overwrite: bool = False) -> list[str]:
    """A table of parquet for each file of records in ``source``, below ``out``; those that are there stay unless ``overwrite``.  Returns the new ones."""
    register(spark)
    made = []
    for path in files(source):
        dest = os.path.join(out, os.path.basename(path).removesuffix(SUFFIX) + ".parquet")
        if overwrite or not os.path.exists(os.path.join(dest, "_SUCCESS")):
            spark.read.format("records").load(path).write.mode("overwrite").option("compression", "zstd").parquet(dest)
            made.append(dest)
    return made
