"""The depth table as a table function of SQL: ``SELECT * FROM book_depth(TABLE(events), 3)``.

Partitioning by book and the order of rows are the function's own, so a query needn't name them; the columns follow
from the number of levels.  Rows of a book pass through one task in order, as in :func:`depthforge.operators.book.build_depth`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from depthforge.operators.book import EVENTS, KEYS, Book, depth_schema


class BookDepth:
    """One book's replay: a row of events in, rows of depth out as blocks end."""

    @staticmethod
    def analyze(events: AnalyzeArgument, levels: AnalyzeArgument) -> AnalyzeResult:
        if not events.isTable:
            raise ValueError("the first argument is a table of events")
        if levels.value is None or levels.value < 1:
            raise ValueError("one level at least")
        missing = {*(k for k, _ in KEYS), *EVENTS} - {f.name for f in events.dataType.fields}
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        return AnalyzeResult(depth_schema(levels.value), partitionBy=[PartitioningColumn(k) for k, _ in KEYS], orderBy=[OrderingColumn("row_nr")])

    def __init__(self):
        self.book, self.key = None, None

    def eval(self, row, levels: int):
        if self.book is None:
            self.book, self.key = Book(levels), tuple(row[k] for k, _ in KEYS)
        for made in self.book.push(*(row[c] for c in EVENTS)):
            yield (*self.key, *made)

    def terminate(self):
        if self.book is not None:
            for made in self.book.finish():
                yield (*self.key, *made)


def register(spark: SparkSession, name: str = "book_depth") -> None:
    """Makes the function known to the session's SQL."""
    spark.udtf.register(name, udtf(BookDepth))
