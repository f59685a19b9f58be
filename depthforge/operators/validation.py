"""Checks of a depth table against its events: what differs comes out as rows.

The table is held against an independent rebuild: rows of one are compared with those of
:func:`depthforge.operators.book_ranges.build_depth_by_ranges` at a sample of rows, drawn by a hash so that both sides draw
alike.  Over all rows, what was traded is what the events traded, size by size and in notional value, and row numbers of a
book rise.  An empty result means that no fault was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.functions.exprs import UNDEF
from depthforge.operators.book import KEYS, depth_schema, typed_events
from depthforge.operators.book_ranges import build_depth_by_ranges

#: Notional values agree to this share.
TOLERANCE = 1e-9
NAMES = [k for k, _ in KEYS]
#: What tells a depth row from others of its book: two sides may trade in one block.
ROW = ["row_nr", "trade_side"]


def sampled(depth: DataFrame, every: int) -> DataFrame:
    """About one in ``every`` rows, the same ones of any table with the same rows."""
    return depth.where(F.pmod(F.xxhash64(*NAMES, "row_nr"), F.lit(every)) == 0) if every > 1 else depth


def compare(depth: DataFrame, rebuilt: DataFrame, levels: int) -> DataFrame:
    """(keys, row_nr, issue, detail): rows that one table alone has, and columns in which they differ."""
    schema = depth_schema(levels)
    others = [f.name for f in schema.fields if f.name not in (*NAMES, *ROW)]
    side = lambda df, name: df.select(*(F.coalesce(F.col(c).cast("bigint"), F.lit(-1)).alias(f"_{c}") for c in [*NAMES, *ROW]), F.struct(*others).alias(name)).groupBy(*(f"_{c}" for c in [*NAMES, *ROW])).agg(F.first(name).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    both = side(depth, "given").join(side(rebuilt, "rebuilt"), [f"_{c}" for c in [*NAMES, *ROW]], "full")

    def differs(c):
        a, b = F.col(f"given.{c}"), F.col(f"rebuilt.{c}")
        if c == "trade_vwap":
            return ~((a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(False)))
        return ~a.eqNullSafe(b)

    wrong = F.filter(F.array(*(F.when(differs(c), F.lit(c)) for c in others)), lambda x: x.isNotNull())
    issue = (
        F.when(F.col("given").isNull(), F.struct(F.lit("missing_row").alias("issue"), F.lit("").alias("detail")))
        .when(F.col("rebuilt").isNull(), F.struct(F.lit("unexpected_row").alias("issue"), F.lit("").alias("detail")))
        .when(F.col("n_given") != F.col("n_rebuilt"), F.struct(F.lit("repeated_row").alias("issue"), F.col("n_given").cast("string").alias("detail")))
        .when(F.size(wrong) > 0, F.struct(F.lit("different_row").alias("issue"), F.array_join(wrong, ",").alias("detail")))
    )
    found = both.withColumn("_issue", issue).where("_issue is not null")
    return found.select(*(F.col(f"_{k}").alias(k) for k in NAMES), F.col("_row_nr").alias("row_nr"), "_issue.issue", "_issue.detail")


def traded(depth: DataFrame, events: DataFrame) -> DataFrame:
    """(keys, row_nr, issue, detail) of the books whose traded sizes or notional values aren't those of their events."""
    code = F.when(F.col("side") == "B", 0).when(F.col("side") == "A", 1).otherwise(-1)
    told = events.where("action = 'T'").groupBy(*NAMES, code.alias("s")).agg(F.sum("size").alias("size"), F.sum(F.when(F.col("price") != UNDEF, F.col("price").cast("double") * F.col("size"))).alias("value"))
    priced = events.where(F.col("price") == UNDEF).where("action = 'T'").select(*NAMES).distinct().withColumn("_unpriced", F.lit(True))
    own = depth.where("trade_sz is not null").groupBy(*NAMES, F.coalesce("trade_side", F.lit(-1)).alias("s")).agg(F.sum("trade_sz").alias("own_size"), F.sum(F.col("trade_vwap") * F.col("trade_sz")).alias("own_value"))
    both = told.join(own, [*NAMES, "s"], "full").join(priced, NAMES, "left")
    size = ~F.coalesce("size", F.lit(0)).eqNullSafe(F.coalesce("own_size", F.lit(0)))
    a, b = F.coalesce("value", F.lit(0.0)), F.coalesce("own_value", F.lit(0.0))
    # rows without a price count to a trade's size but not to its average price
    value = F.col("_unpriced").isNull() & (F.abs(a - b) > TOLERANCE * F.greatest(F.abs(a), F.abs(b)))
    text = lambda x, y: F.concat_ws(" ", F.lit("side"), F.col("s").cast("string"), F.lit("events"), F.coalesce(F.col(x), F.lit(0)).cast("string"), F.lit("depth"), F.coalesce(F.col(y), F.lit(0)).cast("string"))
    issues = F.array(F.when(size, F.struct(F.lit("traded_size").alias("issue"), text("size", "own_size").alias("detail"))), F.when(value, F.struct(F.lit("traded_value").alias("issue"), text("value", "own_value").alias("detail"))))
    return both.select(*NAMES, F.lit(None).cast("bigint").alias("row_nr"), F.explode(issues).alias("i")).where("i is not null").select(*NAMES, "row_nr", "i.*")


def disorder(depth: DataFrame, order: str = "_at") -> DataFrame:
    """(keys, row_nr, issue, detail) of the rows whose number isn't above that of the row before, along ``order``; sides of one block may share a number's place but not the number."""
    w = W.partitionBy(*NAMES).orderBy(order)
    back = depth.withColumn("_was", F.lag("row_nr").over(w)).where("row_nr <= _was")
    return back.select(*NAMES, "row_nr", F.lit("row_order").alias("issue"), F.concat(F.lit("after "), F.col("_was").cast("string")).alias("detail"))


def validate(depth: DataFrame, events: DataFrame, levels: int, every: int = 1, order: str | None = None, **ranges) -> DataFrame:
    """All issues of ``depth``, built from ``events`` with ``levels``: none if they are as they should be.

    ``order`` names a column with the place of each row in its file, if rows are to be checked to rise.
    """
    out = compare(sampled(depth, every), sampled(build_depth_by_ranges(events, levels, **ranges), every), levels).unionByName(traded(depth, typed_events(events)))
    return out.unionByName(disorder(depth, order)) if order else out
