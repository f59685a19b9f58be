"""The depth table of a book in parallel, from relations instead of one replay.

Blocks and epochs (which a clear begins) are numbered by counts over ranges of rows.  What an order has left follows from
windows over (book, epoch, order): its latest placing less the cancels since.  Differences of neighbouring rows are
changes of price levels, whose running sums over (book, epoch, side, price) say how much a level holds from which block
to which.  These spans are dealt out by ranges of blocks, each with the levels alive at its start, and a range is swept
block by block for its best prices.  Trades are aggregates of their block.  So a book is one task nowhere: the largest
pieces are an order, a level and a range.

A top-of-book row replaces its side.  Orders placed before such a row and changed after it would act on levels that are
no longer theirs; books in which that happens are replayed row by row by :func:`depthforge.operators.book.build_depth`,
so that the rows are the same for every input.  Rows of one book must have different row numbers.  An empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.functions.exprs import UNDEF
from depthforge.operators.book import KEYS, LAST, TOB, U32, build_depth, depth_schema, typed_events
from depthforge.sources.shared import written

#: Rows of a range that counts are carried over, and blocks of a range that is swept.
ROWS = 200_000
BLOCKS = 20_000


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on ``names`` in which nulls are equal, without the right side's copies."""
    r = right.select(*(F.col(n).alias(f"_r_{n}") for n in names), *(c for c in right.columns if c not in names))
    on = F.col(names[0]).eqNullSafe(F.col(f"_r_{names[0]}"))
    for n in names[1:]:
        on = on & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return left.join(r, on, how).drop(*(f"_r_{n}" for n in names))


def counted(df: DataFrame, flags: dict[str, Column], keys: list[str], order: str, width: int) -> DataFrame:
    """``df`` with the running counts of ``flags`` along ``order`` within ``keys``, over ranges of ``width`` steps of ``order``."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / width)).withColumns({f"_is_{n}": F.coalesce(f.cast("int"), F.lit(0)) for n, f in flags.items()})
    sums = ranged.groupBy(*keys, "_range").agg(*(F.sum(f"_is_{n}").alias(f"_all_{n}") for n in flags))
    over = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, "_range", *(F.coalesce(F.sum(f"_all_{n}").over(over), F.lit(0)).alias(f"_was_{n}") for n in flags))
    within = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return _joined(ranged, before, [*keys, "_range"]).select(*df.columns, *((F.sum(f"_is_{n}").over(within) + F.col(f"_was_{n}")).alias(n) for n in flags))


def has(flag: int) -> Column:
    return F.coalesce(F.col("flags").bitwiseAND(F.lit(flag)) != 0, F.lit(False))


def replaces() -> Column:
    """Top-of-book rows of a side."""
    return F.coalesce((F.col("action") == "A") & F.col("side").isin("B", "A") & has(TOB), F.lit(False))


def numbered(events: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Events with block (LAST rows before), epoch (clears so far) and, by side, top-of-book rows so far."""
    top = lambda s: replaces() & (F.col("side") == s)
    last = has(LAST)
    out = counted(events, {"block": last, "epoch": F.col("action") == "R", "tob_B": top("B"), "tob_A": top("A")}, keys, "row_nr", width)
    return out.withColumn("ends", last).withColumn("block", F.col("block") - F.col("ends").cast("int"))


# ---------------------------------------------------------------- levels


def order_changes(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, epoch, row_nr, block, and of the order before and after the event: side, price, size, tob): rows that place, change or drop orders."""
    usable = F.col("order_id") != 0
    sided = F.col("side").isin("B", "A")
    # a placing sets the order anew; one without size or price takes it away
    places = usable & sided & (((F.col("action") == "A") & ~has(TOB) & (F.col("size") > 0)) | (F.col("action") == "M"))
    rests = (F.col("size") > 0) & (F.col("price") != UNDEF)
    own = events.withColumn("places", F.coalesce(places, F.lit(False))).where(usable & (F.col("places") | (F.col("action") == "C")))
    run = W.partitionBy(*keys, "epoch", "order_id").orderBy("row_nr")
    so_far = run.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("placing", F.sum(F.col("places").cast("int")).over(so_far))
    put = F.struct(F.col("side").alias("side"), F.col("price").alias("price"), F.when(rests, F.col("size")).otherwise(0).alias("size"), F.when(F.col("side") == "B", F.col("tob_B")).otherwise(F.col("tob_A")).alias("tob"))
    own = own.withColumn("put", F.last(F.when(F.col("places"), put), ignorenulls=True).over(so_far))
    life = W.partitionBy(*keys, "epoch", "order_id", "placing").orderBy("row_nr").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = F.sum(F.when(F.col("action") == "C", F.col("size")).otherwise(0)).over(life)
    now = F.when(F.col("put").isNotNull(), F.struct(F.col("put.side"), F.col("put.price"), F.greatest(F.col("put.size") - cut, F.lit(0)).alias("size"), F.col("put.tob")))
    own = own.withColumn("now", now)
    return own.withColumn("was", F.lag("now").over(run)).where("(was is not null and was.size > 0) or (now is not null and now.size > 0)")


def level_changes(events: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, era, price, block, size, n): what each block adds to a level; an era ends with a clear or a top-of-book row of the side."""
    era = lambda tob: F.struct(F.col("epoch"), tob.alias("tob"))
    moves = F.array(
        F.struct(F.col("was.side").alias("side"), era(F.col("was.tob")).alias("era"), F.col("was.price").alias("price"), (-F.col("was.size")).alias("size"), F.lit(-1).alias("n")),
        F.struct(F.col("now.side").alias("side"), era(F.col("now.tob")).alias("era"), F.col("now.price").alias("price"), F.col("now.size").alias("size"), F.lit(1).alias("n")),
    )
    moved = changes.select(*keys, "block", F.explode(moves).alias("m")).where("m.size <> 0").select(*keys, "block", "m.*")
    tob = F.when(F.col("side") == "B", F.col("tob_B")).otherwise(F.col("tob_A"))
    replaced = events.where(replaces() & (F.col("price") != UNDEF) & (F.col("size") > 0))
    replaced = replaced.select(*keys, "block", "side", era(tob).alias("era"), "price", "size", F.lit(1).alias("n"))
    return moved.unionByName(replaced).groupBy(*keys, "side", "era", "price", "block").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))


def eras(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, era, gone): the block in which an era of a side ends, for those that end."""
    tob = F.when(F.col("side") == "B", F.col("tob_B")).otherwise(F.col("tob_A"))
    clears = events.where("action = 'R'").select(*keys, "row_nr", "block", "epoch", F.explode(F.array(F.lit("B"), F.lit("A"))).alias("side"), "tob_B", "tob_A")
    tops = events.where(replaces()).select(*keys, "row_nr", "block", "epoch", "side", "tob_B", "tob_A")
    begins = clears.withColumn("cleared", F.lit(1)).unionByName(tops.withColumn("cleared", F.lit(0))).withColumn("tob", tob)
    # the era before differs by the clear or by the top-of-book row
    before = F.struct((F.col("epoch") - F.col("cleared")).alias("epoch"), (F.col("tob") - 1 + F.col("cleared")).alias("tob"))
    return begins.select(*keys, "side", before.alias("era"), F.col("block").alias("gone"))


def spans(levels: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, price, start, stop, size, n): what a level holds at the ends of the blocks from start up to before stop (null: to the end)."""
    w = W.partitionBy(*keys, "side", "era", "price").orderBy("block")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    held = levels.select(*keys, "side", "era", "price", F.col("block").alias("start"), F.lead("block").over(w).alias("next"), F.sum("size").over(so_far).alias("size"), F.sum("n").over(so_far).alias("n")).where("size > 0 and n > 0")
    met = _joined(held, ends, [*keys, "side", "era"], "left").withColumn("stop", F.least("next", "gone"))  # least skips nulls
    return met.where("stop is null or stop > start").select(*keys, "side", "price", "start", "stop", "size", "n")


# ---------------------------------------------------------------- sweep


def tops(held: DataFrame, wanted: DataFrame, last: DataFrame, keys: list[str], levels: int, width: int) -> DataFrame:
    """(keys, block, moved, top): the best levels at the end of the blocks where they moved and of those in ``wanted`` (keys, block).

    ``last`` (keys, n_blocks) bounds the spans.  A range begins with what is held at the end of the block before it.
    """
    whole = _joined(held, last, keys).withColumn("stop", F.coalesce("stop", "n_blocks")).drop("n_blocks")
    # a range looks at the block before its first, too
    ranges = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))
    each = whole.withColumn("range", F.explode(ranges)).withColumn("from", F.greatest("start", F.col("range") * width - 1)).withColumn("to", F.col("stop"))
    each = each.where("from < to")
    end = (F.col("range") + 1) * width
    come = F.struct(F.col("from").alias("at"), F.lit(1).alias("what"), "side", "price", "size", "n")
    go = F.when(F.col("to") < end, F.struct(F.col("to").alias("at"), F.lit(0).alias("what"), "side", "price", F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("n")))
    moves = each.select(*keys, "range", F.explode(F.array(come, go)).alias("m")).where("m is not null").select(*keys, "range", "m.*")
    asked = wanted.select(*keys, F.floor(F.col("block") / width).alias("range"), F.col("block").alias("at"), F.lit(2).alias("what"), F.lit("").alias("side"), F.lit(0).cast("bigint").alias("price"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("n"))
    rows = moves.unionByName(asked).repartition(*keys, "range").sortWithinPartitions(*keys, "range", "at", "what")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block bigint, moved boolean, top array<bigint>"])

    def sweep(batches):
        current = None
        held_, prices, best, at, asked_ = {}, {"B": [], "A": []}, None, None, False
        out: list = []

        def top():
            flat = []
            for i in range(levels):
                for s, p in (("B", prices["B"]), ("A", prices["A"])):
                    if i < len(p):
                        price = p[-1 - i] if s == "B" else p[i]
                        flat += [price, *held_[s, price]]
                    else:
                        flat += [UNDEF, 0, 0]
            return flat

        def close():
            """The block that the rows so far belong to has ended."""
            nonlocal best
            if at is None:
                return
            now = top()
            begin = current[-1] * width
            if at >= begin and (asked_ or now != best):
                out.append((current[:-1], at, now != best, now))
            best = now

        def table(batch):
            cols = [pa.array([k[j] for k, *_ in out], batch.schema.field(n).type) for j, n in enumerate(keys)]
            made = pa.RecordBatch.from_arrays([*cols, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out]), pa.array([x[3] for x in out], pa.list_(pa.int64()))], names=[*keys, "block", "moved", "top"])
            out.clear()
            return made

        seen = None
        for batch in batches:
            seen = batch
            cols = [batch.column(n).to_pylist() for n in (*keys, "range", "at", "what", "side", "price", "size", "n")]
            for row in zip(*cols, strict=True):
                key, (block, what, side, price, size, n) = row[: len(keys) + 1], row[len(keys) + 1 :]
                if key != current:
                    close()
                    current, at, asked_ = key, None, False
                    held_.clear()
                    for p in prices.values():
                        p.clear()
                    best = top()
                if block != at:
                    close()
                    at, asked_ = block, False
                if what == 2:
                    asked_ = True
                elif what == 1:
                    if (side, price) not in held_:
                        insort(prices[side], price)
                    held_[side, price] = (size, n)
                elif (side, price) in held_:
                    del held_[side, price]
                    del prices[side][bisect_left(prices[side], price)]
            if len(out) >= 20_000:
                yield table(batch)
        close()
        if out:
            yield table(seen)

    return rows.mapInArrow(sweep, schema)


# ---------------------------------------------------------------- trades


def trades(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, side, first, columns of the trade): what each side traded in a block."""
    block = [*keys, "block"]
    priced = F.col("price") != UNDEF
    at = F.struct("row_nr", "price")
    deals = events.where("action = 'T'").groupBy(*block, "side").agg(
        F.min(F.struct("row_nr", "ts_ns", "sequence")).alias("first"), F.sum("size").alias("qty"), F.count(F.lit(1)).cast("int").alias("trade_levels"),
        F.sum(F.when(priced, F.col("size"))).alias("priced"), F.sum(F.when(priced, F.col("price").cast("double") * F.col("size").cast("double"))).alias("notional"),
        F.min(F.when(priced, at)).alias("head"), F.max(F.when(priced, at)).alias("tail"), F.min(F.when(priced, F.col("price"))).alias("low"), F.max(F.when(priced, F.col("price"))).alias("high"),
    )
    # a fill is that of the first other side that has traded before it
    sides = deals.where("side <> 'N'").groupBy(*block).agg(F.array_sort(F.collect_list(F.struct(F.col("first.row_nr").alias("row_nr"), "side"))).alias("sides"))
    fills = _joined(events.where("action = 'F'").select(*block, F.col("side").alias("own"), "row_nr"), sides, block)
    met = F.get(F.filter("sides", lambda s: (s["side"] != F.col("own")) & (s["row_nr"] < F.col("row_nr"))), F.lit(0))["side"]
    filled = fills.select(*block, met.alias("side")).where("side is not null").groupBy(*block, "side").agg(F.count(F.lit(1)).cast("int").alias("trade_fills"))
    # an order of a trade that is added afterwards was posted
    ids = events.where("action = 'T' and order_id <> 0").groupBy(*block, "order_id", "side").agg(F.min("row_nr").alias("traded"))
    added = events.where("action = 'A' and order_id <> 0").select(*block, "order_id", "row_nr", "size")
    posted = _joined(added, ids, [*block, "order_id"]).where("traded < row_nr").groupBy(*block, "side").agg(F.sum("size").alias("posted"))
    out = _joined(_joined(deals, filled, [*block, "side"], "left"), posted, [*block, "side"], "left")
    best = F.when(F.col("side") == "B", F.col("low")).when(F.col("side") == "A", F.col("high")).otherwise(F.col("head.price"))
    worst = F.when(F.col("side") == "B", F.col("high")).when(F.col("side") == "A", F.col("low")).otherwise(F.col("tail.price"))
    newest = F.col("first.row_nr") == F.max("first.row_nr").over(W.partitionBy(*block))
    return out.select(
        *block, "first", newest.alias("newest"), best.alias("trade_px"), F.least("qty", F.lit(U32)).alias("trade_sz"), F.when(F.col("side") == "B", 0).when(F.col("side") == "A", 1).alias("trade_side"),
        worst.alias("trade_px_last"), F.when(F.col("priced") > 0, F.col("notional") / F.when(F.col("priced") > 0, F.col("priced"))).alias("trade_vwap"), "trade_levels",
        F.coalesce("trade_fills", F.lit(0)).alias("trade_fills"), F.least(F.coalesce("posted", F.lit(0)), F.lit(U32)).alias("trade_posted_sz"),
    )


# ---------------------------------------------------------------- the table


def mixed_books(changes: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of the books in which an order outlives a top-of-book row of its side."""
    tob_now = F.when(F.col("was.side") == "B", F.col("tob_B")).otherwise(F.col("tob_A"))
    return changes.where((F.col("was.size") > 0) & (F.col("was.tob") != tob_now)).select(*keys).distinct()


def build_depth_by_ranges(events: DataFrame, levels: int = 5, date: str | None = None, rows: int = ROWS, blocks: int = BLOCKS) -> DataFrame:
    """The rows of :func:`depthforge.operators.book.build_depth`, each book in many tasks."""
    if levels < 1:
        raise ValueError("one level at least")
    keys = [*([date] if date else []), *(k for k, _ in KEYS)]
    every = typed_events(events, date)
    ev = written(numbered(every, keys, rows), "book")
    changes = written(order_changes(ev, keys), "book")
    mixed = written(mixed_books(changes, ev, keys), "book")
    some = mixed.limit(1).count() > 0
    if some:  # few books, or none: their rows take the other way
        plain = lambda df: _joined(df, mixed.withColumn("_mixed", F.lit(True)), keys, "left").where("_mixed is null").drop("_mixed")
        rest = build_depth(_joined(every, mixed.withColumn("_mixed", F.lit(True)), keys).drop("_mixed"), levels, date)
        ev, changes = plain(ev), plain(changes)
    held = spans(level_changes(ev, changes, keys), eras(ev, keys), keys)
    closing = ev.groupBy(*keys, "block").agg(F.max(F.struct("row_nr", "ts_ns", "sequence")).alias("last"))
    ended = ev.groupBy(*keys).agg((F.max("block") + 1).alias("n_blocks"))
    deals = trades(ev, keys)
    best = tops(held, deals.select(*keys, "block").distinct(), ended, keys, levels, blocks)
    # every block that moved or traded, with its trades if there are any
    out = _joined(_joined(best, closing, [*keys, "block"]), deals, [*keys, "block"], "left").where("moved or first is not null")
    meta = F.when(F.col("newest") == F.lit(False), F.col("first")).otherwise(F.col("last"))
    schema = depth_schema(levels, date)
    picked = [F.col(k).alias(k) for k in keys] + [meta[c].alias(c) for c in ("ts_ns", "row_nr", "sequence")]
    picked += [F.col(f.name) for f in schema.fields if f.name.startswith("trade_")]
    book = [f for f in schema.fields if f.name.startswith(("bid_", "ask_"))]
    picked += [F.get("top", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(book)]
    out = out.select(*picked)
    out = out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    return out.unionByName(rest) if some else out
