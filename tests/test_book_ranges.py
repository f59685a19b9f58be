"""The relational depth table against the replay."""

import random

import pytest
from pyspark.sql import functions as F

from depthforge.operators import book_ranges
from depthforge.operators.book import build_depth
from depthforge.operators.book_ranges import build_depth_by_ranges

L, T = 128, 64
U = 9223372036854775807
SCHEMA = "day string, publisher_id int, instrument_id bigint, ts_ns bigint, row_nr bigint, sequence bigint, action string, side string, price bigint, size bigint, order_id bigint, flags int"


def frame(spark, books):
    """Events of books, each a list of (action, side, price, size, order, flags)."""
    rows = [("d", 1, 7 + k, 1000 + i, i * 3, i, *e) for k, events in enumerate(books) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def parsed(text):
    out = []
    for part in text.split(";"):
        a, side, price, size, order, *flags = part.split()
        out.append((a, side, U if price == "U" else int(price), int(size), int(order), sum({"L": L, "S": 32, "T": T}[c] for c in (flags[0] if flags else ""))))
    return out


def noise(seed, n, tob=0.0, ends=0.4, odd=True):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.choices("AMCTFNRQ", [30, 15, 25, 12, 10, 2, 0.6, 1])[0]
        side = rng.choice("BA") if rng.random() < 0.93 or not odd else rng.choice("NX")
        price = 100 + rng.randrange(9) if rng.random() < 0.96 else U
        flags = L * (rng.random() < ends) + T * (a == "A" and rng.random() < tob)
        out.append((a, side, price, rng.randrange(7), rng.randrange(25), flags))
    return out


def same(spark, events, levels=2, **how):
    got, want = build_depth_by_ranges(events, levels, **how), build_depth(events, levels, how.get("date"))
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    a, b = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
    return len(a)


BLOCKS = [
    "A B 100 5 1 L; A B 99 3 2 L; A B 98 7 3 L; C B 98 7 3 L; C B 100 5 1 L",
    "A B 100 5 1 L; A A 101 4 2 L; T A 100 2 900; F B 100 2 1; C B 100 2 1 L",
    "A B 100 2 1 L; A B 100 1 2 L; A B 99 1 3 L; T A 100 3 900; F B 100 2 1; F B 100 1 2; T A 99 1 900; F B 99 1 3; C B 100 2 1; C B 100 1 2; C B 99 1 3 L",
    "A A 102 1 10 L; A B 100 2 20 L; T A 100 1 10; F A 100 1 10; F B 100 1 20; M B 100 1 20; C A 102 1 10 L",
    "A A 101 1 2 L; T B 101 1 900; F A 101 1 2; A B 100 3 900; C A 101 1 2 L",
    "R N U 0 0 S; A B 100 1 1 S; A A 101 1 2 S; A B 99 1 3 SL",
    "A B 100 5 0 TL; A B U 0 0 TL; A B 101 2 0 TL; A B 99 4 0 TL",
    "A B 100 1 1 L; A A 101 1 2 L; T A 100 1 901; F B 100 1 1; C B 100 1 1; T B 101 1 902; F A 101 1 2; C A 101 1 2 L",
    "A B 100 1 1",
    "A B 100 0 1 L; A B 99 1 2 L",
    "A B 100 5 1 L; A B 101 2 1 L; C B 100 1 999 L",
    "A B 100 5 1 L; T A 100 2 900; F B 100 2 1; C B 100 2 1 L",
    "A B 100 5 1 L; T A 100 2 900 L; Q B 1 1 1 L",
    "A B 100 5 1; R N U 0 0; A B 101 5 1 L; R N U 0 0 L; A A 102 1 4 L",
    "A B 100 5 1 L; A B 101 2 0 TL; C B 100 5 1 L; A B 101 1 3 L; C B 101 1 3 L",
]


def test_blocks(spark):
    """The blocks of the replay's own tests, one of them a book in which an order outlives a top-of-book row."""
    events = frame(spark, [parsed(b) for b in BLOCKS])
    assert same(spark, events, rows=4, blocks=2) > 30
    keys = ["publisher_id", "instrument_id"]
    ev = book_ranges.numbered(book_ranges.typed_events(events), keys, 4)
    mixed = book_ranges.mixed_books(book_ranges.order_changes(ev, keys), ev, keys)
    assert [r.instrument_id for r in mixed.collect()] == [7 + len(BLOCKS) - 1]


@pytest.mark.parametrize("rows, blocks", [(10**6, 10**6), (50, 7), (3, 1)])
def test_noise(spark, rows, blocks):
    """Three books of a few hundred events of all kinds, in ranges of any width."""
    books = [noise(1, 300), noise(2, 250, ends=0.05), noise(3, 200, ends=1.0)]
    assert same(spark, frame(spark, books), 3, rows=rows, blocks=blocks) > 100


def test_noise_with_tops(spark):
    """Top-of-book rows alone, and among orders."""
    tops = [("A", s, p, z, 0, f | T) for _, s, p, z, _, f in noise(4, 300, odd=False)]
    assert same(spark, frame(spark, [tops, noise(5, 200, tob=0.3), noise(6, 200)]), rows=40, blocks=9) > 100


def test_days_and_one_book(spark):
    """Books start anew each day; a book uses many tasks."""
    events = frame(spark, [noise(7, 400)])
    both = events.unionByName(events.withColumn("day", F.lit("e")))
    assert same(spark, both, date="day", rows=64, blocks=16) > 100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        used = build_depth_by_ranges(events, 2, rows=64, blocks=16).select(F.spark_partition_id().alias("p")).distinct().count()
        assert used == 4 and build_depth(events, 2).select(F.spark_partition_id().alias("p")).distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_edges(spark):
    assert build_depth_by_ranges(frame(spark, []), 2).count() == 0
    null = frame(spark, [noise(8, 60)]).withColumn("instrument_id", F.lit(None).cast("bigint"))
    assert same(spark, null, rows=9, blocks=3) > 5
    with pytest.raises(ValueError):
        build_depth_by_ranges(frame(spark, []), 0)
