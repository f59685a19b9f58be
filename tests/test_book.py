import random

import pytest

from depthforge.functions.exprs import UNDEF as U
from depthforge.operators.book import Book, book_stats, build_depth, depth_columns, with_context

L, S, T = 128, 32, 64


def replay(text, levels, instruments=None):
    """Rows as dicts and summed stats of events written as 'action side price size order [flags]; ...'."""
    books, rows = {}, []
    for i, part in enumerate(text.split(";")):
        a, side, price, size, order, *flags = part.split()
        key = instruments[i] if instruments else 7
        book = books.setdefault(key, Book(levels))
        flag = sum({"L": L, "S": S, "T": T}[c] for c in (flags[0] if flags else ""))
        made = book.push(1000 + i, i, i, a, side, U if price == "U" else int(price), int(size), int(order), flag)
        rows += [(key, r) for r in made]
    for key, book in sorted(books.items(), key=lambda b: b[1].meta[1]):
        rows += [(key, r) for r in book.finish()]
    names = depth_columns(levels)[2:]
    stats = {k: sum(b.stats[k] for b in books.values()) for k in next(iter(books.values())).stats}
    return [{"instrument_id": k, **dict(zip(names, r, strict=True))} for k, r in rows], stats


def prices(row, side="bid", n=2):
    return [row[f"{side}_px_{i}"] for i in range(n)]


def test_emits_on_change_of_visible_levels_only():
    rows, stats = replay("A B 100 5 1 L; A B 99 3 2 L; A B 98 7 3 L; C B 98 7 3 L; C B 100 5 1 L", 2)
    assert stats["blocks"] == 5 and [prices(r) for r in rows] == [[100, U], [100, 99], [99, U]]
    assert [rows[-1][f"bid_sz_{i}"] for i in (0, 1)] == [3, 0] and all(r["trade_sz"] is None for r in rows)


def test_full_fill():
    rows, _ = replay("A B 100 5 1 L; A A 101 4 2 L; T A 100 2 900; F B 100 2 1; C B 100 2 1 L", 2)
    r = rows[-1]
    assert len(rows) == 3 and (r["trade_side"], r["trade_sz"], r["trade_px"], r["trade_px_last"], r["trade_vwap"]) == (1, 2, 100, 100, 100.0)
    assert (r["trade_levels"], r["trade_fills"], r["trade_posted_sz"], r["row_nr"]) == (1, 1, 0, 4)
    assert (r["bid_px_0"], r["bid_sz_0"], r["ask_px_0"], r["ask_sz_0"]) == (100, 3, 101, 4)


def test_sweep_over_levels():
    rows, _ = replay("A B 100 2 1 L; A B 100 1 2 L; A B 99 1 3 L; T A 100 3 900; F B 100 2 1; F B 100 1 2; T A 99 1 900; F B 99 1 3; C B 100 2 1; C B 100 1 2; C B 99 1 3 L", 2)
    r = rows[-1]
    assert (r["trade_sz"], r["trade_levels"], r["trade_fills"], r["trade_px"], r["trade_px_last"], r["trade_vwap"]) == (4, 2, 3, 100, 99, 399 / 4)
    assert prices(r) == [U, U]


def test_repriced_aggressor_fills_once():
    rows, _ = replay("A A 102 1 10 L; A B 100 2 20 L; T A 100 1 10; F A 100 1 10; F B 100 1 20; M B 100 1 20; C A 102 1 10 L", 2)
    r = rows[-1]
    assert (r["trade_sz"], r["trade_fills"], r["bid_px_0"], r["bid_sz_0"], r["ask_px_0"]) == (1, 1, 100, 1, U)


def test_rest_of_an_aggressor_is_posted():
    rows, _ = replay("A A 101 1 2 L; T B 101 1 900; F A 101 1 2; A B 100 3 900; C A 101 1 2 L", 2)
    r = rows[-1]
    assert (r["trade_side"], r["trade_posted_sz"], r["bid_px_0"], r["bid_sz_0"]) == (0, 3, 100, 3)


def test_snapshot_is_one_block():
    rows, stats = replay("R N U 0 0 S; A B 100 1 1 S; A A 101 1 2 S; A B 99 1 3 SL", 2)
    assert stats["blocks"] == 1 and len(rows) == 1 and prices(rows[0]) == [100, 99] and rows[0]["ask_px_0"] == 101


def test_top_of_book_replaces_the_side():
    rows, _ = replay("A B 100 5 0 TL; A B U 0 0 TL; A B 101 2 0 TL; A B 99 4 0 TL", 2)
    assert [r["bid_px_0"] for r in rows] == [100, U, 101, 99] and (rows[0]["bid_sz_0"], rows[0]["bid_ct_0"]) == (5, 1)
    assert [rows[-1][f"bid_sz_{i}"] for i in (0, 1)] == [4, 0]


def test_instruments_are_apart():
    rows, _ = replay("A B 100 1 1; A B 200 1 2 L; A A 101 1 3 L", 1, [7, 8, 7])
    assert [(r["instrument_id"], r["bid_px_0"], r["ask_px_0"]) for r in rows] == [(8, 200, U), (7, 100, 101)]


def test_both_sides_trade_in_a_block():
    rows, stats = replay("A B 100 1 1 L; A A 101 1 2 L; T A 100 1 901; F B 100 1 1; C B 100 1 1; T B 101 1 902; F A 101 1 2; C A 101 1 2 L", 2)
    assert [(r["trade_side"], r["row_nr"]) for r in rows[-2:]] == [(1, 2), (0, 7)] and stats["mixed_side_trade_blocks"] == 1
    assert all(r["bid_px_0"] == U and r["ask_px_0"] == U for r in rows[-2:])


def test_open_block_at_the_end():
    rows, stats = replay("A B 100 1 1", 1)
    assert stats["unterminated_blocks"] == 1 and len(rows) == 1


def test_size_zero_isn_t_added():
    rows, stats = replay("A B 100 0 1 L; A B 99 1 2 L", 1)
    assert stats["zero_size_adds"] == 1 and [r["bid_px_0"] for r in rows] == [99]


def test_second_add_replaces_and_unknown_cancel_counts():
    rows, stats = replay("A B 100 5 1 L; A B 101 2 1 L; C B 100 1 999 L", 1)
    assert (stats["duplicate_adds"], stats["missing_cancels"], len(rows)) == (1, 1, 2)
    assert (rows[-1]["bid_px_0"], rows[-1]["bid_sz_0"], rows[-1]["bid_ct_0"]) == (101, 2, 1)


def test_partial_fill():
    rows, _ = replay("A B 100 5 1 L; T A 100 2 900; F B 100 2 1; C B 100 2 1 L", 1)
    assert len(rows) == 2 and (rows[-1]["trade_sz"], rows[-1]["bid_sz_0"]) == (2, 3)


def test_trade_without_change_of_the_book():
    rows, stats = replay("A B 100 5 1 L; T A 100 2 900 L; Q B 1 1 1 L", 1)
    assert len(rows) == 2 and rows[-1]["trade_sz"] == 2 and stats["unknown_actions"] == 1


def naive(events, levels):
    """Books rebuilt from their orders at the end of every block."""
    orders, last, pending, out = {}, None, [], []
    for row, a, side, price, size, order, flags in events:
        if a == "R":
            orders = {}
        elif a in "AM" and not (a == "A" and not size):
            orders.pop(order, None)
            if size:
                orders[order] = [side, price, size]
        elif a == "C" and order in orders:
            orders[order][2] -= min(size, orders[order][2])
            if not orders[order][2]:
                del orders[order]
        elif a == "T":
            pending.append(size)
        if flags & L:
            top = []
            for s, sign in (("B", -1), ("A", 1)):
                seen = {}
                for o in orders.values():
                    if o[0] == s:
                        z = seen.setdefault(o[1], [0, 0])
                        z[0] += o[2]
                        z[1] += 1
                best = sorted(seen, key=lambda p: sign * p)[:levels]
                top.append([(p, *seen[p]) for p in best] + [(U, 0, 0)] * (levels - len(best)))
            if pending or top != (last or [[(U, 0, 0)] * levels] * 2):
                out.append((row, top, sum(pending)))
            last, pending = top, []
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        a = rng.choices("AMCTFNR", [30, 15, 25, 10, 8, 2, 0.2])[0]
        rows.append((i, a, rng.choice("BA") if a != "T" else "A", 100 + rng.randrange(12), rng.randrange(6), 1 + rng.randrange(60), L * (rng.random() < 0.5)))
    return rows


def test_against_books_rebuilt_from_orders(spark, events):
    frame = spark.createDataFrame([(1, 7 + k, 1000 + e[0], e[0], e[0], *e[1:]) for k in (0, 1) for e in events], "publisher_id int, instrument_id bigint, ts_ns bigint, row_nr bigint, sequence bigint, action string, side string, price bigint, size bigint, order_id bigint, flags int")
    got = build_depth(frame.repartition(7), 3)
    rows = got.where("instrument_id = 8").orderBy("row_nr").collect()
    want = naive(events, 3)
    if not events[-1][-1] & L:
        rows = [r for r in rows if r.row_nr <= want[-1][0]]
    assert len(rows) == len(want)
    for r, (row, top, traded) in zip(rows, want, strict=True):
        assert r.row_nr == row and (r.trade_sz or 0) == traded
        assert [[(r[f"{s}_px_{i}"], r[f"{s}_sz_{i}"], r[f"{s}_ct_{i}"]) for i in range(3)] for s in ("bid", "ask")] == top
    assert got.where("instrument_id = 7").count() == got.where("instrument_id = 8").count()
    stats = book_stats(frame, 3).collect()
    assert len(stats) == 2 and all(s.rows == len(events) and s.trades_or_fills == sum(e[1] in "TFN" for e in events) for s in stats)
    assert with_context(got.where("instrument_id = 7"), frame.where("instrument_id = 7").withColumnRenamed("action", "symbol"), ["symbol"]).where("symbol is null").count() == 0


def test_empty_events(spark):
    empty = spark.createDataFrame([], "publisher_id int, instrument_id bigint, ts_ns bigint, row_nr bigint, sequence bigint, action string, side string, price bigint, size bigint, order_id bigint, flags int")
    assert build_depth(empty, 2).count() == 0 and book_stats(empty, 2).count() == 0
