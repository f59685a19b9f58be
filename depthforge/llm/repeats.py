"""Runs of W tokens that a smaller document has too: the part that word and byte operators share.

Every window of ``width`` tokens holds an anchor, its k-gram of least hash, so equal windows have equal anchors at
the same place.  Runs of windows with one anchor are what travels:

1. anchors of one document alone rule their windows out, exactly, whatever the hash (:func:`shared_anchors`);
2. the tokens themselves of the runs left are dealt out by anchor, so that all copies of a window meet
   (:func:`dealt_runs`); a batch sends each distinct run once, with the smallest document that has it, and names
   the others as its followers, so a passage in a third of all rows is one entry per batch;
3. an operator's solver compares the tokens of the runs of a block of anchors (:func:`solved`).

Anchors that very many batches send (``HOT`` entries and a tenth of their bucket: ten a bucket at most, so their list
is bounded) are dealt out by window instead of by run, so no task gets all that surrounds a common phrase.  Hashes choose tasks and candidates; what is equal is decided on the tokens.

Keys are bigint; rows with a null key are never repeats and none repeats them.  Rows of one key don't repeat each
other; where their texts differ each is judged by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthforge.llm.common import partitions, stored, text_batches

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Tokens hashed at once; longer documents are cut into overlapping segments.
SEGMENT = 1 << 18
#: Buckets a task solves one after another; what it holds at once is one bucket.
SPLIT = 3
#: Anchors, or bytes of runs, gathered before they are sent.
BATCH = 500_000
BYTES = 16_000_000
#: Entries of one anchor from which its windows are dealt out one by one, if it has this share of its bucket.
HOT, HOT_SHARE = 50_000, 0.1
#: Tokens compared at once, unless one anchor has more: few enough to stay in a core's cache.
BLOCK = 1 << 15
ORDER_BITS = U(20)
#: Rows of one key with different texts have positions this far apart.
ROW = 1 << 40

_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 19)
        _tables[:] = [np.concatenate(([U(1)], np.multiply.accumulate(np.full(size, b, U)))) for b in (BASE, INVERSE)]
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


class Hasher:
    """Hashes of any spans of a token array in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    at = 1
    while 2 * at <= width:
        a = np.minimum(a[:-at], a[at:])
        at *= 2
    return np.minimum(a[: len(a) - (width - at)], a[width - at :]) if width > at else a


@dataclass
class Shape:
    """Windows of ``width`` tokens, anchors of ``k``."""

    width: int
    k: int
    segment: int = SEGMENT


def segments(sizes: list[int], width: int, segment: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (document, from, to, first window, past the last window) of about ``segment`` tokens."""
    group, total = [], 0
    for d, n in enumerate(sizes):
        for a in range(0, n - width + 1, segment):
            lo, hi = (0, n) if n <= segment + width else (max(0, a - width), min(n, a + segment + 2 * width))
            last = n - width + 1 if n <= segment + width else min(n - width + 1, a + segment)
            if group and total + hi - lo > segment:
                yield group
                group, total = [], 0
            group.append((d, lo, hi, a, last))
            total += hi - lo
            if last == n - width + 1:
                break
    if group:
        yield group


def runs(values: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, ...]:
    """(document number, first window, number of windows, anchor hash) of the runs of windows with one anchor, in order."""
    parts = []
    for group in segments([len(v) for v in values], shape.width, shape.segment):
        v = np.concatenate([values[d][lo:hi] for d, lo, hi, _, _ in group])
        off = np.cumsum([0, *(hi - lo for _, lo, hi, _, _ in group)])
        grams = Hasher(v).windows(shape.k)
        order = (grams & ~((U(1) << ORDER_BITS) - U(1))) | np.arange(len(grams), dtype=U)
        least = sliding_min(order, shape.width - shape.k + 1) & ((U(1) << ORDER_BITS) - U(1))
        edge = np.zeros(len(least) + 1, np.int8)
        for s, (_, lo, _, first, last) in enumerate(group):
            edge[off[s] + first - lo] += 1
            edge[off[s] + last - lo] -= 1
        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        at = least[start].astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        s = np.searchsorted(off, start[head], "right") - 1
        docs, lows = np.array([g[0] for g in group])[s], np.array([g[1] for g in group])[s]
        parts.append((docs, start[head] - off[s] + lows, np.diff(np.append(head, len(start))), grams[at[head]]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


# ---------------------------------------------------------------- columns as bytes

LOW40 = U((1 << 40) - 1)


def pack_columns(columns: list[np.ndarray], planes: tuple[int, ...]) -> bytes:
    """The low ``planes`` bytes of each column, byte by byte, compressed."""
    raw = b"".join(np.ascontiguousarray(c.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8).T[:p].tobytes() for c, p in zip(columns, planes, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_columns(blob: bytes, planes: tuple[int, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, out, at = len(raw) // sum(planes), [], 0
    for p in planes:
        c = np.zeros((n, 8), np.uint8)
        c[:, :p] = raw[at : at + n * p].reshape(p, n).T
        at += n * p
        out.append(c.view("<u8").ravel())
    return out


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Mask of the first of each run of equal keys."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def first_of_run(first: np.ndarray) -> np.ndarray:
    """Index of each element's first of its run."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def run_ends(first: np.ndarray) -> np.ndarray:
    """Index of each element's last of its run."""
    return (np.append(np.flatnonzero(first)[1:], len(first)) - 1)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)


def dealt(sent: DataFrame) -> DataFrame:
    """``sent`` with SPLIT buckets in each partition, one after another, kind by kind."""
    return sent.repartitionById(partitions(sent.sparkSession), F.floor(F.col("bucket") / SPLIT).cast("int")).sortWithinPartitions("bucket", "kind")


def text_slices(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts as bytes) slices of an Arrow column of about ``most`` bytes each; null: empty."""
    if column.type == pa.binary():  # from squeezed()
        z = zstandard.ZstdDecompressor()
        values = (z.decompress(v.as_py()) for v in column)
    else:
        values = (v.as_py() or b"" for v in column.cast(pa.binary()))
    lo, total, raws = 0, 0, []
    for i, raw in enumerate(values):
        raws.append(raw)
        total += len(raw)
        if total >= most:
            yield lo, i + 1, raws
            lo, total, raws = i + 1, 0, []
    if raws:
        yield lo, lo + len(raws), raws


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts as compressed bytes, for joins that deal them out by key; null text: empty."""
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [z.compress(v.as_py() or b"") for v in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(texts, pa.binary())], names=[*(f.name for f in rest), "text"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    return text_batches(docs.select(*(f.name for f in rest), "text")).mapInArrow(run, f"{schema}, text binary")


def numbered(docs: DataFrame) -> DataFrame:
    """(key, row, text) of ``docs`` (key, text): row numbers the different texts of one key, from 0.

    Where no key has two texts, which a pass over key and text hash tells, nothing is joined.
    """
    hashed = docs.select("key", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    several = hashed.where("key is not null").groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    if not several.limit(1).count():
        return docs.select("key", F.lit(0).alias("row"), "text")
    apart = hashed.join(several.select("key"), "key").distinct().select("key", "h", (F.row_number().over(Window.partitionBy("key").orderBy("h")) - 1).alias("n"))
    return docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).join(stored(apart), ["key", "h"], "left").select("key", F.coalesce("n", F.lit(0)).alias("row"), "text")


# ---------------------------------------------------------------- anchors

Tokens = Callable[[list[bytes]], list[np.ndarray]]
ANCHORS = (5, 8, 8)  # anchor (40 bits, as differences), key, first window


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """[from, to) of each run of equal numbers."""
    at = np.flatnonzero(np.append(firsts(bucket), True)) if len(bucket) else np.zeros(0, int)
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _send_anchors(parts, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, columns): kind 0 anchors to be counted, kind 1 those of several documents of the batch.

    Of the latter the smallest and largest document are counted too, for the other batches' sake.
    """
    x, key, first = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((key, x))
    x, key, first = x[order], key[order], first[order]
    new = firsts(x)
    head, end, own = first_of_run(new), run_ends(new), np.arange(len(x))
    known = (key[head] != key[end]) & (own != head) & (own != end)
    if known.any():
        yield int(key[known][0] % buckets), 1, pack_columns([key[known].view(U), first[known].view(U)], (8, 8))
    x, key, first = x[~known], key[~known], first[~known]
    bucket = (x % U(buckets)).astype(np.int64)
    order = np.lexsort((x & LOW40, bucket))
    bucket, cols = bucket[order], [a[order] for a in (x & LOW40, key.view(U), first.view(U))]
    for a, b in _cut(bucket):
        part = [c[a:b] for c in cols]
        part[0] = np.diff(part[0], prepend=U(0))  # small, as sorted
        yield int(bucket[a]), 0, pack_columns(part, ANCHORS)


def _shared(parts, hot: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first windows) of a bucket's anchors in several documents, and the hot ones among these anchors."""
    x, key, first = (np.concatenate([p[i] for p in parts]) for i in range(3))
    key = key.view(np.int64)
    order = np.lexsort((key, x))
    x, key, first = x[order], key[order], first[order].view(np.int64)
    new = firsts(x)
    head, end = first_of_run(new), run_ends(new)
    several = key[head] != key[end]
    return key[several], first[several], x[new & several & (end - head + 1 >= max(hot, share * len(x)))]


def shared_anchors(docs: DataFrame, tokens: Tokens, shape: Shape) -> tuple[DataFrame, list[int]]:
    """(key, at): the first windows of the runs whose anchor is in several documents; and the codes of hot anchors, ten a bucket at most."""
    buckets, limits, batch_size = SPLIT * partitions(docs.sparkSession), (HOT, HOT_SHARE), BATCH

    def send(batches):
        held, n = [], 0
        for batch in batches:
            keys, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "row"))
            for lo, hi, raws in text_slices(batch.column("text")):
                d, first, _, x = runs(tokens(raws), shape)
                held.append((x, keys[lo:hi][d], first + rows[lo:hi][d].astype(np.int64) * ROW))
                n += len(x)
                if n >= batch_size:
                    yield _blobs(_send_anchors(held, buckets))
                    held, n = [], 0
        if held:
            yield _blobs(_send_anchors(held, buckets))

    def found(key, at):
        for a in range(0, len(key), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 200_000]), pa.array(at[a : a + 200_000])], names=["key", "at"])

    def bucket_rows(held, bucket):
        key, first, hot = _shared(held, *limits)
        yield from found(key, first)
        if len(hot):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), pa.array(hot.view(np.int64) + (bucket << 40))], names=["key", "at"])

    def decide(batches):
        held, current = [], None
        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
                if kind:
                    yield from found(*(c.view(np.int64) for c in unpack_columns(blob, (8, 8))))
                    continue
                if bucket != current and held:
                    yield from bucket_rows(held, current)
                    held = []
                current = bucket
                columns = unpack_columns(blob, ANCHORS)
                columns[0] = np.cumsum(columns[0])
                held.append(columns)
        if held:
            yield from bucket_rows(held, current)

    sent = text_batches(docs).mapInArrow(send, "bucket int, kind int, blob binary")
    shared = stored(dealt(sent).mapInArrow(decide, "key bigint, at bigint").groupBy("key").agg(F.collect_list("at").alias("at")), free=True, few=True)
    return shared.where("key is not null"), [x for r in shared.where("key is null").collect() for x in r["at"]]


def _blobs(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["bucket", "kind", "blob"])


# ---------------------------------------------------------------- runs of tokens

#: raw text -> function giving the bytes of its tokens [from, to)
Content = Callable[[bytes], Callable[[int, int], bytes]]
BEFORE, AFTER, FOLLOWED = 1, 2, 4
RUNS = (8, 8, 8, 4, 1, 4)  # anchor, key, first window, windows, flags, bytes
FOLLOWERS = (8, 8, 4, 8, 8)  # key, first window, windows, key and first window of the run followed


@dataclass
class Runs:
    """Entries of a bucket, sorted by anchor: their windows are ``first`` and the ``count - 1`` after it.

    flags: BEFORE, AFTER: the content has a token more on that side, of the neighbouring candidate window;
    FOLLOWED: larger documents of the batch have the same run.
    """

    x: np.ndarray
    key: np.ndarray
    first: np.ndarray
    count: np.ndarray
    flags: np.ndarray
    content: list[bytes]

    def blocks(self, sizes: np.ndarray, most: int) -> Iterator[Runs]:
        """Blocks of whole anchors of about ``most`` in size."""
        start = np.flatnonzero(firsts(self.x))
        before = np.append(np.cumsum(sizes) - sizes, sizes.sum())
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(before[np.append(start, len(self.x))], before[start[a]] + most, "right")) - 1)
            lo, hi = start[a], start[b] if b < len(start) else len(self.x)
            yield Runs(*(c[lo:hi] for c in (self.x, self.key, self.first, self.count, self.flags)), self.content[lo:hi])
            a = b


def _send_runs(held: list[tuple[int, int, int, int, int, bytes]], buckets: int) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(bucket, kind, columns, contents) of (key, first, count, flags, anchor, content): kind 0 runs, kind 1 followers of one of them."""
    held.sort(key=lambda e: e[:2])
    lead: dict[tuple[int, bytes], int] = {}
    kept, followers, followed = [], [], set()
    for e in held:
        known = lead.setdefault((e[3], e[5]), len(kept))
        if known == len(kept) or kept[known][0] == e[0]:
            kept.append(e)
        else:
            followers.append((e[0], e[1], e[2], *kept[known][:2]))
            followed.add(known)
    if followers:
        cols = [np.array(c, np.int64).view(U) for c in zip(*followers, strict=True)]
        yield int(cols[3][0] % U(buckets)), 1, pack_columns(cols, FOLLOWERS), None
    if not kept:
        return
    key, first, count, flags, x = (np.array(c, t) for c, t in zip(list(zip(*kept, strict=True))[:5], (np.int64, np.int64, np.int64, np.int64, U), strict=True))
    flags[list(followed)] |= FOLLOWED
    size = np.array([len(e[5]) for e in kept])
    bucket = (x % U(buckets)).astype(np.int64)
    order = np.lexsort((x, bucket))
    bucket, cols = bucket[order], [c[order].view(U) for c in (x, key, first, count, flags, size)]
    for a, b in _cut(bucket):
        data = zstandard.ZstdCompressor(level=3).compress(b"".join([kept[i][5] for i in order[a:b].tolist()]))
        yield int(bucket[a]), 0, pack_columns([c[a:b] for c in cols], RUNS), data


def dealt_runs(docs: DataFrame, hot: list[int], tokens: Tokens, content: Content, shape: Shape, context: bool = False) -> DataFrame:
    """(bucket, kind, columns, data): the runs with a shared anchor of ``docs`` (key, row, text, at), by anchor.

    ``context``: with the tokens before and after where the neighbouring window is a candidate too.
    """
    buckets, most, hot_codes = SPLIT * partitions(docs.sparkSession), BYTES, np.array(hot, np.int64).view(U)

    def out(held):
        cols = list(zip(*_send_runs(held, buckets), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["bucket", "kind", "columns", "data"])

    def entries(keys, rows, ats, raws):
        d, first, count, x = runs(tokens(raws), shape)
        code = d * ROW + first
        own = [a.values.to_numpy() for a in ats]
        at = np.concatenate([a[a // ROW == r] % ROW + i * ROW for i, (a, r) in enumerate(zip(own, rows, strict=True))])  # those of this row among the key's
        keep = np.isin(code, at)
        d, first, count, x = d[keep], first[keep], count[keep], x[keep]
        common = np.isin((x & LOW40) + ((x % U(buckets)) << U(40)), hot_codes)
        touch = (d[1:] == d[:-1]) & (first[1:] == first[:-1] + count[:-1])
        before, after = np.zeros(len(d), int), np.zeros(len(d), int)
        if context:
            before[1:], after[:-1] = touch, touch
        cut, cut_of = None, -1
        for i, f, n, b, a, h, xx in zip(*(c.tolist() for c in (d, first, count, before, after, common, x)), strict=True):
            if i != cut_of:
                cut, cut_of = content(raws[i]), i
            base = int(rows[i]) * ROW
            if not h:
                yield int(keys[i]), f + base, n, b * BEFORE + a * AFTER, xx, cut(f - b, f + n - 1 + shape.width + a)
                continue
            for j in range(f, f + n):
                p, q = int(context and (b or j > f)), int(context and (a or j < f + n - 1))
                yield int(keys[i]), j + base, 1, p * BEFORE + q * AFTER, xxhash.xxh64_intdigest(cut(j, j + shape.width), xx), cut(j - p, j + shape.width + q)

    def send(batches):
        held, n = [], 0
        for batch in batches:
            keys, rows, ats = batch.column("key").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False), batch.column("at")
            for lo, hi, raws in text_slices(batch.column("text")):
                for e in entries(keys[lo:hi], rows[lo:hi], ats.slice(lo, hi - lo), raws):
                    held.append(e)
                    n += len(e[5])
                    if n >= most:
                        yield out(held)
                        held, n = [], 0
        if held:
            yield out(held)

    return docs.select("key", "row", "text", "at").mapInArrow(send, "bucket int, kind int, columns binary, data binary")


FOUND = ("kind", "a", "b", "c", "d", "e")
Rows = tuple[int, tuple[np.ndarray, ...]]


def solved(sent: DataFrame, solver: Callable[[Runs], Iterator[Rows]], follow: Callable[..., Rows]) -> DataFrame:
    """(kind, a, b, c, d, e): what ``solver`` says of each bucket's runs and ``follow`` of followers' columns."""

    def batches_of(rows: Rows):
        kind, cols = rows
        cols = [*cols, *[np.zeros(len(cols[0]), np.int64)] * (5 - len(cols))]
        for a in range(0, len(cols[0]), 200_000):
            part = [pa.array(c[a : a + 200_000].astype(np.int64, copy=False)) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], names=list(FOUND))

    def solve(held):
        cols = [np.concatenate([h[0][i] for h in held]) for i in range(6)]
        content = []
        for part, data in held:
            ends = np.cumsum(part[5]).tolist()
            raw = zstandard.ZstdDecompressor().decompress(data)
            content += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        order = np.argsort(cols[0], kind="stable")
        x, key, first, count, flags = (c[order] for c in cols[:5])
        for rows in solver(Runs(x, *(c.view(np.int64) for c in (key, first, count, flags)), [content[i] for i in order.tolist()])):
            yield from batches_of(rows)

    def run(batches):
        held, current = [], None
        for batch in batches:
            for bucket, kind, columns, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "columns", "data")), strict=True):
                if kind:
                    yield from batches_of(follow(*(c.view(np.int64) for c in unpack_columns(columns, FOLLOWERS))))
                    continue
                if bucket != current and held:
                    yield from solve(held)
                    held = []
                current = bucket
                held.append((unpack_columns(columns, RUNS), data))
        if held:
            yield from solve(held)

    return dealt(sent).mapInArrow(run, "kind int, a bigint, b bigint, c bigint, d bigint, e bigint")


# ---------------------------------------------------------------- documents

#: What is removed: (key, first window, number of windows) rows.
Repeats = Callable[[DataFrame], DataFrame]


def removed(n: int, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Mask of an n-token document's tokens inside windows first to first + count - 1."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def with_repeats(docs: DataFrame, repeats: Repeats, tokens: Tokens, width: int, finish, schema: str) -> DataFrame:
    """(key, ...) for every row of ``docs`` (key, text): ``finish(raw text, token values, mask or None)`` gives the columns of ``schema``.

    ``repeats`` turns the rows (key, row, text) with a key into (key, first, count).
    """
    rows = numbered(docs)
    # all marks as one small table; the shuffles behind them can go before the texts are dealt out again
    marks = stored(repeats(rows.where("key is not null")).groupBy("key").agg(F.collect_list(F.struct("first", "count")).alias("marks")), free=True, few=True)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            marked, numbers = batch.column("marks"), batch.column("row").to_numpy(zero_copy_only=False)
            done = []
            for lo, hi, raws in text_slices(batch.column("text")):
                for raw, v, m, r in zip(raws, tokens(raws), marked.slice(lo, hi - lo), numbers[lo:hi], strict=True):
                    mask = None
                    if m.is_valid:
                        first, count = (m.values.field(i).to_numpy() for i in range(2))
                        own = first // ROW == r
                        if own.any():
                            mask = removed(len(v), first[own] % ROW, count[own], width)
                    done.append(finish(raw, v, mask))
            cols = list(zip(*done, strict=True)) if done else [()] * len(names)
            types = [f.dataType.simpleString() for f in kind.fields[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, {"bigint": pa.int64(), "string": pa.string()}[t]) for c, t in zip(cols, types, strict=True))], names=["key", *names])

    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(f"key bigint, {schema}")
    return squeezed(rows).join(marks, "key", "left").select("key", "row", "text", "marks").mapInArrow(run, kind)
