"""Best-fit packing of tokenised documents by bin completion on the histogram of piece lengths.

Pieces of equal length are interchangeable, so what is packed is the histogram: at most ``size`` lengths with
counts, whatever the number of documents.  The driver solves that bounded problem; executors tokenise, rank
pieces within their length and look their places up in the solution (a table bounded by ``size``).

The solver takes the largest length left and enumerates undominated fillings of the rest of its sequence,
least waste first; a filling is used as often as the counts allow.  Branches are pruned when the sequences
used plus the bound on the rest (total length over size) don't beat the incumbent, which starts as the
best-fit-decreasing solution of the same histogram.  Search effort is a parameter; every piece is placed
whatever it is, and :func:`pack` gives the lower bound beside each place, so a packing that isn't proven least shows.

Null and empty texts are one token (the end mark).  Repeated rows are packed once per row.  Ties: equal
pieces get places in the order of (key, piece).  Very long texts are tokenised whole and cut.  An empty table gives
an empty result.  Only the key and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthforge.llm.common import stored, table, text_batches

SIZE = 2048
END = 0
#: Branch-and-bound effort: steps per search of fillings, fillings tried per sequence and branchings per packing.
FILL_STEPS = 400
FILLINGS = 3
BRANCHINGS = 20_000
#: Pieces ranked in one task; a length with more is dealt over several.
RANKED = 100_000

# ---------------------------------------------------------------- tokens

#: Where the pre-tokeniser's letter and number classes may differ between Unicode versions.
UNSTABLE = re.compile("[^\x00-ɏ]")
_encoders: dict = {}


def _encoder(path: str, ranks: str | None):
    """text -> ids.  The byte-level ranks give the same ids as the tokeniser file, several times as fast; it is used on text of stable character classes without a special token."""
    if (path, ranks) not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = re.compile("|".join(re.escape(t.content) for t in slow.get_added_tokens_decoder().values()) or "(?!)")

        def plain(text):
            return slow.encode(text, add_special_tokens=False).ids

        encode = plain
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary

            def encode(text):
                return plain(text) if UNSTABLE.search(text) or special.search(text) else fast(text)

        _encoders[path, ranks] = encode
    return _encoders[path, ranks]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n - (n - 1) // size * size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenised(docs: DataFrame, size: int = SIZE, tokenizer: tuple[str, str | None] | None = None, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) per piece."""
    path, ranks = tokenizer or default_tokenizer()
    wanted = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    kind = wanted.schema["key"].dataType.simpleString()

    def run(batches):
        encode = _encoder(path, ranks)
        for batch in batches:
            rows, pieces, starts, lengths, sums, ids_out = [], [], [], [], [], []
            for r, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    rows.append(r)
                    pieces.append(k)
                    starts.append(s)
                    lengths.append(n)
                    sums.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if with_ids:
                        ids_out.append(ids[s : s + n].astype(np.int32))
            cols = [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return text_batches(wanted).mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- solver

Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, how many such sequences


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram; bins of equal content move together."""
    groups: dict[int, list[list]] = {}  # space left: [content, times]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = min((s for s in groups if s >= length), default=None)
            if space is None:
                fit = size // length
                if left >= fit:
                    groups.setdefault(size - fit * length, []).append([(length,) * fit, left // fit])
                if left % fit:
                    groups.setdefault(size - left % fit * length, []).append([(length,) * (left % fit), 1])
                break
            content, times = groups[space].pop()
            if not groups[space]:
                del groups[space]
            fit = space // length
            whole = min(times, left // fit)
            if whole:
                groups.setdefault(space - fit * length, []).append([content + (length,) * fit, whole])
                left -= whole * fit
                times -= whole
            if times and left and left < fit:
                groups.setdefault(space - left * length, []).append([content + (length,) * left, 1])
                left, times = 0, times - 1
            if times:
                groups.setdefault(space, []).append([content, times])
    return [(tuple(c), t) for g in groups.values() for c, t in g]


def fillings(counts: dict[int, int], order: list[int], gap: int, want: int, steps: int) -> list[tuple[int, ...]]:
    """Up to ``want`` undominated fillings of ``gap``, least waste first; ``order``: available lengths ascending.

    Larger lengths come first, so of fillings with one sum the one of fewer, larger pieces is met first.  A
    filling is dominated if a piece can be swapped for a longer one left over, or two for one as long as both.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    worst = gap + 1
    budget = steps
    used: dict[int, int] = {}

    def spare(x: int) -> bool:
        return counts.get(x, 0) - used.get(x, 0) > 0

    def dominated(fill: list[int], waste: int) -> bool:
        if any(spare(y) for x in set(fill) for y in range(x + 1, x + waste + 1)):
            return True
        return any(spare(a + b) for i, a in enumerate(fill) for b in fill[i + 1 :])

    def search(space: int, top: int, fill: list[int]):
        nonlocal worst, budget
        i = bisect_right(order, min(space, top)) - 1
        stuck = True
        while i >= 0 and budget > 0 and not (len(found) >= want and worst == 0):
            x = order[i]
            i -= 1
            if not spare(x):
                continue
            stuck = False
            budget -= 1
            used[x] = used.get(x, 0) + 1
            fill.append(x)
            search(space - x, x, fill)
            fill.pop()
            used[x] -= 1
        if stuck and (space < worst or len(found) < want) and not dominated(fill, space):
            found.append((space, tuple(fill)))
            found.sort(key=lambda f: f[0])
            del found[want:]
            worst = found[-1][0]

    search(gap, gap, [])
    return [f for _, f in found]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: for the total length, and for pieces of which no two share one."""
    return max(-(-sum(k * v for k, v in counts.items()) // size), sum(v for k, v in counts.items() if 2 * k > size))


def bin_completion(counts: dict[int, int], size: int, fill_steps: int = FILL_STEPS, branchings: int = BRANCHINGS, want: int = FILLINGS) -> list[Pattern]:
    """The packing as patterns with their numbers of use; proven least if it uses :func:`lower_bound` sequences."""
    counts = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= size for k in counts):
        raise ValueError("lengths are from 1 to size")
    incumbent = best_fit(counts, size)
    best = sum(t for _, t in incumbent)
    least = lower_bound(counts, size)
    left, rest, bins = dict(counts), sum(k * v for k, v in counts.items()), 0
    order = sorted(left)
    path: list[tuple[Pattern, list]] = []

    def take(pattern: tuple[int, ...], times: int, sign: int):
        nonlocal rest, bins
        for x in pattern:
            if sign < 0 and left[x] == 0:
                order.insert(bisect_right(order, x), x)
            left[x] -= sign * times
            if sign > 0 and left[x] == 0:
                order.pop(bisect_right(order, x) - 1)
        rest -= sign * times * sum(pattern)
        bins += sign * times

    while best > least and branchings > 0:
        branchings -= 1
        options = []
        if not order:
            if bins < best:
                best, incumbent = bins, [p for p, _ in path]
        elif bins + -(-rest // size) < best:
            x = order[-1]
            left[x] -= 1
            if left[x] == 0:
                order.pop()
            fills = fillings(left, order, size - x, want, fill_steps) or [()]
            if left[x] == 0:
                order.append(x)
            left[x] += 1
            options = [(x, *f) for f in fills]
        while not options and path:
            (pattern, times), options = path.pop()
            take(pattern, times, -1)
        if not options:
            break
        pattern = options[0]
        times = min(left[x] // pattern.count(x) for x in set(pattern))
        take(pattern, times, 1)
        path.append(((pattern, times), options[1:]))
    return incumbent


# ---------------------------------------------------------------- places


def pack(docs: DataFrame, size: int = SIZE, tokenizer=None, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset, least_sequences[, ids]): every piece of every row of ``docs`` in its place."""
    spark = docs.sparkSession
    pieces = stored(tokenised(docs, size, tokenizer, key, with_ids))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    places, first, given = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in bin_completion(counts, size):
        offset = 0
        for x in pattern:
            places.append((x, given[x], given[x] + times, first - given[x], offset))
            given[x] += times
            offset += x
        first += times
    plan = F.broadcast(spark.createDataFrame(places, "p_length bigint, lo bigint, hi bigint, base bigint, offset bigint"))
    deal = max(8, sum(counts.values()) // RANKED)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(deal)))
    by_bucket = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = by_bucket.select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece")) - 1
    ranked = dealt.withColumn("rank", rank).join(before, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("rank", F.col("rank") + F.col("before"))
    out = ranked.join(plan, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("sequence_id"), "offset", F.lit(lower_bound(counts, size)).cast("bigint").alias("least_sequences"), *(["ids"] if with_ids else []))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
