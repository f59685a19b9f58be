"""Suffix-array dedup: bytes inside 50-byte strings that a smaller document has too are removed.

Texts are cut into runs of windows that share an anchor, and runs whose anchor several documents have meet by
anchor, as bytes (:mod:`depthforge.llm.repeats`).  A task joins the runs of a block of anchors, builds their suffix
array and Burrows-Wheeler transform, and expands all intervals backwards, breadth first: the intervals of level l
are the strings of l bytes, and a step back by every byte at once gives those of level l + 1.  A border that first
appears at a level lies between suffixes whose common prefix is one byte shorter, so common prefixes come out by
increasing value, and the expansion stops at the window's length.  The intervals left are the classes of equal
windows; those of any document but a class's smallest are repeats.  No hash decides what is equal.

Texts are UTF-8 bytes, matches never cross documents, windows are judged on the input.  Null and empty texts and
texts of fewer bytes than a window lose nothing.  Repeated rows of one id don't repeat each other; ties are theirs
only, as the smallest id of a class is kept.  Very long texts are hashed in segments and dealt out run by run.  An
empty table gives an empty result.  Only the key and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.llm import repeats
from depthforge.llm.common import table
from depthforge.llm.repeats import Rows, Runs, Shape, U

WIDTH = 50
SHAPE = Shape(WIDTH, 20)
#: A byte that UTF-8 never has: it ends each run.
STOP = 0xFF
_rng = np.random.default_rng(20240502)
BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def byte_values(raws: list[bytes]) -> list[np.ndarray]:
    return [BYTES[np.frombuffer(r, np.uint8)] for r in raws]


def bytes_of(raw: bytes):
    return lambda lo, hi: raw[lo:hi]


PLACE = U(20)


def ordered(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of numbers and the rank of each pair, equal pairs having equal ranks; both below 2^20 if there are no more pairs than that."""
    n = len(major)
    if n <= 1 << PLACE:
        both = np.sort((major << U(2 * PLACE)) | (minor << PLACE) | np.arange(n, dtype=U))
        order, value = (both & ((U(1) << PLACE) - U(1))).astype(np.int64), both >> PLACE
        change = value[1:] != value[:-1]
    else:
        order = np.lexsort((minor, major))
        change = (major[order][1:] != major[order][:-1]) | (minor[order][1:] != minor[order][:-1])
    rank = np.empty(n, U)
    rank[order] = np.concatenate(([0], np.cumsum(change))).astype(U)[:n]
    return order, rank


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a byte array by their first ``depth`` bytes at least, by prefix doubling from 5 bytes."""
    n = len(s)
    padded = np.concatenate((s, np.full(5, STOP, np.uint8))).astype(U)
    high = (padded[:n] << U(8)) | padded[1 : n + 1]
    low = (padded[2 : n + 2] << U(16)) | (padded[3 : n + 3] << U(8)) | padded[4 : n + 4]
    order, rank = ordered((high << U(4)) | (low >> U(20)), low & U(0xFFFFF))
    step = 5
    while step < depth:
        later = np.zeros(n, U)
        later[:-step] = rank[step:]
        order, rank = ordered(rank, later)
        step *= 2
    return order


def window_classes(s: np.ndarray, length: int) -> np.ndarray:
    """For each position of ``s`` the number of the interval of its first ``length`` bytes: equal numbers, equal strings.

    Strings with a STOP in them equal nothing; ``s`` ends with one.
    """
    order = suffix_array(s, length)
    before = s[order - 1]  # the transform; the first suffix has the last byte before it, a STOP
    back = np.argsort(before, kind="stable").astype(np.int32)  # the row from which a step back leads to each row
    byte = before[back]
    apart = np.ones(len(s), bool)
    apart[1:] = (byte[1:] != byte[:-1]) | (byte[1:] == STOP)
    border = apart.copy()  # of the intervals of one byte
    for _ in range(length - 1):
        interval = np.cumsum(border, dtype=np.int32)[back]
        np.not_equal(interval[1:], interval[:-1], out=border[1:])
        border |= apart
        if border.all():
            break
    out = np.empty(len(s), np.int32)
    out[order] = np.cumsum(border, dtype=np.int32) - 1
    return out


def repeated_windows(runs: Runs, block: int = repeats.BLOCK, classes=window_classes) -> Iterator[Rows]:
    """(0, (key, first window, windows)) of the windows that a smaller document has too."""
    size = np.array([len(c) + 1 for c in runs.content])
    for part in runs.blocks(size, block):
        once: dict[bytes, int] = {}  # equal runs enter the transform once
        which = np.array([once.setdefault(c, len(once)) for c in part.content])
        text = np.frombuffer(bytes([STOP]).join([*once, b""]), np.uint8)
        start = np.cumsum([0, *(len(c) + 1 for c in once)])[which]
        n = part.count
        entry = np.repeat(np.arange(len(n)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = len(part.content[0]) - int(n[0]) + 1
        number = classes(text, width)[start[entry] + nth]
        least = np.full(number.max() + 1, np.iinfo(np.int64).max)
        key = part.key[entry]
        np.minimum.at(least, number, key)
        at = np.flatnonzero(key > least[number])
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (entry[at[1:]] != entry[at[:-1]])
        head = np.flatnonzero(new)
        yield 0, (key[at[head]], part.first[entry[at[head]]] + nth[at[head]], np.diff(np.append(head, len(at))))


def _follow(key, first, count, lead, lead_first) -> Rows:
    """A run that a smaller document of its batch has too is repeated as a whole."""
    return 0, (key, first, count)


def _digest(raw: bytes, values: np.ndarray, mask: np.ndarray | None):
    if mask is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
    return len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()


def _texts(raw: bytes, values: np.ndarray, mask: np.ndarray | None):
    """As :func:`_digest`, with what is left as text; parts of characters, as bytes are cut, are left out."""
    n, gone, spans, _ = _digest(raw, values, mask)
    return n, gone, spans, (raw if mask is None else np.frombuffer(raw, np.uint8)[~mask].tobytes()).decode("utf-8", "ignore")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = SHAPE, digest: bool = False, values=byte_values, solver=repeated_windows) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, text): the bytes left; ``digest``: their kept_sha256 instead.  ``values`` hashes the bytes, ``solver`` compares runs."""
    slim = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))

    def found(rows: DataFrame) -> DataFrame:
        at, hot = repeats.shared_anchors(rows, values, shape)
        sent = repeats.dealt_runs(repeats.squeezed(rows).join(at, "key"), hot, values, bytes_of, shape)
        return repeats.solved(sent, solver, _follow).select(F.col("a").alias("key"), F.col("b").alias("first"), F.col("c").alias("count"))

    last, finish = ("kept_sha256", _digest) if digest else ("text", _texts)
    return repeats.with_repeats(slim, found, byte_values, shape.width, finish, f"n_bytes bigint, n_removed bigint, n_spans bigint, {last} string").withColumnRenamed("key", key)


def op7(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
