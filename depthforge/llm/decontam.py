"""Benchmark decontamination with broadcast sets of normalised test n-grams.

Words are maximal runs of letters, digits and non-ASCII characters after A-Z is lower-cased.  A test
item's windows are its runs of 13 consecutive words; an item with fewer words is one window.  A document
word inside any occurrence of a window is hit.

The test windows travel to the executors as a broadcast set.  Its size is checked: items are dealt into
blocks of at most ``block_words`` words (longer items are cut), each block is broadcast by itself, and a task
holds one at a time, so that its memory doesn't grow with the benchmark.  A row's result doesn't depend on the
blocks.  Documents are never shuffled.

Null and empty texts have no words and no hits; null item texts have no windows; a null item_id is skipped.
Repeated items keep their own ids, repeated rows and ties are judged row by row, null keys stay.  Very long texts
are scanned whole.  Without benchmark items nothing is hit; an empty table gives an empty result.  Further columns
of the documents are kept, those of the benchmark ignored, also where their names clash.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import fresh, table, text_batches

WINDOW = 13
#: Words of benchmark text per broadcast block (some 100 MB of Python objects).
BLOCK_WORDS = 2_000_000

#: All bytes but 00-2F, 3A-60 and 7B-7F; on UTF-8 this takes whole code points.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal_words(text: str | bytes | None) -> list[bytes]:
    text = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(text.translate(LOWER))


def window_sets(items: list[tuple[str, str | None]], window: int = WINDOW):
    """Vocabulary and, by window length, {window of word numbers: item ids}."""
    vocab: dict[bytes, int] = {}
    sets: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab)) for w in normal_words(text)]
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1 if n else 0):
            sets[n][tuple(ids[i : i + n])].add(item)
    return vocab, {n: dict(s) for n, s in sets.items()}


class Scanner:
    """Finds occurrences of one block's windows in texts."""

    def __init__(self, vocab: dict, sets: dict):
        self.vocab, self.sets = vocab, sets
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 2**63, size=len(vocab) + 1, dtype=np.uint64) | np.uint64(1)
        self.known = {n: np.sort(np.array([self._hash(np.array(k))[0] for k in s], dtype=np.uint64)) for n, s in sets.items()}

    def _hash(self, ids: np.ndarray, n: int = 0) -> np.ndarray:
        """Hash of each window of n words (0: of the whole)."""
        n = n or len(ids)
        v = self.mix[ids]
        m = len(ids) - n + 1
        h = np.zeros(m, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + v[j : j + m]
        return h

    def hits(self, found: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Mask of hit words (None: none) and the items that occur."""
        if not self.vocab or not found:
            return None, set()
        ids = np.fromiter(map(self.vocab.get, found, [-1] * len(found)), dtype=np.int64, count=len(found))
        unknown = np.flatnonzero(ids < 0)
        bounds = np.concatenate(([-1], unknown, [len(ids)]))
        mask, items = None, set()
        longest = np.diff(bounds) - 1
        for n, windows in self.sets.items():
            for r in np.flatnonzero(longest >= n):
                a, b = bounds[r] + 1, bounds[r + 1]
                run = ids[a:b]
                h = self._hash(run, n)
                known = self.known[n]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for i in np.flatnonzero(known[at] == h):
                    got = windows.get(tuple(run[i : i + n].tolist()))
                    if got:
                        if mask is None:
                            mask = np.zeros(len(ids), dtype=bool)
                        mask[a + i : a + i + n] = True
                        items |= got
        return mask, items


def _blocks(benchmark: DataFrame, block_words: int, window: int):
    """Blocks of (item id as text, words as text), each of about block_words words; longer items are cut into parts that share a window less a word."""
    block, n, most = [], 0, max(block_words, window)
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null").toLocalIterator():
        every = normal_words(row.t)
        for a in range(0, max(1, len(every) - window + 1), most):
            part = every[a : a + most + window - 1]
            if block and n + len(part) > block_words:
                yield block
                block, n = [], 0
            block.append((row.i, b" ".join(part)))
            n += len(part)
    yield block


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, text: str, added: list[str], cut: bool = False) -> DataFrame:
    """``docs`` with columns named as ``added``: the number of words, hits (start, end pairs of runs of hit words, flattened) and items; ``cut``: without the hit runs in its texts.

    A task scans each batch of rows for one block of windows after another, and holds one block at a time if
    there are several.  Rows stay where they are.
    """
    values = [docs.sparkSession.sparkContext.broadcast(window_sets(b, window)) for b in _blocks(benchmark, block_words, window)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)
    large = docs.schema[text].dataType.simpleString() != "string"

    def run(batches):
        scanner = Scanner(*values[0].value) if len(values) == 1 else None
        for batch in batches:
            raws = [t.as_py() for t in batch.column(at).cast(pa.string()).cast(pa.binary())]
            masks: list[np.ndarray | None] = [None] * len(raws)
            items: list[set] = [set() for _ in raws]
            n_words = [0] * len(raws)
            for value in values:
                own = scanner or Scanner(*value.value)
                for i, raw in enumerate(raws):
                    found = normal_words(raw)
                    mask, got = own.hits(found)
                    n_words[i] = len(found)
                    items[i] |= got
                    if mask is not None:
                        masks[i] = mask if masks[i] is None else masks[i] | mask
                if not scanner:
                    value.__dict__.pop("_value", None)  # read again for the next batch
            hits = [[] if m is None else np.flatnonzero(np.diff(np.concatenate(([0], m.view(np.int8), [0])))).astype(np.int32).tolist() for m in masks]
            columns = list(batch.columns)
            if cut:
                columns[at] = pa.array([None if r is None else remove_spans(r, h) if h else r.decode() for r, h in zip(raws, hits, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                names=[*batch.schema.names, *added],
            )

    if large:
        docs = docs.withColumn(text, F.col(text).cast("string"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return text_batches(docs).mapInArrow(run, f"{schema}, " + ", ".join(f"`{a}` {t}" for a, t in zip(added, ("bigint", "array<int>", "array<string>"), strict=True)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, hits, items) for every row of ``docs``; hits are [start, end) pairs of word positions, flattened.  One pass, no shuffle."""
    slim = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return _scan(slim, benchmark, window, block_words, "text", ["n_words", "hits", "items"])[[key, "n_words", "hits", "items"]]


def _n_hit(hits: str) -> F.Column:
    """Words in the [start, end) pairs of an array."""
    return F.aggregate(hits, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("sign")), lambda s, x: F.struct((s.n + s.sign * x).alias("n"), (-s.sign).alias("sign")), lambda s: s.n)


def _contaminated(n_hit: F.Column, n_words: str) -> F.Column:
    return (n_hit > 0) & (20 * n_hit >= F.col(n_words))


def decide(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns: n_hit, n_items, items_sha256 and contaminated (at least 1 word in 20 is hit)."""
    return found.select(
        key, "n_words", _n_hit("hits").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "items",
    ).withColumn("contaminated", _contaminated(F.col("n_hit"), "n_words"))


def remove_spans(raw: bytes, hits: list[int]) -> str:
    """A text without the characters from each hit run's first word to its last."""
    places = [m.span() for m in WORD.finditer(raw.translate(LOWER))]
    out, at = [], 0
    for a, b in zip(*[iter(hits)] * 2, strict=True):
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows (mode "document") or with the hit spans cut out of the texts ("span").  Each row is judged by itself; keys aren't looked at."""
    if mode not in ("document", "span"):
        raise ValueError("mode is document or span")
    added = fresh(docs.columns, "_n_words", "_hits", "_items")
    found = _scan(docs, benchmark, window, block_words, text, added, mode == "span")
    if mode == "document":
        found = found.where(~_contaminated(_n_hit(added[1]), added[0]))
    return found.select(docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decide(found).drop("items")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n)),
hits AS (SELECT s.doc_id, s.n, s.i, win.item FROM spots s JOIN win ON win.n = s.n AND win.k = s.k),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
