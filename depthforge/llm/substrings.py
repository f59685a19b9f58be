"""Substring dedup by De Bruijn compaction: repeated runs of words are removed where a smaller document has them.

The graph: a window of ``WIDTH`` words is an edge from the node of its first ``WIDTH - 1`` words to that of its last
ones, so an edge is a token k-mer with k = ``WIDTH`` and a repeated edge a repeated window.  Windows next to which a
text ends, or none that could be repeated follows, hang on an end of their own.  A node is simple if all its
occurrences come from one edge and go on to one edge; a path through simple nodes doesn't branch, so whatever
document has its first edge has all of it.

1. Nodes of one anchor meet in a task, as words (:mod:`depthforge.llm.repeats`); degrees are counted there, on exact
   numbers of words, and simple nodes in a row are compacted at once.  An edge is identified by the coordinates of
   its source, the first occurrence in the smallest document that has it, which are the same in the tasks of both
   its nodes.
2. The compacted pieces are joined end to end by pointer jumping, one Spark join a round.
3. A document that enters a path (at a node that isn't simple) has a repeat as long as the path, unless it is the
   path's source.  Documents that follow another one of their batch enter the paths which that one enters.

Words are runs of non-space characters, unchanged.  A word goes if a window covers it that also starts in a document
of smaller id; windows are judged on the input.  Null and empty texts and texts of fewer words than a window lose
nothing.  Repeated rows of one id don't repeat each other; ties are theirs only, as the smallest id of a class is
kept.  Very long texts are hashed in segments and dealt out run by run.  An empty table gives an empty result.  Only
the key and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.llm import repeats
from depthforge.llm.common import stored, table
from depthforge.llm.repeats import AFTER, BASE, BEFORE, FOLLOWED, Rows, Runs, Shape, U, first_of_run, firsts, mix, powers, run_ends
from depthforge.llm.suffix import ordered

WIDTH = 50
NODES = Shape(WIDTH - 1, 12)

_rng = np.random.default_rng(20240501)
LETTERS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a UTF-8 text."""
    word = ~SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_values(raws: list[bytes]) -> list[np.ndarray]:
    """A 64-bit value for each word of each text, equal for equal words."""
    out = []
    group, total = [], 0

    def hashed(group):
        joined = np.frombuffer(b" ".join(group), np.uint8)
        start, end = places(joined.tobytes())
        up, down = powers(len(joined) + 1)
        sums = np.zeros(len(joined) + 1, U)
        np.cumsum(LETTERS[joined] * up[: len(joined)], out=sums[1:])
        values = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(BASE))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in group)]))
        return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    for raw in raws:
        if group and total + len(raw) > 1 << 19:
            out += hashed(group)
            group, total = [], 0
        group.append(raw)
        total += len(raw) + 1
    return out + (hashed(group) if group else [])


def words_of(raw: bytes):
    words = raw.split()  # at the same six bytes
    return lambda lo, hi: b" ".join(words[lo:hi])


# ---------------------------------------------------------------- the graph

#: Kinds of rows that a block gives.
PIECE, ENTRY, FOLLOWER = 1, 2, 3


def names(tokens: np.ndarray, length: int) -> np.ndarray:
    """For each position a number of the ``length`` tokens from there, equal for equal ones (0 on where they end early)."""
    have, size = {1: ordered(np.zeros(len(tokens), U), tokens)[1]}, 1

    def joined(a: int, b: int) -> np.ndarray:
        later = np.zeros(len(tokens), U)
        later[:-a] = have[b][a:]
        return ordered(have[a], later)[1]

    while 2 * size <= length:
        have[2 * size] = joined(size, size)
        size *= 2
    done = size
    while done < length:
        part = max(p for p in have if p <= length - done and p <= size)
        have[done + part] = joined(done, part)
        done += part
    return have[length]


def graph_rows(runs: Runs, most: int = 4 * repeats.BLOCK) -> Iterator[Rows]:
    """Of the nodes of a bucket: (PIECE, (source key, first edge, last edge)) for compacted simple nodes and
    (ENTRY, (key, first node of the run, edge, source key, source edge)) for edges that leave other nodes and are repeated."""
    words = [c.split(b" ") for c in runs.content]
    sizes = np.array([len(w) for w in words])
    for block in Runs(runs.x, runs.key, runs.first, runs.count, runs.flags, words).blocks(sizes, most):
        number: dict[bytes, int] = {}
        own = block.content
        tokens = np.fromiter((number.setdefault(w, len(number)) for c in own for w in c), U, sum(map(len, own)))
        n, lead, tail = block.count, (block.flags & BEFORE) // BEFORE, (block.flags & AFTER) // AFTER
        size = np.array([len(c) for c in own])
        width = int(size[0] - n[0] - lead[0] - tail[0]) + 1
        name = names(tokens, width).astype(np.int64) + 1
        run = np.repeat(np.arange(len(n)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(size) - size + lead)[run] + nth
        node = name[at]
        came = np.where((nth > 0) | (lead[run] > 0), name[at - 1], 0)
        goes = np.where((nth < n[run] - 1) | (tail[run] > 0), name[np.minimum(at + 1, len(name) - 1)], 0)
        key, place, several = block.key[run], block.first[run] + nth, block.flags[run] & FOLLOWED > 0
        order = np.lexsort((place, key, goes, node))
        node, came, goes, key, place, several, run = (a[order] for a in (node, came, goes, key, place, several, run))
        new = firsts(node)
        start = np.flatnonzero(new)
        simple = np.ones(len(start), bool)
        for other in (came, goes):
            least, most = np.minimum.reduceat(other, start), np.maximum.reduceat(other, start)
            simple &= (least == most) & (least > 0)
        simple = simple[np.cumsum(new) - 1]
        edge = firsts(node, goes)
        source, last = first_of_run(edge), run_ends(edge)
        repeated = (key[source] != key[last]) | (np.maximum.reduceat(several, np.flatnonzero(edge))[np.cumsum(edge) - 1])
        # a simple node joins the edge that comes to its source's occurrence to the edge that leaves it
        s = np.flatnonzero(edge & simple & repeated)
        k, p = key[s], place[s]
        by = np.lexsort((p, k))
        k, p = k[by], p[by]
        if len(k):
            head = np.ones(len(k), bool)
            head[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)
            h = np.flatnonzero(head)
            yield PIECE, (k[h], p[h] - 1, p[np.append(h[1:], len(k)) - 1])
        e = np.flatnonzero(~simple & (goes > 0) & repeated & ((key > key[source]) | several))
        yield ENTRY, (key[e], block.first[run[e]], place[e], key[source[e]], place[source[e]])


def _follow(key, first, count, lead, lead_first) -> Rows:
    return FOLLOWER, (key, first, lead, lead_first)


def path_ends(pieces: DataFrame) -> DataFrame:
    """(k, a, b): pieces from edge a to edge b of source k, each extended by those that begin where it ends.  Pointer jumping: reach doubles with each round."""
    while True:
        nxt = pieces.select("k", F.col("a").alias("b"), F.col("b").alias("further"))
        step = stored(pieces.join(nxt, ["k", "b"], "left").select("k", "a", F.coalesce("further", "b").alias("b"), F.col("further").isNotNull().alias("moved")), few=True)
        pieces = step.select("k", "a", "b")
        if not step.where("moved").limit(1).count():
            return pieces


def repeated_spans(rows: DataFrame, shape: Shape, values=word_values, solver=graph_rows) -> DataFrame:
    """(key, first, count): windows first to first + count - 1 of a document (key, row, text) that smaller ones have too; ``shape`` is that of the nodes."""
    at, hot = repeats.shared_anchors(rows, values, shape)
    sent = repeats.dealt_runs(repeats.squeezed(rows).join(at, "key"), hot, values, words_of, shape, context=True)
    found = stored(repeats.solved(sent, solver, _follow), free=True)
    pieces = found.where(f"kind = {PIECE}").select(F.col("a").alias("k"), F.col("b").alias("a"), F.col("c").alias("b"))
    ends = path_ends(pieces).withColumnRenamed("k", "source").withColumnRenamed("a", "edge")
    entries = found.where(f"kind = {ENTRY}").select(F.col("a").alias("key"), F.col("b").alias("run"), F.col("c").alias("first"), F.col("d").alias("source"), F.col("e").alias("edge"))
    entries = stored(entries.join(ends, ["source", "edge"], "left").select("key", "run", "first", "source", (F.coalesce("b", "edge") - F.col("edge") + 1).alias("count")), few=True)
    followers = found.where(f"kind = {FOLLOWER}").select(F.col("a").alias("follower"), F.col("b").alias("its_run"), F.col("c").alias("key"), F.col("d").alias("run"))
    theirs = followers.join(entries, ["key", "run"]).select(F.col("follower").alias("key"), (F.col("its_run") + F.col("first") - F.col("run")).alias("first"), "count")
    return entries.where("key > source").select("key", "first", "count").unionByName(theirs)


# ---------------------------------------------------------------- results


def _kept(raw: bytes, mask: np.ndarray | None) -> str:
    if mask is None:
        return b" ".join(raw.split()).decode()
    start, end = places(raw)
    return b" ".join(raw[a:b] for a, b in zip(start[~mask].tolist(), end[~mask].tolist(), strict=True)).decode()


def _texts(raw: bytes, values: np.ndarray, mask: np.ndarray | None):
    return len(values), 0 if mask is None else int(mask.sum()), _kept(raw, mask)


def _digest(raw: bytes, values: np.ndarray, mask: np.ndarray | None):
    n, gone, kept = _texts(raw, values, mask)
    return n, gone, hashlib.sha256(kept.encode()).hexdigest()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", nodes: Shape = NODES, digest: bool = False, values=word_values, solver=graph_rows) -> DataFrame:
    """(key, n_words, n_removed, text): the words left, joined by one space; ``digest``: their kept_sha256 instead.

    ``nodes``: their words (a window has one more) and those of their anchors; ``values`` hashes words, ``solver`` compares runs.
    """
    slim = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    last, finish = ("kept_sha256", _digest) if digest else ("text", _texts)
    return repeats.with_repeats(slim, lambda rows: repeated_spans(rows, nodes, values, solver), word_values, nodes.width + 1, finish, f"n_words bigint, n_removed bigint, {last} string").withColumnRenamed("key", key)


def op3(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN sha256(array_to_string(w[i:i + 49], ' ')) END AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT *, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS again FROM p),
c AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 50, false) AS gone FROM f)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(c.i) FILTER (c.gone) AS n_removed, sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (NOT c.gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
