"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from depthforge.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, node string, grp int, at string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return sha("".join(field(v) for v in (*row[:4], text)))


def tree(nodes):
    """(root, per node the list of (left, right)) by hashing runs of three."""
    paths, level, spot = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for p, i in zip(paths, spot, strict=True):
            a = i // 3 * 3
            p.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        level, spot = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)], [i // 3 for i in spot]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        inner[s] = own, *tree([leaf(r, r[4]) for r in own])
    root, outer = tree([inner[s][1] for s in names])
    out = []
    for s, top in zip(names, outer, strict=True):
        own, subroot, paths = inner[s]
        for r, p in zip(own, paths, strict=True):
            cut = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            h = leaf(r, cut)
            for a, b in [*p, *top]:
                h = sha(a + h + b)
            out.append((r[0], leaf(r, r[4]), subroot, root, sha("".join(a + b for a, b in [*p, *top])), h, h == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "node", 7, "at") for r in rows], SCHEMA).repartition(3)


def run(spark, rows):
    docs = frame(spark, rows)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    m = manifest.manifest(docs, tampered=F.translate("text", "\n", ""), where=even)
    folded = manifest.fold(F.coalesce("other", "leaf"), F.col("path"))
    got = m.select("key", "leaf", "subroot", "root", manifest.digest(manifest.siblings(F.col("path"))), folded, folded == F.col("root"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(sizes):
    out, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((k * 7 % 1009 - 300, source, "en" if k % 3 else None, k if k % 5 else None, ["a\nb", "", None, "é😀\n", "x" * 3000][k % 5]))
            k += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_tree(spark, monkeypatch, levels):
    """Blocks of 3, 9 and 729 leaves; groups of one leaf, of full and of ragged runs; a hot, a null and an empty source."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = rows_of({"hot": 91, None: 10, "": 1, "b": 3, "é": 9, "z": 27, "zz": 28, "a": 4})
    assert run(spark, rows) == brute(rows)


def test_repeats(spark, monkeypatch):
    """Null keys, one key for many rows, rows alike in everything, and the joins beyond the broadcast bounds."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BROADCAST_OFFSETS", 0)
    monkeypatch.setattr(manifest, "BROADCAST_GROUPS", 0)
    rows = [(None, "s", None, None, None)] * 5 + [(1, "s", "en", 3, "x\ny")] * 7 + [(2, "t", "en", 3, t) for t in ("b\n", "a\n", "b\n")] + [(k, None, "de", 1, "q") for k in range(4)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    one = [(4, "s", "en", 1, "only\n")]
    got = run(spark, one)
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3]
    long = [(k, "s", "en", 1, "line\n" * 300_000) for k in (1, 4)]
    assert run(spark, long) == brute(long)


def test_values_dont_flow(spark):
    """("ab", "c") and ("a", "bc") are different leaves, and so are null and '-'."""
    got = {r[1] for r in run(spark, [(1, "s", "ab", 1, "c"), (1, "s", "a", 1, "bc"), (1, "s", None, 1, "c"), (1, "s", "-", 1, "c")])}
    assert len(got) == 4


def test_blocks_are_bounded(spark):
    nodes = manifest.ranked(spark.range(5000).select(F.lit("g").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("node")), ["key"])
    assert [r.at for r in nodes.orderBy("key").collect()] == list(range(5000))
    assert manifest.blocks(nodes, ["key"]).agg(F.max(F.size("items"))).head()[0] == 729
