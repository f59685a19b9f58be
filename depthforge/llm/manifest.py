"""Merkle manifest of a dataset, with a proof for each row.

A leaf is the hash of a row's values.  The leaves of a group, in order, are hashed in runs of ``FAN``, level by level,
to the group's subroot, and the subroots in the same way to the root.

Leaves are ranked by a range partitioning, so a group may hold any share of the rows: it is dealt over the ranges, and
the counts of (group, range) give the ranks.  Ranks cut each group into blocks of ``FAN ** LEVELS`` leaves.  A block is
one row, an array of digests that ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse level by level; the
roots of the blocks are the leaves of the next round, a few hundred times fewer.  Proofs go the other way: a block gets
the steps from its root on by one join of block rows, its leaves put their own steps in front.

Null values count as ``-``; a null group is a group of its own, the first; null keys come first in their group.  Rows
that are alike in the key are ordered by their leaf, and rows alike in all values are interchangeable: each is a leaf.
Texts are hashed whole, an empty text as ``0:``.  An empty table has no leaves and no root.  Further columns are not
read unless named in ``fields``.  Numbers are written as decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthforge.llm.common import partitions, stored, table

FAN = 3
#: Levels of a block: 729 leaves.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that are broadcast at most: offsets are some 40 bytes, the steps of a group 200 a level.
BROADCAST_OFFSETS = 200_000
BROADCAST_GROUPS = 20_000
SALTS = 16


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def field(x: Column) -> Column:
    """A value with its length in front, so that neighbouring values can't flow into each other."""
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*(field(c) for c in fields)))


# ---------------------------------------------------------------- ranks


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``at``, the position in ``grp`` along ``order``, and ``n``, the leaves of ``grp``.

    Rows alike in ``order`` are dealt over the ranges by the task that reads them.
    """
    dealt = nodes.withColumn("_task", F.spark_partition_id())
    ranges = dealt.repartitionByRange(partitions(nodes.sparkSession), "grp", *order, "_task").sortWithinPartitions("grp", *order, "_task")
    spot = stored(ranges.drop("_task").withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)))
    counts = spot.groupBy("grp", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    w = Window.partitionBy("grp")
    before = F.sum("_rows").over(w.orderBy("_range")) - F.col("_rows")
    offsets = stored(counts.select("grp", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(w).alias("n")), few=True)
    small = offsets.count() <= BROADCAST_OFFSETS
    return spot.join(F.broadcast(offsets) if small else offsets, ["grp", "_range"]).withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


# ---------------------------------------------------------------- blocks


def collapsed(leaves: Column, depth: Column) -> Column:
    """The levels of a block: its leaves, the digests of their runs, and so on ``depth`` times."""

    def up(levels: Column) -> Column:
        last = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / FAN).cast("int"))
        return F.concat(levels, F.array(F.transform(runs, lambda i: digest(F.array_join(F.slice(last, i * FAN + 1, FAN), "")))))

    return F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= depth), F.array(leaves), lambda levels, _: up(levels))


def steps(levels: Column, i: Column, depth: Column) -> Column:
    """The siblings left and right of leaf ``i`` and of its ancestors, below the root of the block."""

    def step(k: Column) -> Column:
        nodes, at = F.element_at(levels, k), F.floor(i / F.pow(F.lit(float(FAN)), k - 1)).cast("int")
        own = at % FAN
        return F.struct(F.array_join(F.slice(nodes, at - own + 1, own), "").alias("left"), F.array_join(F.slice(nodes, at + 2, FAN - 1 - own), "").alias("right"))

    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= depth), step)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """A row per block of ranked ``nodes`` (grp, at, n, node): (grp, block, n, depth, items, levels), written."""
    size = FAN**LEVELS
    item = F.struct("at", "node", *carried)
    rows = nodes.groupBy("grp", "n", F.floor(F.col("at") / size).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    # a group of one block ends at its root; else each of its blocks has all levels
    own = F.size(F.filter(F.array(*(F.lit(FAN**k) for k in range(LEVELS))), lambda p: p < F.col("n")))
    rows = rows.withColumn("depth", F.when(F.col("n") > size, F.lit(LEVELS)).otherwise(own))
    return stored(rows.withColumn("levels", collapsed(F.transform("items", lambda x: x["node"]), F.col("depth"))))


def spread(rows: DataFrame, *tails: str, keep: Sequence[str] = ()) -> DataFrame:
    """(grp, item, path[, keep]): the nodes of blocks with their steps in the block and the ``tails`` of the block."""
    path = lambda i: F.concat(steps(F.col("levels"), i, F.col("depth")), *(F.col(t) for t in tails))
    each = F.transform("items", lambda x, i: F.struct(x.alias("item"), path(i).alias("path")))
    return rows.select("grp", *keep, F.explode(each).alias("_x")).select("grp", *keep, "_x.item", "_x.path")


def above(rows: DataFrame) -> DataFrame:
    """(grp, block, above, subroot): the steps from a block's root to its group's subroot."""
    size = FAN**LEVELS
    tops = rows.select("grp", F.col("block").alias("at"), F.ceil(F.col("n") / size).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
    if not rows.where(F.col("n") > size).limit(1).count():
        return tops.select("grp", F.col("at").alias("block"), F.array().cast("array<struct<left:string,right:string>>").alias("above"), F.col("node").alias("subroot"))
    upper = blocks(tops)
    far = spread(upper.join(above(upper), ["grp", "block"]), "above", keep=["subroot"])
    return stored(far.select("grp", F.col("item.at").alias("block"), F.col("path").alias("above"), "subroot"), few=True)


def proofs(nodes: DataFrame, order: Sequence[str], carried: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(blocks with ``above`` and ``subroot``, (grp, subroot) per group) of ``nodes`` (grp, node, further columns)."""
    rows = blocks(ranked(nodes, order), carried)
    heads = above(rows)
    return rows.join(heads, ["grp", "block"]), heads.where("block = 0").select("grp", "subroot")


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, tampered: Column | None = None, text: str = "text", where: Column | None = None) -> DataFrame:
    """(key, grp, leaf, subroot, root, path, other): a row's leaf, the steps from it to the root, and what its leaf would be.

    ``grp`` is (known, value) of the group.  ``other`` is the leaf with ``tampered`` in place of ``text``, null for rows
    that ``where`` doesn't name.  ``fold(leaf, path)`` is the root, and ``fold(other, path)`` isn't if they differ.
    """
    cols = [F.col(c) for c in fields]
    changed = leaf([tampered if c == text else F.col(c) for c in fields]) if tampered is not None else F.lit(None).cast("string")
    other = F.when(where, changed) if where is not None else changed
    grp = F.struct(F.col(group).isNotNull().alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("value"))
    leaves = rows.select(F.col(key).alias("key"), grp.alias("grp"), leaf(cols).alias("node"), other.alias("other"))
    each, subroots = proofs(leaves, ["key", "node"], ["key", "other"])
    one = F.struct(F.lit(True).alias("known"), F.lit("").alias("value"))
    tops, _ = proofs(subroots.select(F.col("grp").alias("name"), one.alias("grp"), F.col("subroot").alias("node")), ["name"], ["name"])
    far = spread(tops, "above", keep=["subroot"]).select(F.col("item.name").alias("grp"), F.col("path").alias("top"), F.col("subroot").alias("root"))
    far = stored(far, few=True)
    if far.count() <= BROADCAST_GROUPS:
        met = each.join(F.broadcast(far), "grp")
    else:  # a group's blocks are dealt over salts, so that a large one doesn't meet its steps in one task
        salted = far.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("_salt", (F.col("block") % SALTS).cast("int")).join(salted, ["grp", "_salt"])
    out = spread(met, "above", "top", keep=["subroot", "root"])
    return out.select(F.col("item.key").alias("key"), "grp", F.col("item.node").alias("leaf"), "subroot", "root", "path", F.col("item.other").alias("other"))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = manifest(docs, tampered=F.translate("text", "\n", ""), where=even)
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: A CRC by bits: the polynomial is applied eight times to each byte of the decimal key.
OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS inverse_crc FROM documents),
e AS (SELECT *, CASE WHEN inverse_crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed FROM d),
f AS (SELECT doc_id, source, changed, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM e),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS other FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id FROM l),
nodes AS (
  SELECT 0 AS level, source, pos, n, leaf AS h FROM r
  UNION ALL SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, source, pos // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM s
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
sib AS (
  SELECT r.id, k.level, k.pos, k.h, k.pos < r.pos // (3 ** k.level)::BIGINT AS before FROM r JOIN nodes k ON k.source IS NOT DISTINCT FROM r.source AND k.n > 1
    AND k.pos // 3 = r.pos // (3 ** (k.level + 1))::BIGINT AND k.pos <> r.pos // (3 ** k.level)::BIGINT
  UNION ALL
  SELECT r.id, 100 + k.level, k.pos, k.h, k.pos < s.pos // (3 ** k.level)::BIGINT FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN tops k ON k.n > 1
    AND k.pos // 3 = s.pos // (3 ** (k.level + 1))::BIGINT AND k.pos <> s.pos // (3 ** k.level)::BIGINT),
rungs AS (
  SELECT r.id, k.level FROM r JOIN (SELECT DISTINCT source, level FROM nodes WHERE n > 1) k ON k.source IS NOT DISTINCT FROM r.source
  UNION ALL SELECT r.id, 100 + k.level FROM r, (SELECT DISTINCT level FROM tops WHERE n > 1) k),
g AS (
  SELECT g.id, row_number() OVER (PARTITION BY g.id ORDER BY g.level) AS k, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS b
  FROM rungs g LEFT JOIN sib ON sib.id = g.id AND sib.level = g.level GROUP BY g.id, g.level),
folds AS (
  SELECT id, 0::BIGINT AS k, other AS h FROM r
  UNION ALL SELECT f.id, g.k, sha256(g.a || f.h || g.b) FROM folds f JOIN g ON g.id = f.id AND g.k = f.k + 1),
ends AS (SELECT id, arg_max(h, k) AS folded_root FROM folds GROUP BY id),
p AS (SELECT r.id, sha256(coalesce(string_agg(sib.h, '' ORDER BY sib.level, sib.pos), '')) AS proof_sha256 FROM r LEFT JOIN sib ON sib.id = r.id GROUP BY r.id)
SELECT r.doc_id, r.leaf, s.subroot, t.h AS root, p.proof_sha256, ends.folded_root, ends.folded_root = t.h AS verified
FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN p ON p.id = r.id JOIN ends ON ends.id = r.id CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""
