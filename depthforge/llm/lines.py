"""Line dedup by site-relative frequency.

Lines with a word are normalised and hashed.  Per host, pages holding a line are divided by the host's pages;
lines above ``ratio`` on at least ``least`` pages are boilerplate and dropped from every page of the host.

Counts are pre-aggregated per (host, line) before the shuffle, so a host with a third of all pages is dealt
over its lines and a line on a third of all pages is one count per task.  The dropped lines go to the pages: as a
broadcast if they are ``BROADCAST_LINES`` at most, else joined with salt, so that their occurrences, which are the
frequent ones, don't meet in one task.  Only the numbers of the lines to drop return to the texts.

Null and empty texts have no lines and stay as they are; null hosts are one host; lines without a word are kept.
Ties at the ratio are kept.  Rows repeated under one key count as one page, each row loses its own lines; rows with a
null key are no pages, but lose lines too.  Very long texts take time in proportion to their length.  An empty table
gives an empty result.  Further columns stay, also where they are named like columns used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import SPACES, let, stored, table
from depthforge.llm.quality import normal_line

#: A line on more than this share of a host's pages goes...
RATIO = 0.2
#: ...if on this many pages at least.
LEAST = 3
#: The floor of the query's SQL.
SQL_LEAST = 10


#: Lines that are broadcast at most: two longs each.
BROADCAST_LINES = 500_000
SALTS = 16


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(text):
    """(line, i, n_words) of the lines with a word: hash of the normal line, its number and words."""
    one = lambda x, i: let(normal_line(x), lambda y: F.struct(F.when(y != "", F.xxhash64(y)).alias("line"), i.alias("i"), F.size(F.split(y, " ")).alias("n_words")))
    return F.filter(F.transform(_lines(text), one), lambda s: s.line.isNotNull())


def _host(host: str):
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def boilerplate(pages: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, line, n_pages, n_host): hashes of lines above the ratio; pages are distinct keys."""
    slim = pages.select(F.col(key).alias("key"), _host(host).alias("host"), F.col(text).alias("text")).where("key is not null")
    each = slim.select("key", "host", F.explode(F.array_distinct(F.transform(hashed_lines(F.col("text")), lambda s: s.line))).alias("line"))
    once = slim.select("key", "host")
    if once.groupBy("key").count().where("count > 1").limit(1).count():
        each, once = each.distinct(), once.distinct()
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least)
    totals = once.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    return counts.join(totals, "host").where(F.col("n_pages") > ratio * F.col("n_host"))


def meet(each: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``each`` whose (host, line) is in ``gone``, a written table without repeats."""
    if gone.count() <= BROADCAST_LINES:
        return each.join(F.broadcast(gone), ["host", "line"])
    salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"]).drop("salt")


def row_id(key: str, host: str, text: str):
    """What tells a page's row from others; rows alike in it lose the same lines."""
    return F.struct(F.col(key).alias("key"), _host(host).alias("host"), F.xxhash64(F.col(text)).alias("h"))


def without_lines(lines, drops):
    """``lines`` without those numbered in the sorted array ``drops``: the slices between them."""

    def kept(d):
        bounds = F.concat(F.array(F.lit(-1)), d, F.array(F.size(lines)))
        return let(bounds, lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), lambda j: F.slice(lines, F.get(b, j) + 2, F.get(b, j + 1) - F.get(b, j) - 1))))

    return let(drops, kept)


def drop_lines(pages: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``pages`` with boilerplate lines cut out of ``text``, and n_lines and n_dropped added."""
    slim = pages.select(row_id(key, host, text).alias("row"), _host(host).alias("host"), F.col(text).alias("text"))
    each = slim.select("row", "host", F.explode(hashed_lines(F.col("text"))).alias("x")).select("row", "host", "x.line", "x.i")
    gone = stored(boilerplate(pages, key, host, text, ratio, least).select("host", "line"))
    drops = meet(each, gone).groupBy("row").agg(F.sort_array(F.collect_set("i")).alias("_drops")).select(F.col("row").alias("_row"), "_drops")
    packed = pages.select(F.struct(*(pages[c] for c in pages.columns)).alias("_page"), row_id(key, host, text).alias("_own"))  # so that no name clashes
    out = packed.join(drops, F.col("_own").eqNullSafe(F.col("_row")), "left")
    own = F.col("_page")[text]
    kept = F.array_join(let(_lines(own), lambda ls: without_lines(ls, F.col("_drops"))), "\n")
    return out.select(
        *(F.when(F.col("_drops").isNotNull(), kept).otherwise(own).alias(c) if c == text else F.col("_page")[c].alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")),
        F.size(_lines(own)).cast("bigint").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(pages, least=SQL_LEAST).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, host, string_split(text, chr(10)) AS p FROM d),
l AS (SELECT doc_id, host, i, p[i] AS line FROM (SELECT doc_id, host, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
n AS (SELECT doc_id, host, i, line, CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) END AS k FROM l),
h AS (SELECT host, count(*) AS n_host FROM d GROUP BY host),
c AS (SELECT host, k, count(DISTINCT doc_id) AS n FROM n WHERE k IS NOT NULL GROUP BY host, k),
b AS (SELECT c.host, c.k, 1 AS gone FROM c JOIN h ON c.host = h.host WHERE n >= 10 AND n > 0.2 * n_host)
SELECT n.doc_id, count(*) AS n_lines, CAST(count(gone) AS BIGINT) AS n_dropped, coalesce(string_agg(CASE WHEN gone IS NULL THEN line END, chr(10) ORDER BY i), '') AS text
FROM n LEFT JOIN b ON n.host = b.host AND n.k = b.k GROUP BY n.doc_id
"""
