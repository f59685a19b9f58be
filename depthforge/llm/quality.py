"""Quality rules with cross-document line frequency.

Per document, from its whole text alone: counts of words, word characters, symbols, repeated lines and
repeated three-word windows.  Across documents: normalised lines are hashed, distinct documents are counted
per host and line, lines in more than ``limit`` documents of a host are removed, and a document that keeps
less than ``keep_share`` of its words is rejected as depleted.

Only built-in functions run.  Per-document counts need no shuffle.  Line counts are pre-aggregated before
they meet by (host, line hash), so a host with a third of all rows is spread over its lines; a line that
fills a third of all rows is one count per task, and frequent lines return to the documents as a broadcast of
checked size or salted (:mod:`depthforge.llm.lines`).

Null and empty texts have no words and fail the base rule.  Null hosts count as one host.  Rows repeated under one
key count as one document, each row is judged by its own text; rows with a null key are judged, but count as no
document.  Ties: a line in exactly ``limit`` documents stays.  Very long texts are read whole.  An empty table gives
an empty result.  Only key, host and text are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import SPACES, let, stored, table, words

#: A line in more documents of one host than this is boilerplate.
LIMIT = 50
#: A document with less than this share of its words left is depleted.
KEEP_SHARE = 0.2


def repeated_words(ws: Column, window: int = 3) -> Column:
    """Words in windows that occur twice or more in the array; all occurrences count.

    Windows are sorted by (hash, position); those equal to a neighbour are repeated.  Positions of repeated
    windows, in order, each cover up to the next position.
    """

    def covered(places: Column) -> Column:
        step = lambda s, p: F.struct((s.n + window - F.greatest(s.end - p, F.lit(0))).cast("int").alias("n"), (p + window).cast("int").alias("end"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), step, lambda s: s.n)

    def places(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: (x.h == F.get(s, i + 1).h) | ((i > 0) & (x.h == F.get(s, i - 1).h))))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def hashed(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - window + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, window))))

    def count(h: Column) -> Column:
        # most texts have no repeated window; a hash set tells without sorting
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h)))

    return let(hashed(ws), count)


def rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed."""
    value = F.coalesce(F.col(text), F.lit(""))
    spaces = F.length(F.regexp_replace(value, f"[^{SPACES}]+", ""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    one = let(
        words(value),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).cast("bigint").alias("n_repeat_words")),
    )
    out = docs.withColumn("_r", one)
    out = out.select(
        *[c for c in docs.columns if c not in RULES],
        F.col("_r.n_words").alias("n_words"),
        (F.length(value) - spaces).cast("bigint").alias("word_chars"),
        (F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("bigint").alias("n_dup_lines"),
        F.col("_r.n_repeat_words").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, runs of space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"[{SPACES}]+", " "))


def cut_frequent(docs: DataFrame, key: str = "doc_id", host: str = "source", limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` without the lines that are in more than ``limit`` documents of their host, and n_lines and n_dropped added."""
    from depthforge.llm.lines import drop_lines  # which imports this module

    return drop_lines(docs, key, host, text, ratio=0.0, least=limit + 1)


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", limit: int = LIMIT, keep_share: float = KEEP_SHARE, text: str = "text") -> DataFrame:
    """(key, the rules' columns, n_boilerplate_words, kept) per row."""
    from depthforge.llm.lines import boilerplate, hashed_lines, meet, row_id

    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    gone = stored(boilerplate(slim, "key", "host", "text", 0.0, limit + 1).select("host", "line"))
    each = slim.select(row_id("key", "host", "text").alias("row"), "host", F.explode(hashed_lines(F.col("text"))).alias("x")).select("row", "host", "x.line", "x.i", "x.n_words")
    each = meet(each, gone).groupBy("row", "i").agg(F.first("n_words").alias("n_words"))  # rows alike count once
    lost = each.groupBy("row").agg(F.sum("n_words").alias("lost")).withColumnRenamed("row", "_row")
    measured = rules(slim.withColumn("_own", row_id("key", "host", "text"))).drop("text", "host")
    out = measured.join(lost, F.col("_own").eqNullSafe(F.col("_row")), "left").withColumn("n_boilerplate_words", F.coalesce("lost", F.lit(0)).cast("bigint"))
    depleted = F.col("n_words") - F.col("n_boilerplate_words") < keep_share * F.col("n_words")
    return out.select(F.col("key").alias(key), *RULES, "n_boilerplate_words", (~F.col("base_failed") & ~depleted).alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM t) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, line FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
n AS (SELECT doc_id, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line FROM l),
f AS (SELECT host, line FROM n GROUP BY host, line HAVING count(DISTINCT doc_id) > 50),
b AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS lost FROM n JOIN f USING (host, line) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rw ON w.doc_id = rw.doc_id LEFT JOIN dl ON w.doc_id = dl.doc_id LEFT JOIN b ON w.doc_id = b.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(lost AS BIGINT) AS n_boilerplate_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - lost < 0.2 * n_words) AS kept
FROM m
"""
