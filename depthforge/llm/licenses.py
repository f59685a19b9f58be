"""Licence recognition by sentence rules.

Texts are normalised (lower case, runs of other characters than letters and digits as one space) and known
licence sentences in them are mapped to identifiers; a document's sequence of identifiers is then matched
against ordered rules.  A known sentence starts where a line or a sentence does, its words may be wrapped over
lines, and further clauses may follow, so licence texts and headers count as well as one-line notices.  All of
it is one projection of built-in functions: no shuffle, no state, and a hot source or group of copies makes no
difference.

Rules are ordered, and an earlier one wins over those that need nothing beyond its sentences: a text with the three
clauses of BSD-3 isn't BSD-2 as well.

Null and empty texts have no sentences and no licence.  A sentence known to several rules serves them all; of known
sentences with the same start the longest counts.  Repeated rows are judged one by one, null keys stay.  Very long
texts take time in proportion to their length.  An empty table gives an empty result.  Further columns stay; those
named as the results are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import table

#: One-line notices, as the SQL has them, and their identifiers.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl3-work",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "licensed under the apache license version 2 0": "apache2-short",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this file is released under the mit license": "mit-short",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "mit-asis",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-name",
    "licensed under cc by nc 4 0": "cc-by-nc4",
    "licensed under cc by sa 4 0": "cc-by-sa4",
    "licensed under cc by 4 0": "cc-by4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4",
    "this content is dedicated to the public domain under cc0": "cc0",
    "all rights reserved": "reserved",
}

_FREE = "* is free software you can redistribute it and or modify it under the terms of the gnu"
_GPL = f"{_FREE} general public license"


def _versions(license: str, name: str, numbers: tuple[str, ...]) -> dict[str, str]:
    """The sentence that grants ``license`` in each of its versions."""
    forms = ("as published by the free software foundation either version {} of the license", "as published by the free software foundation version {} of the license", "version {} as published by the free software foundation")
    return {f"{_FREE} {license} {form.format(n)}": f"{name}{n.replace(' ', '')}-work" for n in numbers for form in forms}


#: Normalised licence sentences and their identifiers; * is any few words.
SENTENCES = NOTICES | {
    "apache license version 2 0 january 2004": "apache2-short",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-name",
    "gnu general public license version 2 june 1991": "gpl2-work",
    "gnu general public license version 3 29 june 2007": "gpl3-work",
    _GPL: "gpl-free",
    **_versions("general public license", "gpl", ("2", "3")),
    **_versions("lesser general public license", "lgpl", ("2 1", "3")),
    **_versions("affero general public license", "agpl", ("3",)),
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-work",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-work",
    "gnu affero general public license version 3 19 november 2007": "agpl3-work",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-form",
    "mozilla public license version 2 0": "mpl2-form",
    "* is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
}

#: (licence, identifiers that must follow one another, others may stand between), for the notices; earlier rules win.
NOTICE_RULES = (
    ("Apache-2.0", ("apache2-short", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-short",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-unknown", ("gpl-free", "gpl-hope")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-short",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-name")),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("reserved",)),
)
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-binary", "bsd-name")),
    *NOTICE_RULES,
    ("BSD-2-Clause", ("bsd-grant", "bsd-binary")),
    ("GPL-2.0", ("gpl2-work",)),
    ("LGPL-2.1", ("lgpl21-work",)),
    ("LGPL-3.0", ("lgpl3-work",)),
    ("AGPL-3.0", ("agpl3-work",)),
    ("MPL-2.0", ("mpl2-form",)),
)

#: Ends of lines and sentences: line ends, or closing marks before a space.
BREAK = r"[.!?;:](?<![.!?;:]{2})[.!?;:]*+(?:[ \t]*(?:\r?\n|\r)|(?=\s|$))|\r?\n|\r"


def _pattern(sentence: str) -> str:
    """What ``sentence`` looks like in normalised text, where B stands for a break: between words there is one at most."""
    some = lambda i: "[a-z0-9 B]{1,80}?" if i else "[a-z0-9 ]{1,40}?"
    return "(?: ?B ?| )".join(some(i) if w == "*" else w for i, w in enumerate(sentence.split(" ")))


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of known sentences in their order in ``text``.

    A sentence starts after a break, brackets, quotes, comment marks or a number; of sentences with the same
    start the longest counts.  What precedes it in its line otherwise makes it another sentence.
    """
    known = {_pattern(s): i for s, i in sorted(sentences.items(), key=lambda x: -len(x[0]))}
    low = F.lower(text)
    # each sentence's longest word tells most texts without any from the rest
    some = reduce(or_, (F.contains(low, F.lit(w)) for w in sorted({max(s.split(), key=len) for s in sentences})))
    normal = F.concat(F.lit("B"), F.regexp_replace(F.regexp_replace(low, BREAK, "B"), "[^a-z0-9B]+", " "))
    found = F.regexp_extract_all(F.when(some, normal).otherwise(""), F.lit(f"B ?(?:[0-9]{{1,2}} )?({'|'.join(known)})(?![a-z0-9])"), F.lit(1))
    return F.transform(found, lambda s: F.coalesce(*(F.when(s.rlike(f"^{p}$"), i) for p, i in known.items())))


def _covered(rules) -> list[list[list[int]]]:
    """For each rule and each of its identifiers that earlier rules have, the numbers of these; rules with an identifier of their own have an empty list among them."""
    return [[[j for j in range(i) if x in rules[j][1]] for x in seq] for i, (_, seq) in enumerate(rules)]


def match_rules(ids: Column, rules=RULES) -> Column:
    """The licences, in the order of their rules, whose rule's identifiers occur in order in ``ids``.

    An earlier rule wins: one whose identifiers all belong to earlier rules that hold says nothing new and doesn't count.
    """
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    counts: list[Column] = []
    for (_, seq), taken in zip(rules, _covered(rules), strict=True):
        holds = line.rlike("".join(f"(?: .*)? {i}(?= )" if k else f" {i}(?= )" for k, i in enumerate(seq)))
        if all(taken):
            holds = holds & ~reduce(and_, (reduce(or_, (counts[j] for j in js)) for js in taken))
        counts.append(holds)
    return F.array_distinct(F.filter(F.array(*(F.when(c, name) for c, (name, _) in zip(counts, rules, strict=True))), lambda x: x.isNotNull()))


def scan_licenses(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``docs`` with ``sentence_ids``, ``licenses`` (arrays; empty where there is none) and ``license``, the first of them."""
    found = docs.withColumn("sentence_ids", sentence_ids(F.col(text), sentences)).withColumn("licenses", match_rules(F.col("sentence_ids"), rules))
    return found.withColumn("license", F.get("licenses", 0))


def op6(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"), F.coalesce("license", F.lit("")).alias("license"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in NOTICES.items())
    cases = ", ".join("CASE WHEN regexp_matches(line, '" + "".join(f"( .*)? {i}" if k else f" {i}" for k, i in enumerate(seq)) + f" ') THEN '{name}' END" for name, seq in NOTICE_RULES)
    return f"""
WITH s AS (SELECT doc_id, i, p[i] AS s FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
  SELECT doc_id, string_split_regex(coalesce(text, ''), '[\\n\\r]+|[.!?;:]+(\\s|$)') AS p FROM documents))),
n AS (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM s),
k(s, id) AS (VALUES {known}),
a AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM n JOIN k USING (s) GROUP BY doc_id),
b AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, ' ' || replace(coalesce(ids, ''), ',', ' ') || ' ' AS line FROM documents d LEFT JOIN a USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentence_ids,
  array_to_string(list_filter(names, lambda x, i: x IS NOT NULL AND list_position(names, x) = i), ',') AS licenses,
  coalesce(list_filter(names, lambda x: x IS NOT NULL)[1], '') AS license FROM (SELECT *, [{cases}] AS names FROM b)
"""


OP6_SQL = _sql()
