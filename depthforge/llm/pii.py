"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

Only built-in functions run; each expression sees the whole text.  Positions are code points, ends exclusive.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of their expression that pass a
validator; their spans always stay.  Further kinds: ``iban`` (mod-97), ``key`` (a hexadecimal secret after an
assignment).  Each span has a score: the kind's prior, plus ``CONTEXT_GAIN`` where one of the kind's context
words, as a whole word, stands within ``CONTEXT_CHARS`` characters before it; further kinds need ``threshold``.

Null and empty texts have no spans.  Repeated rows are judged one by one; ties in start are ordered by kind as listed
in ``KINDS``.  Very long texts take time in proportion to their length.  An empty table gives an empty result; null
keys stay.  Further columns stay; one named as the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import fresh, let, table

CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
THRESHOLD = 0.5

#: kind: (expression, prior, context words).  Possessive quantifiers and the guards in front give the same
#: leftmost matches as the plain expressions, in linear time and without recursion on long runs.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, ("mail", "email", "e-mail", "contact", "write")),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, ("ip", "host", "server", "address")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.7, ("card", "credit", "visa", "debit", "payment")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, ("phone", "telephone", "tel", "call", "mobile", "fax")),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.7, ("iban", "account", "bank", "konto", "compte")),
    "key": (r"(?<![0-9A-Fa-f])[0-9a-f]{32,64}(?![0-9A-Fa-f])", 0.3, ("token", "key", "api_key", "apikey", "access_key", "secret", "secret_key", "password")),
}
BASE = ("email", "ip", "card", "phone")
#: What a text must contain for a kind's expression to be worth running.
SIGNS = {"email": "[@]", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": "[+][0-9]", "iban": "[A-Z]{2}[0-9]{2}", "key": "[0-9a-f]{32}"}


def luhn(number: Column) -> Column:
    """Luhn's check of a string of digits."""
    digit = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")

    def add(total, i):
        d = digit(i)
        twice = 2 * d
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The international bank account number check: the rearranged number leaves 1."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: F.when(c <= "9", r * 10 + value(c)).otherwise(r * 100 + value(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(digits.between(12, 19), luhn(F.regexp_replace(match, "[ -]", ""))).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    return F.lit(True)


SPAN = "struct<start:int,ord:int,kind:string,end:int,match:string,score:double>"
#: Matches placed one after another before their places are added up.
CHUNK = 256


def _proposed(kind: str, text: Column) -> Column:
    """Valid matches of one kind: the texts between matches and the matches give the positions.

    Places are summed within chunks of matches and then over chunks, so that no array grows by one match at a time.
    """
    expr = KINDS[kind][0]
    order = list(KINDS).index(kind)
    none = F.array().cast(f"array<{SPAN}>")

    def located(both):
        matches, gaps = both.m, both.g

        def before(i):
            # a match and the gap after it have 3 characters at least, so these are enough
            some = F.transform(F.sequence(F.greatest(i - CONTEXT_CHARS // 3 - 1, F.lit(0)), i), lambda j: F.concat(F.right(F.get(gaps, j), F.lit(CONTEXT_CHARS)), F.when(j < i, F.get(matches, j)).otherwise("")))
            return F.lower(F.right(F.array_join(some, ""), F.lit(CONTEXT_CHARS)))

        def step(s, i):
            start = s.at + F.length(F.get(gaps, i))

            def found(m):
                span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("match"), _score(kind, before(i)).alias("score"))
                return F.struct((start + F.length(m)).alias("at"), F.when(_valid(kind, m), F.concat(s.out, F.array(span))).otherwise(s.out).alias("out"))

            return let(F.get(matches, i), found)

        def chunk(lo):
            return F.aggregate(F.sequence(lo, F.least(lo + CHUNK, F.size(matches)) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

        def shifted(s, c):
            out = F.transform(c.out, lambda x: F.struct((x.start + s.at).alias("start"), x.ord.alias("ord"), x.kind.alias("kind"), (x.end + s.at).alias("end"), x.match.alias("match"), x.score.alias("score")))
            return F.struct((s.at + c.at).alias("at"), F.concat(s.out, F.array(out)).alias("out"))

        chunks = F.transform(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(CHUNK)), chunk)
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        return F.when(F.size(matches) > 0, F.flatten(F.aggregate(chunks, first, shifted, lambda s: s.out))).otherwise(none)

    both = F.struct(F.regexp_extract_all(text, F.lit(expr), F.lit(0)).alias("m"), F.split(text, expr, -1).alias("g"))
    return F.when(text.rlike(SIGNS[kind]), let(both, located)).otherwise(none)


def _score(kind: str, before: Column) -> Column:
    """The kind's prior, more if one of its context words is in the text before a match."""
    _, prior, context = KINDS[kind]
    near = before.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(context)})(?![\p{{L}}\p{{N}}])")
    return F.when(near, min(1.0, prior + CONTEXT_GAIN)).otherwise(prior)


def find_pii(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, out: str = "pii_spans") -> DataFrame:
    """``docs`` with an array of (start, ord, kind, end, match, score), by start and then kind as listed in KINDS."""
    value = F.coalesce(F.col(text), F.lit(""))
    proposed = docs.withColumn(out, F.concat(*(_proposed(k, value) for k in KINDS)))
    kept = F.filter(out, lambda s: s.kind.isin(*BASE) | (s.score >= threshold))
    return proposed.withColumn(out, F.when(F.size(out) > 0, F.array_sort(kept)).otherwise(F.array().cast(f"array<{SPAN}>")))


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the first is named."""
    (pii,) = fresh(docs.columns, "_pii")
    found = find_pii(docs, text, threshold, pii)

    def new(chars):
        piece = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        step = lambda s, x: F.when(x.start < s.at, F.struct(F.greatest(s.at, x.end).alias("at"), s.out.alias("out"))).otherwise(
            F.struct(x.end.alias("at"), F.concat(s.out, F.array(piece(s.at, x.start), F.concat(F.lit("<"), x.kind, F.lit(">")))).alias("out"))
        )
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(pii, first, step, lambda s: F.array_join(F.concat(s.out, F.array(piece(s.at, F.size(chars)))), ""))

    return found.withColumn(text, F.when(F.size(pii) > 0, let(F.split(F.col(text), ""), new)).otherwise(F.col(text))).drop(pii)


def op2(spark, sf_dir: str) -> DataFrame:
    spans = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s.kind == k)).cast("bigint").alias(f"n_{k}")
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return spans.select(
        "doc_id", *(count(k) for k in BASE),
        F.sha2(shown(F.filter("pii_spans", lambda s: s.kind.isin(*BASE))), 256).alias("base_sha256"),
        shown(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda s: F.format_string("%.2f", s.score)), ",").alias("scores"),
    )
