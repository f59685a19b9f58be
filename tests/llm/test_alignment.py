"""Cross-tokenizer alignment against byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depthforge.llm import alignment
from depthforge.llm.common import stored

SCHEMA = "doc_id bigint, text string, key int, row string, pairs int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "r", 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def gpt_bytes(token):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    n = 0
    for b in range(256):
        if b not in shown:
            back[chr(256 + n)] = b
            n += 1
    return bytes(back[c] for c in token)


def brute(texts):
    """By the offsets at which tokens end."""
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    out, linked = [], []
    for k, t in enumerate(texts):
        a, b, ends = [], [], []
        if t:
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
            sa, sb = [gpt_bytes(a_side.id_to_token(i)) for i in a], [piece(i) for i in b]
            if b"".join(sa) == b"".join(sb) == (" " + t).encode():
                at = lambda s: {sum(map(len, s[: i + 1])): i for i in range(len(s))}
                ea, eb = at(sa), at(sb)
                ends = [(ea[e], eb[e]) for e in sorted(ea.keys() & eb.keys())]
            else:
                a, b = [], []
        groups, i, j = [], 0, 0
        for p, q in ends:
            groups.append(f"{','.join(map(str, a[i : p + 1]))}|{','.join(map(str, b[j : q + 1]))}")
            i, j = p + 1, q + 1
        out.append((k, len(a), len(b), len(ends), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        linked.append([(a[p], b[q]) for p, q in ends])
    count = Counter(x for pairs in linked for x in pairs)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*r, sum(count[x] == best[x[1]] for x in pairs), sum(count[x] for x in pairs)) for r, pairs in zip(out, linked, strict=True)]


def run(spark, texts):
    linked = alignment.links(frame(spark, texts)).withColumn("row", F.monotonically_increasing_id())
    out = alignment.scored(stored(linked)).withColumnRenamed("key", "doc_id").select(COLUMNS)
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["The quick brown fox", "naïve façade", "日本語のテキスト", "x = f(a[0]) # é", "1234567 8.90", "Straße", "emoji 😀👍🏽", "  two  spaces", "tab\tnew\nline\r\n", "don't", "ALLCAPS", "<|endoftext|>", "<s> </s> <unk> <0x41>", "http://a.b/c?d=e"]
    out = [None, "", " ", "\n", "a", "▁", "a▁b", "é", "ﬁ ﬀ", " ", "\x00", "\x00a", *some, *some[:4]]
    return out + [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 30))) for _ in range(60)]


def test_links(spark, texts):
    assert run(spark, texts) == brute(texts)


def test_other_paths(spark, texts, monkeypatch):
    """Most pairs beyond the broadcast bound, forgetful workers, small chunks: the same rows."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 5)
    counts = alignment.pair_counts(stored(alignment.links(frame(spark, texts))))
    least = alignment.frequent(counts, 5)
    assert least > 1 and 0 < counts.where(F.col("n") >= least).count() <= 5
    assert run(spark, texts) == brute(texts)


def test_forgets(texts):
    worker = alignment._worker(alignment.default_tokenizers())
    fresh = alignment.Transducer(worker[0].tokens, worker[1].tokens)
    for t in texts:
        fresh.forget(3)
        assert alignment.aligned(t, worker[0], worker[1], fresh) == alignment.aligned(t, *worker[:3])
    assert fresh.known < worker[2].known


def test_transducer():
    """The states of a small pair of vocabularies, and sides that don't spell the same."""
    t = alignment.Transducer([b"ab", b"c", b"abc", b""], [b"a", b"bc", b"abcab", b"x"])
    assert t.cuts([0, 1], [0, 1]) == ([2], [2])
    assert t.cuts([2, 0, 1], [2, 1]) is None
    assert t.cuts([2, 2], [0, 1, 0, 1]) == ([1, 2], [2, 4])
    assert t.cuts([0], [0]) is None and t.cuts([1], [3]) is None and t.cuts([], []) == ([], []) and t.cuts([], [0]) is None
    assert {(s.lead, s.rest) for s in t.states.values()} == {(0, b""), (1, b"ab"), (1, b"b"), (-1, b"c"), (1, b"abc"), (-1, b"ab"), (1, b"bc"), (1, b"c")}
    with pytest.raises(ValueError):
        t.cuts([3], [])


def test_tokens_spell_the_text(spark):
    """Groups cover both sides' tokens, and each spells the same bytes on both sides."""
    texts = ["Ein naïver Text, 12.5 % 😀", "plain words"]
    first, second, *_ = alignment._worker(alignment.default_tokenizers())
    for r in alignment.align(frame(spark, texts)).collect():
        cut = lambda ids, ends, tokens: [b"".join(tokens[t] for t in ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        left, right = cut(r.a_ids, r.a_ends, first.tokens), cut(r.b_ids, r.b_ends, second.tokens)
        assert left == right and b"".join(left).decode() == " " + texts[r.key]


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [None, ""]) == brute([None, ""])
    same = ["again and again"] * 7
    assert run(spark, same) == brute(same)
    long = "The same words, again and again. é " * 30_000
    got = run(spark, [long, "x"])
    assert got[0][1] > 200_000 and got[0][3] > 100_000 and got[1][1:4] != (0, 0, 0)


def test_batches_are_small(spark, texts):
    """Whole texts go to Python 250 at a time at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    alignment.links(frame(spark, texts))
    assert int(spark.conf.get(name)) <= 250
