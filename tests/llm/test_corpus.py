"""Operators that compare documents, the classifier, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from depthforge.llm import jaccard, repeats, substrings, suffix, toxicity
from depthforge.llm.components import components
from depthforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, key bigint, mark string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 3, "m", 1) for k, t in rows], SCHEMA).repartition(3)


def removed(seqs, width=50):
    first = {}
    for i, s in seqs:
        for j in range(len(s) - width + 1):
            w = tuple(s[j : j + width])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, s in seqs:
        mask = [False] * len(s)
        for j in range(len(s) - width + 1):
            if first[tuple(s[j : j + width])] < i:
                mask[j : j + width] = [True] * width
        out[i] = mask
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(300), text(70)
    out = [base, base, text(400), None, "", "short", "ab " * 400, "ab " * 400, "x" * 600, "x" * 700]
    for i in range(40):
        w = base.split()
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [f"{text(30)}\n{passage}\t{text(30)}" for _ in range(30)] + [passage, passage[:200], text(49), text(50)]
    rng.shuffle(out)
    return [(i * 3 - 50, t) for i, t in enumerate(out)]


SETTINGS = {"plain": {}, "small": {"BATCH": 2000, "BYTES": 3000}, "hot": {"HOT": 3, "HOT_SHARE": 0.0}}


@pytest.fixture(params=[*SETTINGS, "weak"])
def setting(request, monkeypatch):
    for name, value in SETTINGS.get(request.param, {}).items():
        monkeypatch.setattr(repeats, name, value)
    return request.param


def test_substring_dedup(spark, rows, setting):
    words = {i: re.findall(WORDS, t or "") for i, t in rows}
    want = removed(sorted(words.items()))
    more = {}
    if setting == "weak":  # all words have one hash, so all windows meet
        more = {"values": lambda raws: [np.ones(len(r.split()), np.uint64) for r in raws]}
    elif setting == "small":
        more = {"nodes": repeats.Shape(49, 12, 120), "solver": lambda runs: substrings.graph_rows(runs, 500)}
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, rows), **more).collect()}
    assert got.keys() == want.keys()
    for i, mask in want.items():
        assert (got[i].n_words, got[i].n_removed) == (len(mask), sum(mask)) and got[i].text == " ".join(w for w, m in zip(words[i], mask, strict=True) if not m)


def test_suffix_dedup(spark, rows, setting):
    raw = {i: (t or "").encode() for i, t in rows}
    want = removed(sorted(raw.items()))
    more = {}
    if setting == "weak":
        few = rows[::3]
        raw = {i: (t or "").encode() for i, t in few}
        want, rows = removed(sorted(raw.items())), few
        more = {"values": lambda raws: [np.ones(len(r), np.uint64) for r in raws]}
    elif setting == "small":
        more = {"shape": repeats.Shape(50, 20, 1000), "solver": lambda runs: suffix.repeated_windows(runs, 500)}
    got = {r.doc_id: r for r in suffix.remove_repeats(frame(spark, rows), digest=True, **more).collect()}
    assert got.keys() == want.keys()
    for i, mask in want.items():
        kept = bytes(b for b, m in zip(raw[i], mask, strict=True) if not m)
        spans = sum(b and not a for a, b in zip([False, *mask], mask, strict=False))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(mask), sum(mask), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("operator", [substrings.remove_repeats, suffix.remove_repeats])
def test_repeats_on_odd_rows(spark, operator):
    rng = random.Random(2)
    a, b = (" ".join(f"{rng.random():.6f}" for _ in range(80)) for _ in range(2))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, f"{a} {b}"), (None, a), (None, None), (4, None), (5, ""), (6, "\0" * 90), (7, "\0" * 90)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed, r.text) for r in operator(frame(spark, rows)).collect()), key=str)
    assert [g[:2] for g in got] == sorted([(k is None, k or 0) for k, _ in rows], key=str)
    left = {(k, n) for _, k, n, _ in got}
    size = (lambda t: len(t.split())) if operator is substrings.remove_repeats else len
    assert {(1, 0), (2, size(b)), (4, 0), (5, 0), (6, 0), (0, 0)} <= left and not any(k == 1 and n for k, n in left)
    assert sum(n for k, n in left if k == 3) >= size(a) + size(b) - (operator is suffix.remove_repeats)
    assert sum(n for k, n in left if k == 7) == (90 if operator is suffix.remove_repeats else 0)
    assert operator(frame(spark, rows).limit(0)).count() == 0


def test_passage_in_a_third_of_all_rows(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*(word() for _ in range(30)), *(passage if i % 3 == 0 else []), *(word() for _ in range(30))])) for i in range(600)]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: 60 if i % 3 == 0 and i else 0 for i in range(600)}


def test_window_classes():
    rng = np.random.default_rng(0)
    s = np.concatenate([rng.integers(97, 100, 400), [suffix.STOP], rng.integers(97, 100, 300), [suffix.STOP]]).astype(np.uint8)
    s[500:540] = s[100:140]
    for length in (1, 5, 12, 30, 39):
        number = suffix.window_classes(s, length)
        classes = {}
        for i in range(len(s) - length + 1):
            w = bytes(s[i : i + length])
            classes.setdefault(w if suffix.STOP not in w else i, set()).add(int(number[i]))
        assert all(len(c) == 1 for c in classes.values()) and len(set.union(*classes.values())) == len(classes)


def test_expansion_decides(spark, rows):
    """Without the expansion only whole runs that are equal are repeats."""
    alone = lambda runs: suffix.repeated_windows(runs, classes=lambda s, length: np.arange(len(s)))
    broken, whole = (suffix.remove_repeats(frame(spark, rows), **more).agg(F.sum("n_removed")).first()[0] for more in ({"solver": alone}, {}))
    assert broken < whole


def test_paths_decide(spark, rows, monkeypatch):
    """Without compaction only single edges are removed."""
    whole = substrings.remove_repeats(frame(spark, rows)).agg(F.sum("n_removed")).first()[0]
    monkeypatch.setattr(substrings, "path_ends", lambda pieces: pieces.limit(0))
    assert substrings.remove_repeats(frame(spark, rows)).agg(F.sum("n_removed")).first()[0] < whole


def test_path_ends(spark):
    pieces = [(1, i, i + 1) for i in range(0, 40)] + [(1, 50, 55), (2, 3, 9), (2, 9, 12)]
    got = {(r.k, r.a): r.b for r in substrings.path_ends(spark.createDataFrame(pieces, "k bigint, a bigint, b bigint")).collect()}
    assert got == {**{(1, i): 40 for i in range(40)}, (1, 50): 55, (2, 3): 12, (2, 9): 12}


def test_longer_than_a_segment(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(2500)
    rows = [(1, text(700) + shared + text(3000)), (2, text(3000) + shared), (3, shared[:1200])]
    want = removed([(i, t.encode()) for i, t in rows])
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(frame(spark, rows), shape=repeats.Shape(50, 20, 1000)).collect()}
    assert got == {i: sum(m) for i, m in want.items()}


def linked(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in edges:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_duplicates(spark, rows):
    more = [*rows, (5000, "One two THREE"), (5001, "one two three"), (5002, "a b c d e f"), (5003, "a b c d e f g"), (5004, "a b c d e f g h"), (5005, "a b c d e f g h i"), (5006, "  ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, more)).collect()}
    assert got == linked(more)
    kept = {r.doc_id for r in jaccard.keep_one(frame(spark, more)).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}
    assert jaccard.near_duplicates(frame(spark, more).limit(0)).count() == 0
    odd = frame(spark, [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "x y z"), (2, "x Y z"), (3, "A b c d e f")])
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()) == [("1", 1, 1), ("1", 2, 1), ("2", 1, 1), ("3", 2, 1), ("None", 0, None), ("None", 2, None)]


@pytest.mark.parametrize("common", [2, 3])
def test_near_duplicates_of_common_shingles(spark, monkeypatch, common):
    """Shingles of a third of all documents, sent as lists or not, give the same counts and components."""
    monkeypatch.setattr(jaccard, "COMMON_FROM", common)
    rng = random.Random(9)
    header = " ".join(f"h{i}" for i in range(12))
    rows = [(i, (header + " " if i % 3 == 0 else "") + " ".join(f"w{rng.randrange(12 if i % 5 else 400)}" for _ in range(30))) for i in range(60)]
    rows += [(100 + i, f"{t} u{i}") for i, t in rows[:40]] + [(7, "one more row of a key")]
    docs = frame(spark, rows)
    found = jaccard.shared_shingles(docs.select(F.col("doc_id").cast("bigint").alias("key"), "text"))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(i, set()).update(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    counts = Counter(s for own in sets.values() for s in own)
    spread = {r.a: (r.b, r.n) for r in found.where("kind = 3").collect()}
    got = {(r.b, r.a, r.n) for r in found.where("kind = 0").collect()} | {(k, *spread[r.a]) for r in found.where("kind = 2").collect() for k in r["keys"]}
    assert spread and len(got) == sum(n for n in counts.values() if n > 1)
    assert Counter(n for _, _, n in got) == Counter({k: sum(n for n in counts.values() if n == k) for k in set(counts.values()) - {1}})
    one = [r for r in rows if r != (7, "one more row of a key")]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, one)).collect()} == linked(one)


def test_prefixes_of_near_copies(spark, monkeypatch):
    """One row a document with its prefix only, by exact frequencies; twice as many near copies have twice as many entries."""
    monkeypatch.setattr(jaccard, "BATCH", 700)
    rng = random.Random(6)
    rows = []
    for i in range(240):
        w = [f"w{j}" for j in range(40)]
        w[rng.randrange(40)], w[rng.randrange(40)] = f"e{i}", f"f{i % 7}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(20))) for i in range(5)]
    entries = []
    for some in (rows[:120], rows):
        docs = spark.createDataFrame(some, "key bigint, text string").repartition(3, "key")
        found = jaccard.counted_batches(docs)
        got = jaccard.prefixes(found).collect()
        sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in some}
        df = Counter(s for own in sets.values() for s in own)
        shared = {i: sorted(df[s] for s in own if df[s] > 1) for i, own in sets.items()}
        least = {i: (3 * len(own) + 3) // 4 for i, own in sets.items()}
        want = {i: (len(sets[i]), len(held), held[: max(0, len(held) - max(0, least[i] - 3))]) for i, held in shared.items()}
        numbers = {r.a: r.n for r in jaccard.shared_shingles(docs).where("kind <> 2").select("kind", F.when(F.col("kind") == 0, F.col("a")).otherwise(F.col("b")).alias("a"), "n").collect()}
        assert {r.key: (r.n, r.held, [numbers[t] for t in r.toks]) for r in got} == {i: w for i, w in want.items() if w[2]}
        assert len(got) <= len(some) and found.count() < 4 * sum(map(len, sets.values())) / 5
        entries.append(sum(len(r.toks) for r in got))
    assert 0 < entries[1] <= 2.5 * entries[0] and 3 * entries[1] < sum(map(len, shared.values()))
    with pytest.raises(Exception, match="answers to a batch"):
        jaccard.prefixes(found.where("kind = 1 or b < 3")).collect()


def test_near_duplicates_chain(spark):
    rng = random.Random(8)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a chain of small changes whose ends are far apart
        rows.append((i, " ".join(w)))
        w[rng.randrange(120)] = f"n{i}"
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows)] + [(500, None), (500, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == linked(rows)


def test_near_duplicates_in_turns(spark, monkeypatch):
    """One prefix whose smallest document is like none of the others, and two further classes: pivots fail, heads don't, and few pairs are verified."""
    rng = random.Random(4)
    front = [f"f{i}" for i in range(20)]
    tails = [[f"t{c}x{i}" for i in range(40)] for c in range(4)]
    rows, n = [], 0
    for c, copies in enumerate((1, 60, 50, 1)):
        for _ in range(copies):
            tail = list(tails[c])
            if n:
                tail[rng.randrange(30, 40)] = f"z{n}"
            rows.append((n, " ".join(front + tail)))
            n += 1
    members = spark.createDataFrame([(i, 0) for i, _ in rows], "key bigint, grp bigint")
    seen = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    tokens = spark.createDataFrame([], "tok bigint, grp bigint, n bigint, held bigint, pos bigint")
    slim = spark.createDataFrame(rows, "key bigint, text string")
    links = jaccard._late(members, tokens, spark.createDataFrame([], "u bigint, v bigint"), slim, 5)
    comp = {r.node: r.component for r in components(links).collect()}
    want = linked(rows)
    assert {i: comp.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in want.items()}
    assert len(seen) > 1 and max(seen) < n * (n - 1) // 2


def test_turns_cover_all_pairs(spark):
    """Without any link, each pair of a group and of two groups has exactly one turn."""
    members = jaccard._turns(spark.createDataFrame([(i, i // 40) for i in range(80)], "key bigint, grp bigint"))
    last = members.agg(F.max("turn")).first()[0]
    apart = members.withColumn("comp", F.col("key"))
    todo = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "grp_1 bigint, grp_2 bigint")
    got = [(r.u, r.v) for t in range(last + 1) for r in jaccard._between(todo, apart, t).collect()]
    assert last >= 1 and sorted(got) == [(a, b) for a in range(80) for b in range(a + 1, 80)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (3, 2), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1, 3: 1}


# ---------------------------------------------------------------- toxicity


def test_marginals_equal_the_full_chain():
    model = toxicity.Model({b"=bad": 4.0, b"^awfu": 2.0}, -2.5, np.array([[1.0, -1.0], [-0.5, 0.7]]), np.zeros(4))
    for words in ([], [b"bad"], [b"x", b"bad", *[b"y"] * 1400, b"awful", b"bad", b"z"]):
        e = np.array([[0, model.emission(w) + model.bias] for w in words]).reshape(-1, 2)
        a, b = e.copy(), np.zeros_like(e)
        for i in range(1, len(e)):
            a[i] += np.logaddexp.reduce(a[i - 1][:, None] + model.trans, axis=0)
        for i in range(len(e) - 2, -1, -1):
            b[i] = np.logaddexp.reduce(model.trans + e[i + 1] + b[i + 1], axis=1)
        for i, p in model.marginals(words):
            assert abs(p - 1 / (1 + np.exp((a[i] + b[i])[0] - (a[i] + b[i])[1]))) < 1e-9


def test_toxicity_learns(spark):
    rng = random.Random(0)
    clean = [f"c{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(800):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "vilest", "rotten"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = frame(spark, [*rows, (-1, None), (-2, ""), (-3, "Ünd ROTTEN")])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int")).collect()}
    assert all(got[i].predicted == y for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[-1].score == got[-2].score < 0.3 and got[-3].toxic_spans == "4:10" and all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).agg(F.max("score")).first()[0]
    assert none < 1e-9
    kept = toxicity.reject_toxic(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert kept.columns == docs.columns and kept.where("doc_id = -3").count() == 0 and kept.where("doc_id < 0").count() == 2
    twice = frame(spark, [(5, "c1 c2"), (5, "vile rotten vilest"), (None, "vile rotten"), (None, None)])
    assert sorted(str(r.text) for r in toxicity.reject_toxic(twice.unionByName(docs), spark.createDataFrame(labels, "doc_id bigint, toxic int")).where("doc_id = 5 or doc_id is null").collect() if "c1 c2" == r.text or r.text is None) == ["None", "c1 c2"]


def test_copies_teach_once():
    d = [f"w{i} w{i + 1} x{i}".split() for i in range(50)]
    one = [w.encode() for t in d for w in t]
    assert toxicity.distinct([one, one, one[:-1], [b"other"] * 3, [b"a", b"b", b"c", b"d", b"e"]]) == [0, 3, 4]


def brute_score(model, words):
    """The document's score from the full chain in plain probabilities, scaled step by step."""
    e = [np.exp([0.0, min(model.emission(w), 50.0) + model.bias]) for w in words]
    m = np.exp(model.trans)
    forward, backward = [], [np.ones(2)]
    for x in e:
        a = x if not forward else (forward[-1] @ m) * x
        forward.append(a / a.sum())
    for x in e[:0:-1]:
        b = m @ (x * backward[-1])
        backward.append(b / b.sum())
    p = [(a * b / (a @ b))[1] for a, b, w in zip(forward, backward[::-1], words, strict=False) if model.emission(w)]
    z = model.calibration @ [1, max(p, default=0.0), np.log1p(sum(p)), 1 - np.prod([1 - x for x in p])]
    return 1 / (1 + np.exp(-z))


def test_scores_equal_the_full_chain(spark):
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    assert model.weights
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - brute_score(model, toxicity.tokens(r.text))) < 1e-9


def test_training_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, f"{'x' * 100} {i}") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    assert 10 < len(toxicity.training_rows(frame(spark, rows), labels)[0]) < 20


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(rows[x.doc_id].predicted, x.toxic) for x in labels if rows[x.doc_id].held_out]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.95 * sum(p for p, _ in held) and hit >= 0.5 * sum(t for _, t in held)


# ---------------------------------------------------------------- pipeline


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns and after.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and after.count() == len(ids)
        if name == "ngram_jaccard_join":
            comp = linked([(r.doc_id, r.text) for r in before.collect()])
            assert ids == {i for i, (_, c) in comp.items() if c == i}
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_on_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "a b", "en", "s", 3)], docs.schema))
    odd = odd.unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(10**6, "other text", "en", "s", 0)], docs.schema))
    clashing = odd.select("*", *(F.lit(1).alias(c) for c in ("key", "row", "host", "line", "score", "n_words", "hits", "_drops", "_hits", "_score", "piece", "length")))
    for some in (docs.limit(0), odd, clashing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF)
            assert out.count() >= (0 if some.isEmpty() else 3)
