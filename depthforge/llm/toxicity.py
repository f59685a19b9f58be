"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Training, on the driver, over a bounded sample of labelled documents (``SAMPLE`` per class and ``SAMPLE_BYTES``, by
hash order, of repeated rows of an id the least text; rows whose crc32(doc_id as text) mod 4 is 2 are held out): words and word beginnings whose documents are
significantly more often toxic label tokens; a two-state chain (neutral, toxic) is fitted to windows around
those tokens by gradient ascent on the conditional likelihood; document features from its marginals are
calibrated by logistic regression.  Labels, language, source and ids are no inputs of a score.

Scoring, on the executors, one pass without shuffle over whole texts: tokens without a model feature all have
the same potential, so the exact forward-backward pass steps from one featured token to the next with powers
of the neutral transfer matrix.  The model is bounded (``FEATURES`` weights) whatever the corpus.

Null and empty texts get the score of a text without toxic tokens.  Conflicting labels of a document: toxic
wins; null labels don't count.  Without labels of both classes every score is the base rate (0 without any).
Repeated rows and rows with a null key are scored one by one; equal texts have equal scores.  Very long texts are
scored whole.  An empty table gives an empty result.  Rejecting keeps further columns, also with clashing names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import fresh, table, text_batches

#: Labelled documents at most of each class in the training sample.
SAMPLE = 2000
#: Bytes of their texts at most; in hash order, whole texts, the first that doesn't fit ends the sample.
SAMPLE_BYTES = 64_000_000
#: Weights at most in a model.
FEATURES = 20_000
#: Likelihood ratio from which a feature labels tokens (about 1 chance finding in 10 million).
SIGNIFICANT = 27.0
#: How many times as often a feature is in toxic documents as in clean ones, at least: common words of long
#: documents are significant too, but mark nothing.
LIFT = 10.0
THRESHOLD = 0.3
HELD_OUT = 2

WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NEAR = 7  # tokens of a training window on either side
STEPS = 256  # longest tabulated run of neutral tokens; longer ones are products of these


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings of 4 to 6 characters."""
    chars = word.decode("utf-8", "ignore")
    return [b"=" + word, *(b"^" + chars[:n].encode() for n in (4, 5, 6) if len(chars) >= n)]


def tokens(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(raw.translate(LOWER))


def _g2(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Signed likelihood ratio of a of na and b of nb documents; positive: likelier among the first."""
    share = (a + b) / (na + nb)
    ea, eb = na * share, nb * share
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / ea), 0) + np.where(b > 0, b * np.log(b / eb), 0))
    return np.where(a > ea, g, -g)


class Model:
    """weights: feature -> weight; bias: of the toxic state; trans: 2 x 2 log potentials; calibration: of the document features."""

    def __init__(self, weights: dict[bytes, float], bias: float, trans: np.ndarray, calibration: np.ndarray):
        self.weights, self.bias, self.trans, self.calibration = weights, bias, trans, calibration
        m = np.exp(trans + np.array([0.0, bias]))
        self.powers = [np.eye(2)]
        for _ in range(STEPS):
            p = self.powers[-1] @ m
            self.powers.append(p / p.sum())
        self.powers = [tuple(map(float, p.ravel())) for p in self.powers]
        self.step = m
        self.long: dict[int, tuple[float, ...]] = {}
        self.cache: dict[bytes, float] = {}

    def power(self, n: int) -> tuple[float, ...]:
        """The neutral transfer matrix to the power of n, up to a factor."""
        if n <= STEPS:
            return self.powers[n]
        if n not in self.long:
            if len(self.long) > 100_000:
                self.long.clear()
            half = np.array(self.power(n // 2)).reshape(2, 2)
            p = half @ half @ (self.step if n % 2 else np.eye(2))
            self.long[n] = tuple(map(float, (p / p.sum()).ravel()))
        return self.long[n]

    def emission(self, word: bytes) -> float:
        e = self.cache.get(word)
        if e is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            e = self.cache[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return e

    def marginals(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(position, probability of the toxic state) of the tokens with a model feature."""
        e = list(map(self.emission, words))
        at = [i for i, x in enumerate(e) if x]
        if not at:
            return []
        n, power, step = len(e), self.power, self.step
        m00, m01, m10, m11 = step[0, 0], step[0, 1], step[1, 0], step[1, 1]
        forward, alpha0, alpha1, last = [], 1.0, math.exp(self.bias), 0
        for k, i in enumerate(at):
            gap = i - last if k or i else 0
            p = power(gap)
            a0, a1 = alpha0 * p[0] + alpha1 * p[2], alpha0 * p[1] + alpha1 * p[3]
            a1 *= math.exp(min(e[i], 50.0))
            z = a0 + a1
            alpha0, alpha1, last = a0 / z, a1 / z, i
            forward.append((alpha0, alpha1))
        out = []
        p = power(n - 1 - at[-1])
        beta0, beta1 = p[0] + p[1], p[2] + p[3]
        for k in range(len(at) - 1, -1, -1):
            a0, a1 = forward[k]
            x0, x1 = a0 * beta0, a1 * beta1
            out.append((at[k], x1 / (x0 + x1)))
            if k:
                p = power(at[k] - at[k - 1])
                g0, g1 = beta0, beta1 * math.exp(min(e[at[k]], 50.0))
                beta0, beta1 = p[0] * g0 + p[1] * g1, p[2] * g0 + p[3] * g1
                z = beta0 + beta1
                beta0, beta1 = beta0 / z, beta1 / z
        return out[::-1]

    def score(self, marks: list[tuple[int, float]]) -> float:
        z = float(document_features([p for _, p in marks]) @ self.calibration)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def document_features(probabilities: list[float]) -> np.ndarray:
    """1, the largest marginal, log of 1 + their sum, probability that any token is toxic."""
    none, most, total = 1.0, 0.0, 0.0
    for p in probabilities:
        none *= 1 - p
        most = max(most, p)
        total += p
    return np.array([1.0, most, math.log1p(total), 1 - none])


def _fit_chain(idx: np.ndarray, gold: np.ndarray, valid: np.ndarray, n_features: int, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Conditional likelihood of gold (windows x length) under feature ids idx (windows x length x features; 0: none)."""
    n, t = gold.shape
    w = np.zeros(n_features + 1)
    bias, trans = -2.0, np.zeros((2, 2))
    onehot = np.stack([1 - gold, gold], -1) * valid[..., None]
    steps = valid[:, 1:]
    observed = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros(5), np.zeros(5)]
    for r in range(1, rounds + 1):
        e = np.zeros((n, t, 2))
        e[..., 1] = (w[idx].sum(-1) + bias) * valid
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = e[:, 0]
        for i in range(1, t):
            nxt = np.logaddexp(a[:, i - 1, 0, None] + trans[0], a[:, i - 1, 1, None] + trans[1]) + e[:, i]
            a[:, i] = np.where(valid[:, i, None], nxt, a[:, i - 1])
        for i in range(t - 2, -1, -1):
            x = e[:, i + 1] + b[:, i + 1]
            prev = np.logaddexp(trans[:, 0] + x[:, 0, None], trans[:, 1] + x[:, 1, None])
            b[:, i] = np.where(steps[:, i, None], prev, b[:, i + 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        node = np.exp(a + b - z[:, None, None])[..., 1] * valid
        edge = np.exp(a[:, :-1, :, None] + trans + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * steps[..., None, None]
        diff = (onehot[..., 1] - node) / n
        gw = np.bincount(idx.ravel(), np.repeat(diff.ravel(), idx.shape[-1]), minlength=len(w)) - 1e-4 * w
        gw[0] = 0
        gs = np.concatenate(([diff.sum()], ((observed - edge.sum((0, 1))) / n - 1e-4 * trans).ravel()))
        for k, g in ((0, gw), (2, gs)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
        move = lambda k: 0.3 * (state[k] / (1 - 0.9**r)) / (np.sqrt(state[k + 1] / (1 - 0.99**r)) + 1e-8)
        w = w + move(0)
        s = move(2)
        bias, trans = bias + s[0], trans + s[1:].reshape(2, 2)
    return w, float(bias), trans


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 0.1
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * beta)
    return beta


def distinct(docs: list[list[bytes]]) -> list[int]:
    """Numbers of the documents that aren't copies or near copies of an earlier one: those that share fewer than two of their four least three-word hashes."""
    seen: set[int] = set()
    out = []
    for i, d in enumerate(docs):
        least = sorted({zlib.crc32(b" ".join(d[k : k + 3])) for k in range(max(1, len(d) - 2))})[:4]
        if len(least) < 2 or sum(h in seen for h in least) < 2:
            out.append(i)
        seen.update(least)
    return out


def train(rows: list[tuple[str | None, int]], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit to (text, toxic) rows; ``weights``: of a clean and of a toxic row, to undo sampling by class."""
    base = sum(weights[1] for _, y in rows if y)
    every = base + sum(weights[0] for _, y in rows if not y)
    flat = Model({}, -2.0, np.zeros((2, 2)), np.array([math.log(max(base, 1e-9) / max(every - base, 1e-9)) if every else -50.0, 0, 0, 0]))
    toxic = [bool(y) for _, y in rows]
    shared: dict[bytes, bytes] = {}  # each distinct word once in memory
    docs = [[shared.setdefault(w, w) for w in tokens(t)] for t, _ in rows]
    del rows, shared
    own = distinct(docs)  # a text counts once however often it is copied
    docs, toxic = [docs[i] for i in own], [toxic[i] for i in own]
    na, nb = sum(toxic), len(docs) - sum(toxic)
    if not na or not nb:
        return flat
    counts = (Counter(), Counter())
    for d, y in zip(docs, toxic, strict=True):
        if y:
            counts[0].update({f for w in set(d) for f in features(w)})
    names = sorted(f for f, c in counts[0].items() if c >= 3)
    known = set(names)
    for d, y in zip(docs, toxic, strict=True):
        if not y:
            counts[1].update({f for w in set(d) for f in features(w)} & known)
    if not names:
        return flat
    g = _g2(np.array([counts[0][f] for f in names], float), np.array([counts[1][f] for f in names], float), na, nb)
    lift = np.array([(counts[0][f] + 0.5) / (na + 1) / (counts[1][f] + 0.5) * (nb + 1) for f in names])
    chosen = sorted((i for i in np.argsort(-g, kind="stable")[:FEATURES] if g[i] >= 12 and lift[i] >= LIFT), key=lambda i: names[i])
    number = {names[i]: k + 1 for k, i in enumerate(chosen)}
    marks = {names[i] for i in chosen if g[i] >= SIGNIFICANT}
    if not marks:
        return flat
    rng = np.random.default_rng(0)
    t, per = 2 * NEAR + 1, 4
    idx, gold, valid = [], [], []
    for d, y in zip(docs, toxic, strict=True):
        is_marked = [any(f in marks for f in features(w)) for w in d]
        centres = [i for i, m in enumerate(is_marked) if m]
        centres += [int(i) for i in rng.integers(0, len(d), 2)] if d else []
        for c in centres:
            row, lab, ok = np.zeros((t, per), np.int64), np.zeros(t, np.int64), np.zeros(t, bool)
            for k, i in enumerate(range(max(0, c - NEAR), min(len(d), c + NEAR + 1))):
                row[k, :] = [*(number.get(f, 0) for f in features(d[i])), 0, 0, 0][:per]
                lab[k], ok[k] = y and is_marked[i], True
            idx.append(row)
            gold.append(lab)
            valid.append(ok)
    w, bias, trans = _fit_chain(np.array(idx), np.array(gold), np.array(valid), len(number))
    model = Model({f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-3}, bias, trans, flat.calibration)
    x = np.array([document_features([p for _, p in model.marginals(d)]) for d in docs])
    y = np.array(toxic, float)
    model.calibration = _logistic(x, y, np.where(y > 0, weights[1], weights[0]))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", label: str = "toxic"):
    """The bounded sample's (text, label) rows and the weights of the classes."""
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [usable.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * sample rows at most
    texts = docs.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text")).join(chosen, "k").groupBy("k").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    taken, size = [], 0
    for r in texts.orderBy(F.xxhash64("k"), "k").toLocalIterator():
        size += len(r.text or "")
        if taken and size > SAMPLE_BYTES:
            break
        taken.append(r)
    rows = [(r.text, r.y) for r in sorted(taken, key=lambda r: r.k)]
    have = Counter(y for _, y in rows)
    return rows, tuple(total.get(y, 0) / have[y] if have[y] else 1.0 for y in (0, 1))


def held_out(key) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT


def scored(docs: DataFrame, model: Model, added: list[str], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with columns named as ``added``: score, 0 or 1 by ``threshold``, and toxic spans: [start, end) code point offsets of words likelier toxic than not, as "start:end" joined by commas."""
    docs = docs.withColumn(text, F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)
    value = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.trans, model.calibration))

    def spans(raw: bytes, marks) -> str:
        wanted_at = {i for i, p in marks if p >= 0.5}
        if not wanted_at:
            return ""
        out, chars, last = [], 0, 0
        for i, m in enumerate(WORD.finditer(raw.translate(LOWER))):
            if i in wanted_at:
                chars += len(raw[last : m.start()].decode())
                out.append(f"{chars}:{chars + len(m.group().decode())}")
                last = m.start()
        return ",".join(out)

    def run(batches):
        fitted = Model(*value.value)
        for batch in batches:
            scores, found = [], []
            for t in batch.column(at).cast(pa.binary()):
                raw = t.as_py() or b""
                marks = fitted.marginals(tokens(raw))
                scores.append(fitted.score(marks))
                found.append(spans(raw, marks))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, pa.string())],
                names=[*batch.schema.names, *added],
            )

    return text_batches(docs).mapInArrow(run, f"{schema}, `{added[0]}` double, `{added[1]}` int, `{added[2]}` string")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Train on ``labels`` of ``docs`` and score every row of ``docs``: (key, score, predicted, toxic_spans)."""
    slim = docs.select(F.col(key), F.col("text").cast("string").alias("text"))
    added = ["score", "predicted", "toxic_spans"]
    return scored(slim, train(*training_rows(docs, labels, sample, key)), added, threshold)[[key, *added]]


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, each judged by its own text; nothing is joined or shuffled."""
    added = fresh(docs.columns, "_score", "_predicted", "_spans")
    return scored(docs, train(*training_rows(docs, labels, sample, key)), added, threshold).where(F.col(added[1]) == 0).select(docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")
