"""Alignment of two tokenisers by a dangling-suffix transducer, and how often their tokens end together.

Both tokenisers spell the same bytes.  The transducer's state says which side leads and the bytes by which it does; the
next token is the other side's, and its bytes leave a new residual.  Where the residual is empty both sides end, and a
group of tokens closes.  States are shared by all texts of a worker and remember their transitions, so a token costs a
look-up; a worker that holds more than ``TRANSITIONS`` drops them between texts, which changes no result.

The last tokens of a group end together: a link.  Links of an id pair are counted over all documents by partial sums.
The counts go back to the documents: the pairs of the highest counts, ``BROADCAST_PAIRS`` of them at most, by broadcast,
the others by a join on the pair.  Such a pair has a small share of all links, so that no key of the join is hot.

Null and empty texts have no tokens, nor have texts that either tokeniser doesn't spell byte for byte (white space marks
in the text, say).  Special tokens' strings are plain text.  Repeated rows count one by one.  A pair tied for its second
id's highest count is a best one.  Very long texts are encoded whole.  An empty table gives an empty result.  Only
the key and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depthforge.llm.common import stored, table, text_batches
from depthforge.llm.packing import UNSTABLE

#: A pair of ids is one number: first id times this, plus second id.
BASE = 1 << 20
#: Pairs that are broadcast at most: two longs and a flag each.
BROADCAST_PAIRS = 1_000_000
#: Transitions that a worker remembers from one text to the next.
TRANSITIONS = 500_000
#: Characters of texts whose results are handed on at once.
CHUNK = 500_000

# ---------------------------------------------------------------- tokenisers


def byte_level() -> dict[str, int]:
    """The character of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokeniser file: encodes a space and the text.  The same vocabulary as ranks serves texts of stable character classes."""

    def __init__(self, path: str, ranks: str | None = None):
        import base64

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        byte, special = byte_level(), self.slow.get_added_tokens_decoder()
        self.tokens = [b""] * self.slow.get_vocab_size()
        for token, i in self.slow.get_vocab().items():
            self.tokens[i] = token.encode() if i in special else bytes(byte[c] for c in token)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or UNSTABLE.search(text):
            return self.slow.encode(f" {text}", add_special_tokens=False).ids
        return self.fast.encode_ordinary(f" {text}")


class Pieces:
    """A sentence-piece model that puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        spell = lambda i, piece: bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        self.tokens = [spell(i, self.model.id_to_piece(i)) for i in range(size)]

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def default_tokenizers():
    """Paths of the byte-level file, its ranks and the sentence-piece model."""
    import public_tokenizers

    return tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


# ---------------------------------------------------------------- transducer


class State(dict):
    """Who leads (1: the first side, 0: nobody, the first side is next, -1: the second side) and by which bytes; next state by token."""

    __slots__ = ("lead", "rest", "home")

    def __init__(self, lead: int, rest: bytes, home: Transducer):
        super().__init__()
        self.lead, self.rest, self.home = lead, rest, home

    def __missing__(self, token: int) -> State:
        side = 1 if self.lead <= 0 else -1
        spelled = self.home.tokens[side][token]
        if not spelled:
            raise ValueError(f"token {token} has no bytes")
        if self.rest.startswith(spelled):
            to = self.home.state(self.lead, self.rest[len(spelled) :])
        elif spelled.startswith(self.rest):
            to = self.home.state(side, spelled[len(self.rest) :])
        else:
            to = self.home.apart
        self[token] = to
        self.home.known += 1
        return to


class Apart(State):
    """The sides don't spell the same: nothing leads out of here."""

    __slots__ = ()

    def __missing__(self, token: int) -> State:
        return self


class Transducer:
    def __init__(self, first: list[bytes], second: list[bytes]):
        self.tokens = {1: first, -1: second}
        self.states: dict[tuple[int, bytes], State] = {}
        self.start, self.apart, self.known = self.state(0, b""), Apart(0, b"", self), 0

    def state(self, lead: int, rest: bytes) -> State:
        at = (lead if rest else 0, rest)
        if at not in self.states:
            self.states[at] = State(*at, self)
        return self.states[at]

    def forget(self, bound: int) -> None:
        """Drop the states if they hold more than ``bound`` transitions."""
        if self.known > bound:
            for s in self.states.values():
                s.clear()  # they name each other
            self.states.clear()
            self.start, self.known = self.state(0, b""), 0

    def cuts(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of each side precede the end of each group; None if the sides don't spell the same."""
        start = state = self.start
        i = j = 0
        ends_a, ends_b, following = [], [], iter(b).__next__
        try:
            for token in a:
                state = state[token]
                i += 1
                while state.lead > 0:
                    state = state[following()]
                    j += 1
                if state is start:
                    ends_a.append(i)
                    ends_b.append(j)
        except StopIteration:
            return None
        return (ends_a, ends_b) if state is start and j == len(b) else None


_loaded: dict = {}


def _worker(paths: tuple):
    """The tokenisers, the transducer and the digits of this process."""
    if paths not in _loaded:
        first, second = ByteLevel(*paths[:2]), Pieces(paths[2])
        _loaded[paths] = first, second, Transducer(first.tokens, second.tokens), Decimals(max(len(first.tokens), len(second.tokens)))
    return _loaded[paths]


def aligned(text: str | None, first, second, transducer: Transducer):
    """(ids, ids, ends, ends) of a text, all empty if it has no tokens."""
    none = [], [], [], []
    if not text:
        return none
    a, b = first(text), second(text)
    ends = transducer.cuts(a, b)
    if ends is None or b"".join(map(first.tokens.__getitem__, a)) != f" {text}".encode():
        return none
    return a, b, *ends


class Decimals:
    """The ids up to a bound of seven digits: their decimals in the bytes of a number, and how many bits those take."""

    def __init__(self, bound: int):
        if bound > 10**7:
            raise ValueError("ids have seven digits at most")
        text = np.array([str(i) for i in range(bound)], dtype="S8")
        self.digits, self.bits = text.view("<u8"), (8 * np.char.str_len(text)).astype("<u8")


def spelled_groups(a, b, ends_a, ends_b, decimals: Decimals) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of the groups."""
    if not len(ends_a):
        return b""
    a, b, ends_a, ends_b = (np.asarray(x, np.int64) for x in (a, b, ends_a, ends_b))
    # a token's place: the tokens of its own side before it, and those of the other side's groups before
    groups = np.arange(len(ends_a))
    of_a, of_b = np.repeat(groups, np.diff(ends_a, prepend=0)), np.repeat(groups, np.diff(ends_b, prepend=0))
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), "<u8")
    before_b = np.concatenate([[0], ends_b[:-1]])
    ids[np.arange(len(a)) + before_b[of_a]] = a
    ids[np.arange(len(b)) + ends_a[of_b]] = b
    marks[ends_a + before_b - 1] = ord("|")
    marks[ends_a + ends_b - 1] = ord(";")
    return (decimals.digits[ids] | marks << decimals.bits[ids]).tobytes().translate(None, b"\0")[:-1]


# ---------------------------------------------------------------- operator


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple | None = None) -> DataFrame:
    """(key, a_ids, b_ids, a_ends, b_ends) per row: both sides' tokens and how many of them precede the end of each group."""
    paths = tuple(tokenizers or default_tokenizers())
    wanted = text_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["key"].dataType.simpleString()
    ints = pa.list_(pa.int32())

    def run(batches):
        worker = _worker(paths)
        for batch in batches:
            rows = []
            for r in batch.column("text"):
                worker[2].forget(TRANSITIONS)
                rows.append(aligned(r.as_py(), *worker[:3]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([r[k] for r in rows], ints) for k in range(4))], names=["key", "a_ids", "b_ids", "a_ends", "b_ends"])

    return wanted.mapInArrow(run, f"key {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) per row, of the same alignment: its distinct linked pairs and how often each is linked."""
    paths = tuple(tokenizers or default_tokenizers())
    wanted = text_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["key"].dataType.simpleString()
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def emit(keys, done):
        counts = [pa.array([d[k] for d in done], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([keys, *counts, pa.array([d[4] for d in done], pa.string()), pa.array([d[5] for d in done], pa.list_(pa.int64())), pa.array([d[6] for d in done], pa.list_(pa.int32()))], names=names)

    def run(batches):
        first, second, transducer, decimals = _worker(paths)
        for batch in batches:
            done, size, begun = [], 0, 0
            for i, r in enumerate(batch.column("text")):
                value = r.as_py()
                transducer.forget(TRANSITIONS)
                a, b, ends_a, ends_b = aligned(value, first, second, transducer)
                a, b, ends_a, ends_b = (np.array(x, np.int64) for x in (a, b, ends_a, ends_b))
                digest = hashlib.sha256(spelled_groups(a, b, ends_a, ends_b, decimals)).hexdigest() if len(ends_a) else ""
                pair = a[ends_a - 1] * BASE + b[ends_b - 1]
                pairs, times = np.unique(pair, return_counts=True)
                done.append((len(a), len(b), len(ends_a), len(ends_a), digest, pairs, times.astype(np.int32)))
                size += len(value or "")
                if size > CHUNK:
                    yield emit(batch.column("key").slice(begun, len(done)), done)
                    done, size, begun = [], 0, i + 1
            yield emit(batch.column("key").slice(begun), done)

    return wanted.mapInArrow(run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair over all rows, and whether no pair of its second id has more."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    most = F.max("n").over(W.partitionBy(F.col("pair") % BASE))  # a window holds as many rows as there are first ids
    return stored(each.withColumn("best", F.col("n") == most), few=True)


def frequent(counts: DataFrame, bound: int) -> int:
    """The least power of two such that ``bound`` pairs at most have so many links."""
    bits = {int(r.k): r.pairs for r in counts.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count(F.lit(1)).alias("pairs")).collect()}  # 63 rows at most
    k, held = max(bits, default=0), 0
    while k > 0 and held + bits.get(k, 0) <= bound:
        held += bits.get(k, 0)
        k -= 1
    return 1 << k


def scored(linked: DataFrame) -> DataFrame:
    """The rows of ``linked``, a written table of :func:`links` with a number ``row``, with n_best and count_sum in place of the pairs."""
    counts = pair_counts(linked)
    least = frequent(counts, BROADCAST_PAIRS)
    own = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    one = linked.select("row", *own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x"))
    one = one.select("row", *own, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = one.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    total = lambda n, best: [F.sum(F.when(best, F.col("times")).otherwise(0)).alias("n_best"), F.coalesce(F.sum(F.col("times") * n), F.lit(0)).alias("count_sum")]
    rare = counts.where(F.col("n") < least)
    if not rare.limit(1).count():
        return met.groupBy("row", *own).agg(*total(F.col("n"), F.col("best"))).drop("row")
    here = met.groupBy("row", *own).agg(*total(F.col("n"), F.col("best")))
    left = met.where("pair is not null and n is null").select("row", "pair", "times").join(rare, "pair").groupBy("row").agg(*total(F.col("n"), F.col("best")))
    both = here.join(left.select("row", F.col("n_best").alias("b2"), F.col("count_sum").alias("c2")), "row", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select(*own, add("n_best", "b2"), add("count_sum", "c2"))


def op11(spark, sf_dir: str) -> DataFrame:
    linked = links(table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id())
    return scored(stored(linked)).withColumnRenamed("key", "doc_id")
