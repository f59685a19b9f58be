"""N-gram Jaccard join: groups of documents whose sets of five-word shingles are alike, by a grouped prefix join.

A document's shingles are ordered rarest first, by the exact number of documents that hold them (equal
sets and rows of one key count once a batch).  Two sets with a
Jaccard similarity of 3/4 share three shingles among the first n - ceil(3n/4) + 3 of each; shingles of one document
alone fill the front of the order and link nothing, so only documents that share most of their text have any to join.

Frequencies are counted where a shingle's entries meet, one entry a batch, and answered to the batches, which keep the
prefixes of their own documents: no row is made per document and shingle.

1. Equal sets collapse to their smallest document, and documents of equal size and prefix to one group.
2. Groups are filtered by shared prefix shingles (three at least, and as many as the sizes ask for) and size.
3. Groups are expanded to members and pairs verified on whole sets.  First each member meets at most two
   pivots, the smallest documents it shares most prefix shingles with; then a few heads of each group meet members of
   other components, then more heads, and so on, until components have met or all their pairs are verified.  So no
   link between components is lost, and the members of a group of near copies, joined by pivots or heads, aren't paired.

Shingles travel as compressed columns; copies within a batch don't travel.  Components come from
:mod:`depthforge.llm.components`.  Null and empty texts have no shingles and no links; texts of 1 to 4 words have
one.  Keys are bigint; a row with a null key is linked with nothing and its component_id is null.  Rows repeated
under one key are one document whose sets are all joined, and each row has its own n_shingles.  Ties go to the
smaller key.  Very long texts are shingled whole.  An empty table gives an empty result.  Only the key and the text
are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthforge.llm.common import SPACES, partitions, stored, table, text_batches
from depthforge.llm.components import components
from depthforge.llm.decontam import LOWER
from depthforge.llm.repeats import BATCH, SPLIT, Hasher, U, dealt, first_of_run, firsts, mix, pack_columns, text_slices, unpack_columns
from depthforge.llm.substrings import word_values

SHINGLE = 5
SHARED = 3
#: Pairs up to which their documents' keys (two longs each) are broadcast to the texts; beyond, texts are shuffled.
BROADCAST_PAIRS = 1_000_000
#: Members of a group that meet its others first, and the growth of their number from turn to turn.
HEADS = 8


def shingle_sets(raws: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    values = word_values([r.translate(LOWER) for r in raws])
    sizes = np.array([len(v) for v in values])
    if not sizes.sum():
        return [np.zeros(0, U)] * len(raws)
    ends = np.cumsum(sizes)
    h = Hasher(np.concatenate(values))
    every = h.windows(shingle) if len(h.sums) > shingle else np.zeros(0, U)
    out = []
    for e, n in zip(ends, sizes, strict=True):
        if n >= shingle:
            out.append(np.unique(every[e - n : e - shingle + 1]))
        else:
            out.append(mix(h(np.array([e - n]), np.array([e])) + U(n)) if n else np.zeros(0, U))
    return out


SETS = (8, 8, 8, 8)  # set (two columns), size, key
TOKENS = (8, 4)  # shingle (40 bits, as differences), documents of the batch that have it
ANSWERS = (4, 4)  # documents that have a shingle, its number among those of two (as differences)
OWN = ((8, 8), (4,), (4,))  # a batch's documents: key, size; documents of each shingle; these documents' places
TOKEN_BITS = U((1 << 40) - 1)
#: Documents of a batch from which :func:`shared_shingles` gives one list of keys.
COMMON_FROM = 16


def counted_batches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(kind, a, b, n, blob) of ``docs`` (key, text), by kind.

    1: document a has the set of b, of n shingles.  Others are of batch a: its own documents and sets (b < 0), and
    what bucket b answers about its shingles, in the batch's order.  A batch sends each distinct shingle once, with the
    number of its documents, so a shingle that all documents have is one entry a batch.
    """
    buckets = SPLIT * partitions(docs.sparkSession)

    def flush(held, place):
        """Rows of a batch's documents (key, set)."""
        by_set: dict[bytes, list] = {}
        for key, s in held:
            one = by_set.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), [key, s, []])
            one[0] = min(one[0], key)
            one[2].append(key)
        rows = []
        copies = [(key, one[0], len(one[1])) for one in by_set.values() for key in one[2] if key != one[0]]
        if copies:
            a, b, n = (np.array(x, np.int64).view(U) for x in zip(*copies, strict=True))
            rows.append((int(a[0] % U(buckets)), 2, pack_columns([a, b, n], (8, 8, 8))))
        owners = np.array([one[0] for one in by_set.values()], np.int64).view(U)
        sizes = np.array([len(one[1]) for one in by_set.values()])
        sid = np.frombuffer(b"".join(by_set), U).reshape(-1, 2)
        rows += _dealt(mix(sid[:, 0]), [sid[:, 0], sid[:, 1], sizes.astype(U), owners], 1, SETS, buckets)
        tokens, who = np.concatenate([one[1] for one in by_set.values()]), np.repeat(np.arange(len(sizes)), sizes)
        bucket = mix(tokens) % U(buckets)
        order = np.argsort((bucket << U(40)) | (tokens & TOKEN_BITS), kind="stable")
        tokens, bucket, who = tokens[order], bucket[order], who[order]
        starts = np.flatnonzero(firsts(bucket, tokens & TOKEN_BITS))
        held_by = np.diff(np.append(starts, len(tokens)))
        rows += _dealt(bucket[starts], [tokens[starts] & TOKEN_BITS, held_by.astype(U)], 0, TOKENS, buckets)
        for i, cols in enumerate(([owners, sizes.astype(U)], [held_by.astype(U)], [who.astype(U)])):
            rows.append((place % buckets, 3 + i, pack_columns(cols, OWN[i])))
        # by content, so answers to another attempt at these rows can't be taken for this one's
        name = hashlib.blake2b(b"%d %d" % (place, len(held)) + owners.tobytes() + b"".join(by_set), digest_size=8).digest()
        cols = [[r[0] for r in rows], [r[1] for r in rows], [int.from_bytes(name, "little", signed=True)] * len(rows), [place] * len(rows), [r[2] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "batch", "place", "blob"])

    def send(batches):
        held, n, place = [], 0, 31 * TaskContext.get().partitionId()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for lo, hi, raws in text_slices(batch.column("text")):
                for key, s in zip(keys[lo:hi], shingle_sets(raws, shingle), strict=True):
                    if len(s):
                        held.append((key, s))
                        n += len(s)
                    if n >= BATCH:
                        yield flush(held, place)
                        held, n, place = [], 0, place + 1
        if held:
            yield flush(held, place)

    def row_batch(kind, *cols):
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([kind] * len(cols[0]), *cols), types, strict=True)], names=["kind", "a", "b", "n", "blob"])

    def out(*cols):
        for a in range(0, len(cols[0]), 200_000):
            part = [c[a : a + 200_000] for c in cols]
            yield row_batch(1, *(c.view(np.int64) for c in part), [None] * len(part[0]))

    def decide_tokens(parts, senders, bucket):
        cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
        tok, held_by = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.argsort(tok, kind="stable")
        first = firsts(tok[order])
        documents = np.add.reduceat(held_by[order], np.flatnonzero(first))
        of = np.empty(len(tok), np.int64)
        of[order] = np.cumsum(first) - 1
        number = np.cumsum(documents > 1) - (documents > 1)
        blobs = [pack_columns([documents[of[a:b]], np.diff(number[of[a:b]], prepend=0).astype(U)], ANSWERS) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield row_batch(0, [s[0] for s in senders], [bucket] * len(senders), [s[1] for s in senders], blobs)

    def decide_sets(parts, senders, bucket):
        s1, s2, n, key = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((key.view(np.int64), s2, s1))
        s1, s2, n, key = (x[order] for x in (s1, s2, n, key))
        yield from out(key, key[first_of_run(firsts(s1, s2))], n)

    def decide(batches):
        held, senders, current = [], [], None

        def done():
            if held:
                yield from (decide_sets if current[1] else decide_tokens)(held, senders, current[0])

        for batch in batches:
            for bucket, kind, sender, place, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "batch", "place", "blob")), strict=True):
                if kind == 2:
                    yield from out(*unpack_columns(blob, (8, 8, 8)))
                    continue
                if kind >= 3:
                    yield row_batch(0, [sender], [kind - 6], [place], [blob])
                    continue
                if (bucket, kind) != current:
                    yield from done()
                    held, senders, current = [], [], (bucket, kind)
                columns = unpack_columns(blob, SETS if kind else TOKENS)
                if not kind:
                    columns[0] = np.cumsum(columns[0])
                held.append(columns)
                senders.append((sender, place))
        yield from done()

    sent = text_batches(docs).where("key is not null").mapInArrow(send, "bucket int, kind int, batch bigint, place bigint, blob binary")
    return stored(dealt(sent).mapInArrow(decide, "kind int, a bigint, b bigint, n bigint, blob binary"))


def _by_batch(found: DataFrame, body, schema: str) -> DataFrame:
    """``body`` of each batch of ``found``: keys and sizes of its documents, how many of them have each shingle, which (shingle by shingle), and the shingles' frequencies and numbers."""

    def whole(parts):
        (keys, sizes), (held_by,), (who,) = (unpack_columns(blob, planes) for (_, blob), planes in zip(parts, OWN, strict=False))
        df, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for bucket, blob in parts[3:]:
            d, n = (c.astype(np.int64) for c in unpack_columns(blob, ANSWERS))
            df.append(d)
            number.append(np.cumsum(n) + (bucket << 40))
        df, number = np.concatenate(df), np.concatenate(number)
        if [b for b, _ in parts[:3]] != [-3, -2, -1] or len(df) != len(held_by):
            raise RuntimeError("the answers to a batch aren't of its shingles: its rows were read again in another order")
        return body(keys.view(np.int64), sizes.astype(np.int64), held_by.astype(np.int64), who.astype(np.int64), df, number)

    def run(batches):
        current, parts = None, []
        for batch in batches:
            for name, b, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "blob")), strict=True):
                if name != current:
                    if parts:
                        yield from whole(parts)
                    current, parts = name, []
                parts.append((b, blob))
        if parts:
            yield from whole(parts)

    n = partitions(found.sparkSession)
    rows = found.where("kind = 0").select("a", "b", "n", "blob")
    return rows.repartitionById(n, F.pmod("n", F.lit(n)).cast("int")).sortWithinPartitions("a", "b").mapInArrow(run, schema)


def shared_shingles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(kind, a, b, n, keys): the shingles that two documents at least have, :func:`counted_batches` spelled out.

    0: shingle a is in the set of b and in n documents.  2: shingle a, of COMMON_FROM documents of a batch, is in the
    sets of keys.  3: that shingle a is shingle b of kind 0, in n documents.
    """
    common_from = COMMON_FROM

    def body(keys, sizes, held_by, who, df, number):
        ends, many, common = np.cumsum(held_by), df > 1, held_by >= common_from

        def rows(kind, a, b, n, lists):
            cols = [pa.nulls(len(a), pa.int64()) if c is None else pa.array(c) for c in (a, b, n)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *cols, pa.array(lists or [None] * len(a), pa.list_(pa.int64()))], names=["kind", "a", "b", "n", "keys"])

        each = np.repeat(many & ~common, held_by)
        yield rows(0, np.repeat(number, held_by)[each], keys[who[each]], np.repeat(df, held_by)[each], None)
        j = np.flatnonzero(many & common)
        yield rows(2, number[j], None, None, [keys[who[e - m : e]] for e, m in zip(ends[j], held_by[j], strict=True)])
        yield rows(3, number[j], number[j], df[j], None)

    return _by_batch(counted_batches(docs, shingle), body, "kind int, a bigint, b bigint, n bigint, keys array<bigint>")


def prefixes(found: DataFrame) -> DataFrame:
    """(key, n, held, toks) of ``found``: sets of n shingles, held of them in other documents too, and of these the ones in the set's prefix, in order.

    Shingles of one document alone come first, and there are n - held of them; the others come by frequency and
    number.  Sets whose prefix has none of them are left out: they're like no other.
    """

    def body(keys, sizes, held_by, who, df, number):
        order = np.lexsort((number, df))
        rank = np.empty(len(df), np.int64)
        rank[order] = np.arange(len(df))
        many = np.repeat(df > 1, held_by)
        placed = np.sort((who[many] << 32) | np.repeat(rank, held_by)[many])
        doc, tok = placed >> 32, number[order[placed & 0xFFFFFFFF]]
        held = np.bincount(doc, minlength=len(keys))
        before = np.arange(len(doc)) - (np.cumsum(held) - held)[doc]
        alone, length = sizes - held, np.minimum(sizes, sizes - (3 * sizes + 3) // 4 + SHARED)
        kept = alone[doc] + before < length[doc]
        counts = np.bincount(doc[kept], minlength=len(keys))
        some = counts > 0
        toks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts[some]]), pa.int32()), pa.array(tok[kept]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(sizes[some]), pa.array(held[some]), toks], names=["key", "n", "held", "toks"])

    return _by_batch(found, body, "key bigint, n bigint, held bigint, toks array<bigint>")


def _dealt(by: np.ndarray, cols: list[np.ndarray], kind: int, planes: tuple[int, ...], buckets: int) -> list[tuple[int, int, bytes]]:
    """Columns dealt into buckets by a hash and sorted by the first; of shingles (kind 0), differences are kept."""
    bucket = (by % U(buckets)).astype(np.int64)
    order = np.lexsort((cols[0], bucket))
    bucket, cols = bucket[order], [c[order] for c in cols]
    cuts = np.flatnonzero(np.concatenate((firsts(bucket), [True])))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = [c[a:b] for c in cols]
        if kind == 0:
            part[0] = np.diff(part[0], prepend=U(0))
        rows.append((int(bucket[a]), kind, pack_columns(part, planes)))
    return rows


def _least(n) -> F.Column:
    """Shingles that sets alike to one of n share with it at least."""
    return F.floor((3 * F.col(n) + 3) / 4)


def in_core(a: str, b: str, pos_a: str, pos_b: str):
    """Whether a shared shingle stands early enough in both orders to be the first that alike sets of a and b share.

    A shared shingle outside both prefixes lies behind the prefix that ends first, so alike sets, which share 3/7 of
    both sizes, share all of that but ceil(3n/4) - SHARED within both prefixes; the first of k shared ones has k - 1
    behind it in each prefix.
    """
    k = F.greatest(F.lit(SHARED), F.floor((3 * (F.col(a) + F.col(b)) + 6) / 7) - F.greatest(_least(a), _least(b)) + SHARED)
    last = lambda n: F.least(F.col(n), F.col(n) - _least(n) + SHARED) - k + 1
    return (F.col(pos_a) <= last(a)) & (F.col(pos_b) <= last(b))


def may_be_alike(a: str, b: str, held_a: str, held_b: str):
    """Whether sets of sizes a and b, of which held_a and held_b shingles are in other documents too, can be alike: they share 3/7 of both sizes."""
    least = F.floor((3 * (F.col(a) + F.col(b)) + 6) / 7)
    return similar_sizes(a, b) & (F.col(held_a) >= least) & (F.col(held_b) >= least)


def _verified(pairs: DataFrame, slim: DataFrame, shingle: int) -> DataFrame:
    """The (u, v) of ``pairs`` (a written table) whose sets in ``slim`` (key, text) have 4 * shared >= 3 * united."""
    keys = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs
    if n_pairs <= BROADCAST_PAIRS:
        keys = F.broadcast(keys)

    def collect_sets(batches):
        for batch in batches:
            for lo, hi, raws in text_slices(batch.column("text")):
                some = [s.view(np.int64) for s in shingle_sets(raws, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(some, pa.list_(pa.int64()))], names=["key", "shingles"])

    sets = stored(slim.join(keys, "key").select("key", "text").mapInArrow(collect_sets, "key bigint, shingles array<bigint>"))
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s_{k}")) for k in ("u", "v"))
    shared = F.size(F.array_intersect("s_u", "s_v"))
    both = pairs.join(left, "u").join(right, "v")
    return both.where(4 * shared >= 3 * (F.size("s_u") + F.size("s_v") - shared)).select("u", "v")


def similar_sizes(a: str, b: str):
    return (4 * F.col(a) >= 3 * F.col(b)) & (4 * F.col(b) >= 3 * F.col(a))


def _labelled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, grp, turn) with their component, and groups with their lowest and highest component and last turn."""
    label = components(links).withColumnRenamed("node", "key")
    labelled = stored(members.join(label, "key", "left").select("key", "grp", "turn", F.coalesce("component", "key").alias("comp")), few=True)
    return labelled, labelled.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("turn").alias("last"))


def _turns(members: DataFrame) -> DataFrame:
    """``members`` (key, grp) with their turn: some HEADS of a group have turn 0, HEADS times as many the next, and so on.

    A key's hash says how many of its group are expected before it, so no group is sorted; those of at most HEADS members have turn 0 only.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    before = F.col("m") * (F.pmod(F.xxhash64("key"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    return members.join(sizes, "grp").select("key", "grp", F.greatest(F.lit(0), F.ceil(F.log(float(HEADS), before)) - 1).cast("int").alias("turn"))


def _between(todo: DataFrame, labelled: DataFrame, turn: int) -> DataFrame:
    """The (u, v) of the pairs of groups ``todo`` whose components differ and of whose turns the earlier one is ``turn``."""
    here, later = labelled.where(F.col("turn") == turn), labelled.where(F.col("turn") > turn)

    def pairs(one, two):
        one, two = (x.select(F.col("grp").alias(f"grp_{i}"), F.col("key").alias(k), F.col("comp").alias(f"comp_{i}")) for x, i, k in ((one, 1, "u"), (two, 2, "v")))
        return todo.join(one, "grp_1").join(two, "grp_2").where("comp_1 <> comp_2 and (grp_1 < grp_2 or u < v)").select("u", "v")

    return pairs(here, here.unionByName(later)).unionByName(pairs(later, here)).distinct()


def _late(members: DataFrame, tokens: DataFrame, links: DataFrame, slim: DataFrame, shingle: int) -> DataFrame:
    """``links`` with those between members (key, grp) whose components ``links`` leave apart.

    Every such pair of two groups with enough shared shingles, or of one group, has its turn, that of the earlier
    member.  Between turns components are found anew and what has met is left out, so a few heads join near copies
    to each other; only members that stay apart to the end are verified pair by pair.
    """
    members = stored(_turns(members), few=True)
    labelled, spread = _labelled(members, links)
    placed = tokens.select("tok", "grp", "n", "held", "pos").join(spread, "grp")
    mixed = placed.groupBy("tok").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("tok")
    shared = stored(placed.join(mixed, "tok").select("tok", "grp", "n", "held", "pos", "low", "high", "last"), few=True)
    x, y = (shared.select("tok", *(F.col(c).alias(f"{c}_{i}") for c in ("grp", "n", "held", "pos", "low", "high", "last"))) for i in (1, 2))
    apart = (F.col("low_1") != F.col("low_2")) | (F.col("high_1") != F.col("high_2")) | (F.col("low_1") != F.col("high_1"))
    last = F.least("last_1", "last_2").alias("last")
    cross = x.join(y, "tok").where((F.col("grp_1") < F.col("grp_2")) & may_be_alike("n_1", "n_2", "held_1", "held_2") & apart & in_core("n_1", "n_2", "pos_1", "pos_2")).select("grp_1", "grp_2", last).distinct()
    within = spread.where("low < high").select(F.col("grp").alias("grp_1"), F.col("grp").alias("grp_2"), "last")
    todo, turn = stored(cross.unionByName(within), few=True), 0
    while True:
        links = stored(links.unionByName(_verified(stored(_between(todo, labelled, turn), few=True), slim, shingle)), few=True)
        todo, turn = todo.where(F.col("last") > turn), turn + 1
        if not todo.limit(1).count():
            return links
        labelled, spread = _labelled(members, links)
        one, two = (spread.select(F.col("grp").alias(f"grp_{i}"), F.col("low").alias(f"low_{i}"), F.col("high").alias(f"high_{i}")) for i in (1, 2))
        todo = stored(todo.join(one, "grp_1").join(two, "grp_2").where(apart).select("grp_1", "grp_2", "last"), few=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``: the smallest document linked to it by similarities of 3/4 or more."""
    slim = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    every, slim = slim, slim.where("key is not null")
    found = counted_batches(slim, shingle)
    documents = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("owner"), "n")
    same = documents.where("key <> owner").select(F.col("key").alias("u"), F.col("owner").alias("v"))
    owners = documents.where("key = owner").select("key", "n").distinct()
    placed = stored(prefixes(found), free=True)
    alike = placed.join(owners, ["key", "n"]).withColumn("g", F.when(F.col("held") == F.col("n"), F.xxhash64("toks")).otherwise(F.xxhash64("toks", "key")))
    heads = alike.groupBy("n", "g").agg(F.min("key").alias("grp"))
    placed = stored(alike.join(heads, ["n", "g"]).select("key", "grp", "n", "held", F.when(F.col("key") == F.col("grp"), F.col("toks")).alias("toks")), free=True, few=True)
    members = placed.select("key", "grp", "n", "held")
    sizes = members.groupBy("grp").agg(F.first("n").alias("n"), F.max("held").alias("held"))
    tokens = placed.where("key = grp").select("grp", (F.col("n") - F.col("held")).alias("alone"), F.posexplode("toks").alias("i", "tok")).select("grp", "tok", (F.col("alone") + F.col("i") + 1).alias("pos"))
    shared = tokens.groupBy("tok").agg(F.min("grp").alias("pivot"), F.max("grp").alias("last")).where("pivot < last")
    tokens = stored(tokens.join(shared.select("tok", "pivot"), "tok").join(sizes, "grp").select("tok", "grp", "pivot", "n", "held", "pos").distinct(), few=True)
    n_pivot = sizes.select(F.col("grp").alias("pivot"), F.col("n").alias("n_pivot"), F.col("held").alias("held_pivot"))
    star = tokens.where("grp <> pivot").groupBy("grp", "pivot").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("held").alias("held")).where(F.col("k") >= SHARED)
    star = star.join(n_pivot, "pivot").where(may_be_alike("n", "n_pivot", "held", "held_pivot"))
    best = star.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("k"), "pivot"))).where("r <= 2")
    inner = members.where("key <> grp").select(F.col("key").alias("u"), F.col("grp").alias("v"))
    pairs = stored(members.join(best.select("grp", "pivot"), "grp").select(F.col("key").alias("u"), F.col("pivot").alias("v")).unionByName(inner).distinct(), few=True)
    links = stored(_verified(pairs, slim, shingle), few=True)
    active = tokens.select("grp").unionByName(inner.select(F.col("v").alias("grp"))).distinct()
    members = stored(members.join(active, "grp"), few=True)
    links = _late(members, tokens, links, slim, shingle)
    final = components(same.unionByName(links))
    own = documents.select("key", "n").unionByName(_without(slim, documents))
    found = own.join(final.withColumnRenamed("node", "key"), "key", "left").select("key", "n", F.coalesce("component", "key").alias("component"))
    alone = _counted(every.where("key is null"), shingle)
    return found.unionByName(alone.select("key", "n", F.lit(None).cast("bigint").alias("component"))).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _counted(rows: DataFrame, shingle: int) -> DataFrame:
    """(key, n) of ``rows`` (key, text): the sizes of their sets."""

    def run(batches):
        for batch in batches:
            for lo, hi, raws in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array([len(s) for s in shingle_sets(raws, shingle)], pa.int64())], names=["key", "n"])

    return text_batches(rows).mapInArrow(run, "key bigint, n bigint")


def _without(slim: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, 0) of the rows without shingles."""
    return slim.where(~F.coalesce("text", F.lit("")).rlike(f"[^{SPACES}]")).select("key", F.lit(0).cast("bigint").alias("n"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the smallest document of each group only; rows with a null key stay."""
    gone = near_duplicates(docs, key, text).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE 100 * m >= 75 * (x.n + y.n - m)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN z ON z.doc_id = d.doc_id JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id
"""
