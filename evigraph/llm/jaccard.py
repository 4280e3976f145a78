"""Exact n-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct runs of ``width`` words (A-Z as a-z). Two sets x, y with ``|x & y| >= t |x | y|`` share a
token among the first ``|x| - ceil(t |x|) + 1`` tokens of x and likewise of y, under *any* one order of all tokens; and if that
shared token is the first one, at places i and j, then ``|x & y| <= min(|x| - i, |y| - j)``. So:

1. Every text is read once into its sorted tokens (:func:`tokenized`). Equal sets are one class, named by a 64-bit fingerprint, and
   only classes are compared.
2. Order 1 puts rare tokens first: by the number of sets that hold a token, counted over all of them (:func:`frequent`), then by
   hash. Each class sends its prefix, with places, to the tokens' posting lists; tokens of one class end there.
3. A list's leader is its class that shares most prefix tokens with others (an original shares more than its altered copies). First
   all others are paired with their leader, and links join components. Then classes outside a list's largest component are paired
   with all classes of other components, so no link between two components is lost. Both keep a pair only if sizes and places allow
   a link, and the second only if parities of both sets' tokens do (:func:`parity`), which ends nearly all pairs of classes that are
   alike, but not enough, before they leave the join; sets far longer than ``BITS`` tokens are left to the later steps.
4. Candidates must share prefix tokens under each of ``OTHER_ORDERS`` too; these filters meet by class, before token sets are moved.
   What remains is verified on the whole sets.

Components need only the links that join them, which keeps lists of thousands of near copies linear. Counts of tokens decide about an
order, thus about speed, and never about results: only the ``MAX_FREQUENT`` most frequent tokens are broadcast, others count as rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import words as W
from evigraph.operators.components import connected_components
from evigraph.plans.scratch import drop, materialize, release, small_side

WIDTH = 5
#: The threshold as a fraction: link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Orders besides the first, each a seed of the mixing function.
OTHER_ORDERS = (101, 202)
MAX_FREQUENT = 1 << 20
#: A broadcast of ids stays under 8 bytes x this.
MAX_BROADCAST_IDS = 1 << 20
#: Tokens that are counted together in one part, as far as MAX_PARTS parts allow; a part's token takes 4 bytes.
PART_TOKENS, MAX_PARTS = 1 << 20, 1 << 17
FLUSH = 1 << 20
#: What is handed to a Python worker together: texts, and tokens of sets on average.
BATCH_TEXTS, BATCH_TOKENS = 1 << 10, 1 << 19
#: Bits of a set's parity; sets of up to about as many tokens can be told apart by them.
BITS = 512
#: Classes of a task that are remembered, to send copies within it once.
REMEMBERED = 1 << 20


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, one for the whole sequence."""
    h, starts = W.hashed(texts, fold=True)
    runs, before = W.windows(h, starts, width)
    out = []
    for i in range(len(starts) - 1):
        n = int(starts[i + 1] - starts[i])
        if n >= width:
            out.append(np.unique(runs[before[i] : before[i + 1]]))
        elif n:
            out.append(W.windows(h[starts[i] : starts[i + 1]], np.array([0, n]), n)[0])
        else:
            out.append(np.zeros(0, W.U))
    return out


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set, the same in any order of its tokens."""
    if not len(tokens):
        return 0
    total = (int(W.mix(tokens, 7).sum(dtype=W.U)) + len(tokens) * int(W.STEP)) & (2**64 - 1)
    return int(W.mix(np.array([total], W.U), 9).view(np.int64)[0])


def parity(tokens: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each the parity of how many tokens fall on it: where two sets' bits differ, so do the sets, in a token at least."""
    return np.packbits(np.bincount((W.mix(tokens, 31) % W.U(BITS)).astype(np.int64), minlength=BITS) & 1).view(np.int64)


def prefix_length(n: int) -> int:
    """n - ceil(t n) + 1."""
    return n + (-NUM * n) // DEN + 1


def tokenized(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, key, n, tokens, bits) for each row: the class, the set's size, the bytes of its sorted hashes and its
    :func:`parity`; key 0 of an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                sets = shingle_sets(chunk.column(1), width)
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "key", "n", "tokens", "bits"])

    return docs.select("doc_id", "text").mapInArrow(W.returning(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n int, tokens binary, bits array<long>")


def _new_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of batches (key, tokens): keys, all tokens in order and each set's begin (and the end), copies within the task once."""
    seen: set[int] = set()
    for batch in batches:
        keys, tokens = batch.column(0).to_numpy(), batch.column(1)
        rows = []
        for i, key in enumerate(keys.tolist()):
            if key and key not in seen:
                seen.add(key)
                rows.append(i)
        if len(seen) > REMEMBERED:
            seen.clear()
        for at in range(0, len(rows), 256):
            sets = [np.frombuffer(tokens[i].as_buffer(), W.U) for i in rows[at : at + 256]]
            starts = np.zeros(len(sets) + 1, np.int64)
            np.cumsum([len(s) for s in sets], out=starts[1:])
            yield keys[rows[at : at + 256]], np.concatenate(sets), starts


def _names(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The name under which a token is counted: its part, then 32 bits; tokens of a part rarely share one."""
    m = W.mix(tokens, 21)
    return ((m >> W.U(32)) % W.U(parts) << W.U(32)) | (m & W.U(0xFFFFFFFF))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    """(part, once, twice) of the names in ``held``, which is emptied: for each part the 32 bits of those found once, and of the others with counts."""
    names = np.concatenate(held)
    held.clear()
    names.sort()
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    n = np.diff(first, append=len(names)).astype(np.uint32)
    names = names[first]
    del first
    low, part = names.astype(np.uint32), (names >> W.U(32)).astype(np.int32)
    del names
    own = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    once, twice = [], []
    for a, b in zip(own, np.append(own[1:], len(part))):
        few = n[a:b] == 1
        once.append(low[a:b][few].tobytes())
        twice.append(np.stack([low[a:b][~few], n[a:b][~few]]).T.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(part[own]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["part", "once", "twice"])


def frequent(sets: DataFrame, n_tokens: int, rows: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of parts, and the names and counts of the tokens of most sets, by name.

    All tokens of all sets are counted: a task sums up what it holds and sends 4 bytes for each. Copies in different tasks count again.
    """
    parts = int(min(MAX_PARTS, max(1, -(-n_tokens // PART_TOKENS))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, tokens, _ in _new_classes(batches):
            held.append(_names(tokens, parts))
            size += len(tokens)
            if size >= FLUSH:
                yield _counted(held)
                size = 0
        if held:
            yield _counted(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, [], []

        def summed():
            single = np.sort(np.concatenate(once)) if once else np.zeros(0, np.uint32)
            first = np.flatnonzero(np.diff(single.astype(np.int64), prepend=-1))
            runs = np.diff(np.append(first, len(single)))
            more = first[runs > 1], runs[runs > 1]
            pairs = np.concatenate(twice) if twice else np.zeros((0, 2), np.uint32)
            # a count that a task sent may add to a token that others hold once
            names, back = np.unique(np.concatenate([single[more[0]], pairs[:, 0]]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([more[1], pairs[:, 1]]), minlength=len(names)).astype(np.int64)
            if len(single) and len(names):
                lone = single[first[runs == 1]]
                k = np.minimum(np.searchsorted(lone, names), max(0, len(lone) - 1))
                n += (lone[k] == names) if len(lone) else 0
            keep = n > 2
            return pa.RecordBatch.from_arrays([pa.array((at << 32) + names[keep].astype(np.int64)), pa.array(n[keep])], ["name", "n"])

        for batch in batches:
            for part, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if at is not None:
                        yield summed()
                    at, once, twice = part, [], []
                once.append(np.frombuffer(a, np.uint32))
                twice.append(np.frombuffer(b, np.uint32).reshape(-1, 2))
        if at is not None:
            yield summed()

    sent = sets.where("n > 0").select("key", "tokens").mapInArrow(W.returning(send), "part int, once binary, twice binary")
    dealt = sent.repartition("part").sortWithinPartitions("part")
    found = materialize(dealt.mapInArrow(W.returning(add), "name long, n long"), "frequent", rows)
    # the least count that leaves MAX_FREQUENT names at most
    bins = found.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()
    total, least = 0, 1 << 17
    for r in bins:
        total += r.k
        if total > MAX_FREQUENT:
            break
        least = r.n
    rows = found.where(F.col("n") >= least).orderBy("name").toArrow()
    drop(found)
    return parts, rows.column("name").to_numpy().view(W.U), rows.column("n").to_numpy()


def order_values(tokens: np.ndarray, parts: int, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values that sort tokens in order 1; equal ones stand by the tokens themselves."""
    out = W.mix(tokens, 11) >> W.U(16)
    if len(names):
        own = _names(tokens, parts)
        known = np.zeros(1 << 22, bool)
        known[names & W.U((1 << 22) - 1)] = True
        at = np.flatnonzero(known[own & W.U((1 << 22) - 1)])
        k = np.minimum(np.searchsorted(names, own[at]), len(names) - 1)
        n = np.where(names[k] == own[at], np.minimum(counts[k], (1 << 16) - 1), 0)
        out[at] |= n.astype(W.U) << W.U(48)
    return out


def postings(sets: DataFrame, known: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """(token, key, n, at): order-1 prefixes with sizes and places, of tokens that two classes hold there, each class once in a list."""
    # counts beyond 16 bits are all alike to the order
    shared = sets.sparkSession.sparkContext.broadcast((*known[:2], np.minimum(known[2], (1 << 16) - 1).astype(np.uint16)))
    names = ["token", "key", "n", "at"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, tokens, starts in _new_classes(batches):
            values, sizes = order_values(tokens, *shared.value), np.diff(starts)
            firsts = []
            for a, b in zip(starts[:-1], starts[1:]):
                firsts.append(a + np.argsort(values[a:b], kind="stable")[: prefix_length(int(b - a))])
            each = np.array([len(f) for f in firsts])
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[np.concatenate(firsts)].view(np.int64)), pa.array(np.repeat(keys, each)), pa.array(np.repeat(sizes, each).astype(np.int32)), pa.array(at.astype(np.int32))], names)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by token and key; the last row of a batch waits until it is known whether its token has another key
        waiting, sent_on = None, False
        for batch in batches:
            token, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            if waiting is not None and len(token):
                new[0] = (token[0], key[0]) != (waiting.column(0)[0].as_py(), waiting.column(1)[0].as_py())
            rows = np.flatnonzero(new)
            if not len(rows):
                continue
            token = token[rows]
            like_before, like_next = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            like_before[1:] = like_next[:-1] = token[1:] == token[:-1]
            if waiting is not None and token[0] == waiting.column(0)[0].as_py():
                like_before[0] = True
                if not sent_on:
                    yield waiting
            yield batch.take(pa.array(rows[like_before | like_next]))
            waiting, sent_on = batch.slice(rows[-1], 1), like_before[-1]

    schema = "token long, key long, n int, at int"
    sent = sets.where("n > 0").select("key", "tokens").mapInArrow(W.returning(emit), schema).repartition("token").sortWithinPartitions("token", "key")
    return sent.mapInArrow(W.returning(lists), schema)


def _possible(a: str, b: str) -> str:
    """SQL: sizes and places of a shared token allow a link in which it is the first shared one."""
    return f"least({a}.n, {b}.n) * {DEN}L >= greatest({a}.n, {b}.n) * {NUM}L AND least({a}.n - {a}.at, {b}.n - {b}.at) * {DEN + NUM}L >= ({a}.n + {b}.n) * {NUM}L"


def _ordered() -> list[Column]:
    return [F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")]


def _led(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of a class and its list's leader that may be linked. ``lists`` has token, key, n, at, degree."""
    lead = F.max(F.struct("degree", F.xxhash64("key"), "key", "n", "at")).alias("lead")
    leads = lists.groupBy("token").agg(lead).select("token", "lead.key", "lead.n", "lead.at")
    return lists.alias("a").join(leads.alias("b"), F.expr("a.token = b.token AND a.key <> b.key AND " + _possible("a", "b"))).select(*_ordered()).distinct()


def _alike(a: str, b: str) -> str:
    """SQL: the tokens in which both sets differ, as many as their bits do at least, leave enough in common for a link."""
    differ = " + ".join(f"bit_count({a}.bits{i} ^ {b}.bits{i})" for i in range(BITS // 64))
    return f"({a}.n + {b}.n - ({differ})) * {DEN + NUM}L >= ({a}.n + {b}.n) * {2 * NUM}L"


def _across(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of classes of a list, of other components, that may be linked. ``lists`` has token, key, n, at, comp."""
    parts = lists.groupBy("token", "comp").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    mixed = parts.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m"), F.min("least").alias("least"), F.count("*").alias("c")).where("c > 1")
    rows = materialize(lists.join(mixed.select("token", F.col("m.comp").alias("most"), "least"), "token"), "mixed")
    bits = sets.select("key", *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)]).dropDuplicates(["key"])
    # with the least size of the list, or the least one that may be linked, its place must allow a link
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * NUM / DEN))
    minor = rows.where((F.col("comp") != F.col("most")) & ((F.col("n") - F.col("at")) * (DEN + NUM) >= (F.col("n") + least) * NUM))
    met = F.expr("a.token = b.token AND a.comp <> b.comp AND (b.comp = b.most OR a.key < b.key) AND " + _possible("a", "b") + " AND " + _alike("a", "b"))
    return minor.join(bits, "key").alias("a").join(rows.join(bits, "key").alias("b"), met).select(*_ordered()).distinct()


def _prefix(tokens: np.ndarray, seed: int) -> np.ndarray:
    """The prefix under another order, as 32-bit values; tokens that are equal have equal ones."""
    k = prefix_length(len(tokens))
    return (np.partition(W.mix(tokens, seed), k - 1)[:k] >> W.U(32)).astype(np.uint32)


def chosen_sets(sets: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """(key, n, tokens, o0, o1, ...) of each class of ``pairs`` (a, b): its set, and its prefixes under the other orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(t.as_buffer(), W.U) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([_prefix(s, seed).view(np.int32) for s in own], pa.list_(pa.int32())) for seed in OTHER_ORDERS]], [*batch.schema.names, *[f"o{i}" for i in range(len(OTHER_ORDERS))]])

    keys = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    own = sets.join(small_side(keys, MAX_BROADCAST_IDS), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    out = materialize(own.mapInArrow(W.returning(run), "key long, n int, tokens binary" + "".join(f", o{i} array<int>" for i in range(len(OTHER_ORDERS)))), "chosen", rows)
    drop(keys)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def links(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` that share prefix tokens under each other order and whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), W.U), np.frombuffer(y.as_buffer(), W.U)) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    orders = [f"o{i}" for i in range(len(OTHER_ORDERS))]
    own = lambda s: chosen.select(F.col("key").alias(s), *[F.col(o).alias(f"{s}{o}") for o in orders])
    both = pairs.join(own("b"), "b").join(own("a"), "a")
    for o in orders:
        both = both.where(F.arrays_overlap(f"a{o}", f"b{o}"))
    for s in ("b", "a"):
        both = both.join(chosen.select(F.col("key").alias(s), F.col("tokens").alias(f"tokens_{s}")), s)
    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(W.returning(run), "a long, b long")


def components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id of any type with an order, text).

    component_id is the smallest doc_id of the documents reachable by links. Null, empty and blank texts have 0 shingles and are
    linked with nothing, so their component is their own doc_id. Rows with equal doc_id are documents of their own with that name.
    A row without doc_id is linked like any other, but gives no name: the component of rows without any id is null. Extra columns
    are not read.
    """
    spark = docs.sparkSession
    sets = materialize(tokenized(docs, width), "sets", BATCH_TEXTS)
    n_tokens, n_sets = sets.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    batch = max(1, BATCH_TOKENS * n_sets // max(1, n_tokens))
    known = frequent(sets, n_tokens, batch)
    release(spark)
    lists = materialize(postings(sets, known), "postings", batch)
    release(spark)
    degrees = materialize(lists.groupBy("key").agg(F.count("*").alias("degree")), "degrees")
    n_keys = degrees.count()
    release(spark)
    # from here on only the tokens of classes in a list are needed
    member = materialize(sets.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles")), "members")
    compared = materialize(sets.join(small_side(degrees.select("key"), MAX_BROADCAST_IDS, n_keys), "key", "left_semi").select("key", "n", "tokens", "bits"), "compared")
    drop(sets)
    led = materialize(_led(lists.join(small_side(degrees, MAX_BROADCAST_IDS, n_keys), "key")), "pairs")
    found, comp = _verified(compared, led, None, None, batch)
    release(spark)
    if comp is not None:
        labelled = lists.join(small_side(comp, MAX_BROADCAST_IDS), F.col("key") == F.col("node"), "left").select("token", "key", "n", "at", F.coalesce("component", "key").alias("comp"))
    else:
        labelled = lists.withColumn("comp", F.col("key"))
    rest = materialize(_across(labelled, compared).join(led, ["a", "b"], "left_anti"), "pairs")
    found, comp = _verified(compared, rest, found, comp, batch)
    for table in (led, rest, degrees, lists, found, compared):
        drop(table)
    release(spark)
    classes = member.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    if comp is None:
        named = classes.select("key", F.col("first_id").alias("component_id"))
    else:
        each = materialize(classes.join(comp, F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("component", "key").alias("component")), "classes")
        least = each.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = each.join(least, "component").select("key", "component_id")
    lone = member.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.where("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id").unionByName(lone)


def _verified(sets: DataFrame, pairs: DataFrame, found: DataFrame | None, comp: DataFrame | None, rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """All links so far and their components (node, component), ``pairs`` included."""
    if pairs.isEmpty():
        return found, comp
    chosen = chosen_sets(sets, pairs, rows)
    release(sets.sparkSession)
    new = materialize(links(pairs, chosen), "links", max(1, rows // 2))
    drop(chosen)
    release(sets.sparkSession)
    if new.isEmpty():
        return found, comp
    every = new if found is None else materialize(found.unionByName(new), "links")
    return every, materialize(connected_components(every, "a", "b"), "components")
