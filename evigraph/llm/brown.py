"""Brown class-based n-gram scoring.

Each word has one class; a text's probability is the product over its tokens (its words, A-Z as a-z, then one end) of
``p(class | two classes before) * p(word | class)``. The most frequent ``EXCHANGED`` words get their classes by exchange clustering:
words move to the class that most raises the likelihood of the class bigrams, half of the words at a time. Every other word that
training holds ``LEAST`` times then goes to the one class of as many further ones that its own neighbours make likeliest, by the same
likelihood to first order, as such a word weighs little in a class. Only words found once and unseen ones are left to fixed classes,
by shape and ending; the end has a class of its own. Class trigrams back off linearly to bigrams and unigrams; emissions are relative
frequencies, in the fixed classes with 1/2 added, where all unseen words of a class are one.

Work at scale: counts of words, of word pairs, of neighbours and of class trigrams are sums over partitions. Word pairs are kept for
exchanged words and fixed classes, so at most ``(EXCHANGED + fixed) ** 2``; an exchange step is one pass over them, without a shuffle,
and brings the driver one row for each exchanged word. A further word's neighbours are counted by class, at most ``2 * CLASSES`` numbers
a word, and all further words are assigned in the tasks. The ``DICTIONARY`` most frequent words and the trigrams (``ALL ** 3``) are
broadcast; counts and classes of all rarer words are joined by a shuffle, in which no word is frequent, and put into the texts' rows of
classes (a byte a token). Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import words as W
from evigraph.plans.scratch import drop, materialize, release

EXCHANGED = 8192
DICTIONARY = 1 << 18
FREE = 63
SHAPES, ENDINGS = 4, 8
FIXED = SHAPES * ENDINGS
#: Class 0 is the end's; then come the fixed ones, then the free ones of exchanged words.
CLASSES = 1 + FIXED + FREE
#: Then the classes of further words, one beside each free one.
ALL = CLASSES + FREE
LEAST = 2
END = np.int64(1)
SWEEPS = 12
PARTS = 48
BACKOFF = 8.0
FLUSH = 1 << 21


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts the tokens as signed hashes, their fixed classes, and the number of tokens before each text."""
    data, offsets = W.string_bytes(texts)
    begins, ends, starts = W.word_spans(data, offsets)
    h = W.word_hashes(data, begins, ends, fold=True).view(np.int64)
    h[h == END] = 2
    n = len(starts) - 1
    total = np.zeros(len(data) + 1, np.int64)
    low = W.LOWER[data]

    def some(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=total[1:])
        return total[ends] > total[begins]

    digit, high = (low >= 48) & (low < 58), low >= 128
    letter = (low >= 97) & (low < 123) | high
    shape = np.where(some(digit), 3, np.where(some(~(digit | letter)), 2, some(high).astype(int)))
    if len(h):
        before = low[np.maximum(ends - 2, begins)].astype(np.int64)
        ending = (low[ends - 1] * 31 + before * 7) % ENDINGS
    else:
        ending = np.zeros(0, np.int64)
    out, fixed = np.empty(len(h) + n, np.int64), np.zeros(len(h) + n, np.int64)
    at = starts[1:] + np.arange(n)
    word = np.ones(len(out), bool)
    word[at] = False
    out[word], out[at] = h, END
    fixed[word] = 1 + shape * ENDINGS + ending
    return out, fixed, starts + np.arange(n + 1)


class Lookup:
    """Places of keys in a list of distinct ones, -1 for others; by one probe for nearly all."""

    def __init__(self, keys: np.ndarray, bits: int = 21):
        self.keys, self.shift = np.append(keys, 0), W.U(64 - bits)
        self.table = np.full(1 << bits, len(keys), np.int32)
        self.table[self._slot(keys)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        lost = np.flatnonzero(self.table[self._slot(keys)] != np.arange(len(keys)))
        order = np.argsort(keys[lost])
        self.lost, self.lost_at = keys[lost][order], lost[order]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return W.mix(h.view(W.U), 3) >> self.shift

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(h)].astype(np.int64)
        bad = (at == len(self.keys) - 1) | (self.keys[at] != h)
        at[bad] = -1
        if len(self.lost):
            rest = h[bad]
            k = np.minimum(np.searchsorted(self.lost, rest), len(self.lost) - 1)
            at[bad] = np.where(self.lost[k] == rest, self.lost_at[k], -1)
        return at


def _summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(held), return_counts=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, fixed, n) of all tokens of ``docs``, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            h, first, n = np.unique(np.concatenate([a for a, _ in held]), return_index=True, return_counts=True)
            fixed = np.concatenate([b for _, b in held])[first]
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(fixed.astype(np.int32)), pa.array(n)], ["word", "fixed", "n"])

        for batch in batches:
            for chunk in W.chunks(batch):
                h, fixed, _ = tokens(chunk.column(0))
                held.append((h, fixed))
                size += len(h)
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    sent = docs.select("text").mapInArrow(run, "word long, fixed int, n long")
    return sent.groupBy("word").agg(F.first("fixed").alias("fixed"), F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(a, b, n): neighbours among units, which are the frequent words by their place and, from there on, the fixed classes and end."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    span = len(frequent) + 1 + FIXED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shared.value)
        held, size = [], 0

        def counted():
            code, n = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array((code // span).astype(np.int32)), pa.array((code % span).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for chunk in W.chunks(batch):
                h, fixed, starts = tokens(chunk.column(0))
                at = find(h)
                unit = np.where(at >= 0, at, len(shared.value) + fixed)
                before = np.empty_like(unit)
                before[1:] = unit[:-1]
                before[starts[:-1]] = len(shared.value)
                held.append(before * span + unit)
                size += len(h)
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that depends on the classes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def best_move(pairs: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, twice: float, allowed: slice) -> tuple[int, float]:
    """The class that a word of class ``own`` does best in, and what moving it there adds to the likelihood.

    ``after`` and ``before`` count its neighbours by class without itself, ``twice`` its own repetitions.
    """
    rest = pairs.copy()
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] -= twice
    rows, columns = rest.sum(1) + before, rest.sum(0) + after
    diagonal = np.diag(rest)
    # only classes of neighbours change a cell's part; a rare word has few
    right, left = rest[:, after > 0], rest[before > 0].T
    gain = (_xlogx(right + after[after > 0]) - _xlogx(right)).sum(1) + (_xlogx(left + before[before > 0]) - _xlogx(left)).sum(1)
    gain -= _xlogx(diagonal + after) + _xlogx(diagonal + before) - _xlogx(diagonal) - _xlogx(diagonal + after + before + twice)
    gain -= _xlogx(rows + after.sum() + twice) - _xlogx(rows) + _xlogx(columns + before.sum() + twice) - _xlogx(columns)
    best = int(gain[allowed].argmax()) + (allowed.start or 0)
    return best, float(gain[best] - gain[own])


def exchange(pairs: DataFrame, n_words: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit of ``pairs`` (a, b, n): the first ``n_words`` units are words, the others have fixed classes."""
    return _exchanged(pairs, n_words, sweeps)[0]


def _exchanged(pairs: DataFrame, n_words: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the counts of class bigrams."""
    fixed_classes = np.arange(1 + FIXED)
    classes = np.concatenate([1 + FIXED + np.arange(n_words) % FREE, fixed_classes])
    if not n_words:
        return classes, np.zeros((CLASSES, CLASSES))
    spark = pairs.sparkSession
    after = pairs.groupBy("a").agg(F.collect_list("b").alias("ids"), F.collect_list("n").alias("ns")).select(F.col("a").alias("unit"), F.lit(0).alias("side"), "ids", "ns")
    before = pairs.groupBy("b").agg(F.collect_list("a").alias("ids"), F.collect_list("n").alias("ns")).select(F.col("b").alias("unit"), F.lit(1).alias("side"), "ids", "ns")
    sides = after.unionByName(before).groupBy("unit").agg(*[F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("ids", "ns")])
    # small tables too are dealt to many tasks, as each word costs time and not bytes
    table = materialize(sides.repartition(PARTS, "unit"), "neighbours")

    def vectors(batch: pa.RecordBatch, by: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        columns = [batch.column(k) for k in range(5)]
        for i in range(batch.num_rows):
            unit, out, twice = columns[0][i].as_py(), [], 0.0
            for k in (1, 3):
                ids, ns = (np.asarray(columns[k + j][i].values) if columns[k + j][i].is_valid else np.zeros(0, np.int64) for j in (0, 1))
                self_ = ids == unit
                twice = float(ns[self_].sum()) if self_.any() else twice
                out.append(np.bincount(by[ids[~self_]], weights=ns[~self_], minlength=CLASSES) if len(ids) else np.zeros(CLASSES))
            yield unit, out[0], out[1], twice

    def summed(by: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(by)

        def run(batches):
            total = np.zeros((CLASSES, CLASSES))
            for batch in batches:
                for unit, right, _, twice in vectors(batch, shared.value):
                    total[shared.value[unit]] += right
                    total[shared.value[unit], shared.value[unit]] += twice
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        return sum((np.frombuffer(bytes(r.total)).reshape(CLASSES, CLASSES) for r in table.mapInArrow(run, "total binary").collect()), np.zeros((CLASSES, CLASSES)))

    matrix, low = summed(classes), 0
    for k in range(sweeps):
        shared = spark.sparkContext.broadcast((classes, matrix))

        def run(batches, turn=k):
            by, pairs_ = shared.value
            for batch in batches:
                moves = []
                for unit, right, left, twice in vectors(batch, by):
                    if unit < n_words and (unit * 2654435761 >> 16) % 2 == turn % 2:
                        best, gain = best_move(pairs_, int(by[unit]), right, left, twice, slice(1 + FIXED, CLASSES))
                        if gain > 1e-9:
                            moves.append((unit, best, gain))
                if moves:
                    unit, best, gain = zip(*moves)
                    yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(best, pa.int32()), pa.array(gain)], ["unit", "best", "gain"])

        moves = table.mapInArrow(run, "unit int, best int, gain double").orderBy(F.desc("gain"), "unit").toArrow()
        # words that move together may spoil one another's gain: take all, or else the better half, quarter, ...
        take, old = moves.num_rows, likelihood(matrix)
        while take:
            tried = classes.copy()
            tried[moves.column("unit").to_numpy()[:take]] = moves.column("best").to_numpy()[:take]
            following = summed(tried)
            if likelihood(following) > old:
                classes, matrix = tried, following
                break
            take //= 4
        low = 0 if take else low + 1
        if low == 2:
            break
    drop(table)
    return classes, matrix


def _neighbours(docs: DataFrame, lead: np.ndarray, classes: np.ndarray) -> DataFrame:
    """(word, code, n) of all words but the exchanged ones: code is the class that follows, or CLASSES and the class before."""
    shared = docs.sparkSession.sparkContext.broadcast((lead, np.append(classes, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shared.value[0])
        held, size = [], 0

        def counted():
            words, at = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            code, n = np.unique(at * 2 * CLASSES + np.concatenate([b for _, b in held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words[code // (2 * CLASSES)]), pa.array((code % (2 * CLASSES)).astype(np.int32)), pa.array(n)], ["word", "code", "n"])

        for batch in batches:
            for chunk in W.chunks(batch):
                h, fixed, starts = tokens(chunk.column(0))
                at = find(h)
                c = np.where(at >= 0, shared.value[1][at], fixed)
                _, before = _contexts(c, starts)
                after = np.zeros_like(c)
                after[:-1] = c[1:]
                own = np.flatnonzero((at < 0) & (h != END))
                held += [(h[own], after[own]), (h[own], before[own] + CLASSES)]
                size += 2 * len(own)
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "word long, code int, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def affinities(pairs: np.ndarray) -> np.ndarray:
    """What each neighbour (2 * CLASSES, as in ``_neighbours``) adds to the log likelihood of each free class, from class bigrams."""
    rows, columns = np.log(pairs.sum(1) + 0.5 * CLASSES), np.log(pairs.sum(0) + 0.5 * CLASSES)
    logs = np.log(pairs + 0.5)
    return np.concatenate([(logs - rows[:, None]).T, logs - columns[None]])[:, 1 + FIXED :]


def assign(neighbours: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(word, class) of each word of ``neighbours`` (word, code, n) found ``LEAST`` times: the likeliest class for its neighbours."""
    shared = neighbours.sparkSession.sparkContext.broadcast(affinities(pairs))
    words = neighbours.groupBy("word").agg(F.sum(F.when(F.col("code") < CLASSES, F.col("n"))).alias("total"), F.collect_list("code").alias("codes"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ns = batch.column(1), batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(codes.value_lengths()))
            dense = np.zeros((batch.num_rows, 2 * CLASSES))
            dense[row, np.asarray(codes.flatten())] = np.asarray(ns.flatten())
            best = np.round(dense @ shared.value, 6).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((CLASSES + best).astype(np.int32))], ["word", "class"])

    return words.where(F.col("total") >= LEAST).select("word", "codes", "ns").mapInArrow(run, "word long, class int")


@dataclass(frozen=True)
class ClassModel:
    #: The dictionary's words, most frequent first, the exchanged ones leading, with their counts and classes.
    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    #: log10 p(c | a, b) at [a, b, c].
    transitions: np.ndarray | None
    class_tokens: np.ndarray
    #: Distinct words of each class that were not exchanged.
    class_words: np.ndarray
    n_tokens: int
    n_words: int
    exchanged: int

    @property
    def half(self) -> np.ndarray:
        """What is added to a word's count, by class."""
        c = np.arange(ALL)
        return np.where((c > 0) & (c <= FIXED), 0.5, 0.0)

    @property
    def floors(self) -> np.ndarray:
        """What a word's count is divided by, by class."""
        return np.maximum(self.class_tokens + self.half * (self.class_words + 1), 0.5)


def transition_table(counts: np.ndarray, backoff: float = BACKOFF) -> np.ndarray:
    """log10 p(c | a, b), linearly backed off, from counts at [a, b, c]; each row of probabilities sums to 1."""
    one = counts.sum((0, 1))
    p1 = (one + 1) / (one.sum() + len(one))
    two = counts.sum(0)
    p2 = (two + backoff * p1) / (two.sum(1, keepdims=True) + backoff)
    p3 = (counts + backoff * p2[None]) / (counts.sum(2, keepdims=True) + backoff)
    return np.log10(p3).astype(np.float32)


def _class_trigrams(encoded: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL**3, np.int64)
        for batch in batches:
            for chunk in W.chunks(batch, "classes", 4 * W.CHUNK_BYTES):
                c, starts = _classes(chunk)
                a, b = _contexts(c, starts)
                total += np.bincount((a * ALL + b) * ALL + c, minlength=ALL**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])

    rows = encoded.select("classes", "places", "kinds").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(ALL**3)
    total[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return total.reshape(ALL, ALL, ALL)


def _contexts(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; a text begins as if ends stood before it."""
    a, b = np.zeros_like(c), np.zeros_like(c)
    b[1:] = c[:-1]
    b[starts[:-1]] = 0
    a[1:] = b[:-1]
    a[starts[:-1]] = 0
    return a, b


def _classes(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of ``rows`` (classes, places, kinds), and the number of tokens before each row."""
    own, places, kinds = (rows.column(rows.schema.get_field_index(k)) for k in ("classes", "places", "kinds"))
    starts = np.zeros(len(own) + 1, np.int64)
    np.cumsum(np.asarray(pa.compute.binary_length(own)), out=starts[1:])
    c = np.frombuffer(b"".join(own.to_pylist()), np.uint8).astype(np.int64)
    lengths = np.asarray(places.value_lengths().fill_null(0))
    at = np.repeat(starts[:-1], lengths) + np.asarray(places.flatten(), np.int64)
    c[at] = np.asarray(kinds.flatten(), np.int64)
    return c, starts


def fit(train: DataFrame, exchanged: int = EXCHANGED, dictionary: int = DICTIONARY, sweeps: int = SWEEPS) -> tuple[ClassModel, DataFrame]:
    """A model from all texts of ``train``, and the counts (word, fixed, n) of all its words, materialized; fixed is the class of a word
    that was not exchanged."""
    seen = materialize(word_counts(train), "seen")
    n_tokens, n_words = seen.agg(F.sum("n"), F.count("*")).first()
    most = seen.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word")
    lead = np.asarray(most.limit(exchanged).select("word").toArrow().column("word")).astype(np.int64)
    if len(lead):
        classes, pairs = _exchanged(_pair_counts(train, lead), len(lead), sweeps)
        classes = classes[: len(lead)]
    else:
        classes, pairs = np.zeros(0, np.int64), np.zeros((CLASSES, CLASSES))
    release(train.sparkSession)
    assigned = assign(_neighbours(train, lead, classes), pairs)
    counts = materialize(seen.join(assigned, "word", "left").select("word", F.coalesce("class", "fixed").alias("fixed"), "n"), "words")
    drop(seen)
    release(train.sparkSession)
    top = counts.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(dictionary).toArrow()
    words, n, own = (np.asarray(top.column(k)).astype(np.int64) for k in ("word", "n", "fixed"))
    own[: len(lead)] = classes[: len(own)]
    class_tokens, class_words = np.zeros(ALL), np.zeros(ALL)
    leading = train.sparkSession.createDataFrame([(int(w),) for w in lead], "word long")
    for r in counts.join(F.broadcast(leading), "word", "left_anti").groupBy("fixed").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():
        class_tokens[r.fixed], class_words[r.fixed] = r.n, r.words
    np.add.at(class_tokens, classes[: len(n)], n[: len(lead)])
    model = ClassModel(words, n, own, None, class_tokens, class_words, int(n_tokens or 0), int(n_words), len(lead))
    parts, encoded = _encoded(train, model, counts)
    model = replace(model, transitions=transition_table(_class_trigrams(encoded)))
    drop(parts)
    return model, counts


def _encoded(docs: DataFrame, model: ClassModel, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table of parts, to be dropped, and from it (doc_id, n_tokens, n_known, base, own, classes, places, kinds) of each row.

    classes has a byte for each token; those of words outside the dictionary that have a class are kinds, at places.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, transitions=None))
    floor_tokens = model.n_tokens + 0.5 * (model.n_words + 1)
    ends = int(model.class_tokens[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        find = Lookup(m.words)
        # one more for words that are not found, at -1
        emit = np.append(np.log10((m.counts + m.half[m.classes]) / m.floors[m.classes]), 0.0)
        counted, classes = np.append(m.counts, 0), np.append(m.classes, 0)
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                h, fixed, starts = tokens(chunk.column(2))
                at = find(h)
                end = h == END
                open_ = (at < 0) & ~end
                n = np.where(end, ends, counted[at])
                c = np.where(at < 0, fixed, classes[at])
                base = np.where(open_, 0.0, np.log10((n + 0.5) / floor_tokens))
                add = lambda x: np.add.reduceat(x, starts[:-1])
                rows = chunk.num_rows
                held = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(c.astype(np.uint8))])
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array(np.diff(starts)), pa.array(add((n > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(emit[at])), held, none, pa.nulls(rows, pa.int32()), pa.nulls(rows, PLACES)], NAMES)
                if open_.any():
                    where = np.flatnonzero(open_)
                    row = np.searchsorted(starts, where, side="right") - 1
                    order = np.lexsort((h[where], row))
                    row, where = row[order], where[order]
                    word = h[where]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
                    k = np.flatnonzero(new)
                    places = pa.ListArray.from_arrays(pa.array(np.append(k, len(row)).astype(np.int32)), pa.array((where - starts[row]).astype(np.int32)))
                    empty, none = pa.nulls(len(k), pa.float64()), pa.nulls(len(k), pa.int64())
                    yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(row[k])), pa.nulls(len(k), chunk.column(1).type), none, none, empty, empty, pa.nulls(len(k), pa.binary()), pa.array(word[k]), pa.array(fixed[where[k]].astype(np.int32)), places], NAMES)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, n_tokens long, n_known long, base double, own double, classes binary, word long, fixed int, places array<int>"
    parts = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema), "parts")
    rare = parts.where("word IS NOT NULL").select("row", "word", "fixed", "places").join(counts.select("word", "n", F.col("fixed").alias("found")), "word", "left")
    n, c, times = F.coalesce("n", F.lit(0)), F.coalesce("found", "fixed"), F.size("places")
    floor, half = (F.element_at(F.array(*[F.lit(float(x)) for x in v]), c + 1) for v in (model.floors, model.half))
    moved = F.when(c > FIXED, F.struct(c.alias("c"), "places"))
    tail = rare.select("row", F.when(n > 0, times).otherwise(0).alias("known"), (times * F.log10((n + 0.5) / floor_tokens)).alias("more_base"), (times * F.log10((n + half) / floor)).alias("more_own"), moved.alias("moved"))
    tail = tail.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("known", "more_base", "more_own")], F.collect_list("moved").alias("moved"))
    places = F.flatten(F.transform("moved", lambda m: m["places"]))
    kinds = F.flatten(F.transform("moved", lambda m: F.array_repeat(m["c"], F.size(m["places"]))))
    none = F.array().cast("array<int>")
    whole = parts.where("classes IS NOT NULL").drop("word", "fixed", "places").join(tail, "row", "left")
    sums = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_known", "known"), ("base", "more_base"), ("own", "more_own"))]
    return parts, whole.select("doc_id", "n_tokens", *sums, "classes", F.coalesce(places, none).alias("places"), F.coalesce(kinds, none).alias("kinds"))


def score(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of ``docs`` (doc_id, text).

    score is the model's log10 probability of the text, base_score that of unigrams with 1/2 added, where all unseen words are one.
    A null or blank text is its end alone. Whole texts are scored; equal rows give equal rows; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.transitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch, "classes"):
                c, starts = _classes(chunk)
                a, b = _contexts(c, starts)
                steps = np.add.reduceat(shared.value[a, b, c].astype(float), starts[:-1])
                yield pa.RecordBatch.from_arrays([*chunk.columns[:4], pa.array(np.asarray(chunk.column(4)) + steps)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    _, encoded = _encoded(docs, model, counts)
    return encoded.mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")


PLACES = pa.list_(pa.int32())
NAMES = ["row", "doc_id", "n_tokens", "n_known", "base", "own", "classes", "word", "fixed", "places"]


def part(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5
