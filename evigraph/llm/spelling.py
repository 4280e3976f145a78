"""Spelling variants: the vocabulary of a corpus, which of its words differ by one code point, and each word's commoner form.

Near words are found by a trie self-join. An active pair is two trie nodes whose prefixes are at distance one: the children of a node
(replaced), or a node and its child (inserted). From there on both go down by equal code points only, and a pair of words ends in two
terminal nodes. Where one code point stands several times in a row, the first of them counts as the inserted one, so each pair of words
has one place where it differs and is found once.

The trie is partitioned by prefixes. Nodes with more than ``leaf_words`` words below are upper nodes; the shortest other prefix of a word
is the subtrie it belongs to, and a subtrie is joined with itself within a task, level by level over arrays. Pairs that part at an upper
node x go down by shuffle: each word below x sends what is left of it without the code point behind x, and words meet where that is
equal, or equal to a whole word. Such a meeting has one word for each letter at most, so no group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.plans.scratch import drop, materialize

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has at least so many times its word's count.
RATIO = 5
#: One occurrence of a run in so many loses a code point.
DAMAGED = 199
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a subtrie at least, and upper nodes of a depth at most: beyond, subtries grow.
LEAF_WORDS, MAX_UPPER = 512, 10_000
#: Words whose subtries are joined together.
TOGETHER = 1 << 14
_CHAR = 1 << 21


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): all words of the texts with ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.

    A word is a run of letters, A-Z as a-z; where ``DAMAGED`` divides the CRC-32 of ``doc_id:run``, it lacks the code point at the CRC
    modulo its length. A null text has no words; a null doc_id counts as an empty one.
    """
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    crc = F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8"))
    at = (F.col("crc") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("crc", crc).select(F.when(F.col("crc") % DAMAGED == 0, less).otherwise(F.col("run")).alias("word"))
    # the length is asked for behind the sums: a filter on the word itself would take the CRC of each run once more
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.max(F.length("word")).alias("size"))
    return counts.where((F.col("n") >= LEAST_COUNT) & (F.col("size") >= LEAST_LENGTH)).select("word", "n")


def upper_nodes(vocab: DataFrame, leaf_words: int) -> set[str]:
    """All prefixes with more than ``leaf_words`` words below: ``words / leaf_words`` for each depth at most."""
    found, last = set(), [""] if vocab.count() > leaf_words else []
    while last:
        found |= set(last)
        depth = len(last[0]) + 1
        above = vocab.sparkSession.createDataFrame([(x,) for x in last], "above string")
        longer = vocab.where(F.length("word") >= depth).withColumn("above", F.substring("word", 1, depth - 1))
        below = longer.join(F.broadcast(above), "above", "left_semi").groupBy(F.substring("word", 1, depth).alias("p")).count()
        last = [r.p for r in below.where(F.col("count") > leaf_words).collect()]
    return found


def _upper_depths(word: str, upper: set[str]) -> int:
    """How many prefixes of the word, from the empty one on, are upper nodes."""
    m = 0
    while m <= len(word) and word[:m] in upper:
        m += 1
    return m


class Tries:
    """The subtries of sorted distinct words, each without the prefix it is rooted at; levels are built as they are asked for."""

    def __init__(self, words: list[str], skip: list[int]):
        rest = [w[m:] for w, m in zip(words, skip)]
        self.codes = np.frombuffer("".join(rest).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.size = np.array([len(r) for r in rest], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        roots = [w[:m] for w, m in zip(words, skip)]
        new = np.array([True] + [a != b for a, b in zip(roots, roots[1:])])
        self.words = np.arange(len(words))
        self.node = np.cumsum(new) - 1
        self.levels = [self._level(np.zeros(new.sum(), np.int64), np.array([ord(r[-1]) if r else 0 for r, n in zip(roots, new) if n], np.int64), 0)]

    def _level(self, parent: np.ndarray, char: np.ndarray, depth: int) -> dict[str, np.ndarray]:
        ends = np.full(len(char), -1)
        ended = self.size[self.words] == depth
        ends[self.node[ended]] = self.words[ended]
        return {"parent": parent, "char": char, "word": ends, "below": np.bincount(self.node, minlength=len(char)), "key": parent * _CHAR + char}

    def level(self, k: int) -> dict[str, np.ndarray]:
        while len(self.levels) <= k:
            depth = len(self.levels)
            on = self.size[self.words] >= depth
            words, parent = self.words[on], self.node[on]
            char = self.codes[self.begin[words] + depth - 1]
            new = np.ones(len(words), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])
            self.words, self.node = words, np.cumsum(new) - 1
            last = self.levels[-1]
            last["first"] = np.searchsorted(parent[new], np.arange(len(last["char"]) + 1))
            self.levels.append(self._level(parent[new], char[new], depth))
        return self.levels[k]

    def down(self, k: int, x: np.ndarray, j: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children, by equal code points, of nodes x of level k and y of level j."""
        below, other = self.level(k + 1), self.level(j + 1)
        first = self.levels[k]["first"]
        n = first[x + 1] - first[x]
        child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[x], n)
        wanted = np.repeat(y, n) * _CHAR + below["char"][child]
        at = np.minimum(np.searchsorted(other["key"], wanted), max(0, len(other["key"]) - 1))
        same = other["key"][at] == wanted if len(other["key"]) else np.zeros(len(wanted), bool)
        return child[same], at[same]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words at distance one, each two once, as places in the list of words."""
        none = np.zeros(0, np.int64)
        replaced, inserted, k = (none, none), (none, none), 0
        while len(replaced[0]) or len(inserted[0]) or (self.level(k)["below"] > 1).any():
            now, below = self.level(k), self.level(k + 1)
            several = np.flatnonzero((now["below"][below["parent"]] > 1) & (now["char"][below["parent"]] != below["char"]))
            inserted = np.concatenate([inserted[0], below["parent"][several]]), np.concatenate([inserted[1], several])
            for a, b in ((now["word"][replaced[0]], now["word"][replaced[1]]), (now["word"][inserted[0]], below["word"][inserted[1]])):
                both = (a >= 0) & (b >= 0)
                yield a[both], b[both]
            replaced, inserted = self.down(k, replaced[0], k, replaced[1]), self.down(k, inserted[0], k + 1, inserted[1])
            apart = [(i, i + d) for d, i in _siblings(below["parent"])]
            replaced = tuple(np.concatenate([replaced[s], *[a[s] for a in apart]]) for s in (0, 1))
            k += 1


def _siblings(parent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances d, and the places of nodes that have a sibling d behind them."""
    d = 1
    while d < len(parent) and len(i := np.flatnonzero(parent[:-d] == parent[d:])):
        yield d, i
        d += 1


def near_counts(words: list[str], n: np.ndarray, skip: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For sorted words: how many of their own subtrie are near, and the place of the most frequent of these (-1: none)."""
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    # more occurrences first, then the smaller word
    rank = np.empty(len(words), np.int64)
    order = np.lexsort((-np.arange(len(words)), n))
    rank[order] = np.arange(len(words))
    for a, b in Tries(words, skip).pairs():
        for x, y in ((a, b), (b, a)):
            count += np.bincount(x, minlength=len(words))
            np.maximum.at(best, x, rank[y])
    return count, np.where(best >= 0, order[best], -1)


_NEAR = "word string, k long, best struct<less:long,word:string>"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("k", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("word", pa.string())]))])


def _in_subtries(vocab: DataFrame, upper: set[str]) -> DataFrame:
    """(word, k, best): near words that part within a subtrie; best has minus its count and the word."""
    shared = vocab.sparkSession.sparkContext.broadcast(upper)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            m = [_upper_depths(w, shared.value) for w in words]
            kept = [k for k in range(len(words)) if m[k] <= len(words[k])]
            yield pa.RecordBatch.from_arrays([pa.array([words[k][: m[k]] for k in kept], pa.string()), pa.array([words[k] for k in kept], pa.string()), batch.column(1).take(pa.array(kept, pa.int64())), pa.array([m[k] for k in kept], pa.int32())], ["root", "word", "n", "m"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int, int]] = []

        def done(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
            words, n = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
            count, best = near_counts(words, n, [r[3] for r in rows])
            found = np.flatnonzero(count)
            return pa.RecordBatch.from_pylist([{"word": words[i], "k": int(count[i]), "best": {"less": -int(n[best[i]]), "word": words[best[i]]}} for i in found], _NEAR_ARROW)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # a subtrie stays together
                if len(held) >= TOGETHER and held[-1][0] != row[0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    dealt = vocab.select("word", "n").mapInArrow(deal, "root string, word string, n long, m int")
    return dealt.repartition("root").sortWithinPartitions("word").mapInArrow(join, _NEAR)


def _across_upper(vocab: DataFrame, upper: set[str]) -> DataFrame:
    """(word, k, best): near words that part at an upper node."""
    shared = vocab.sparkSession.sparkContext.broadcast(upper)
    names = ["at", "rest", "word", "n", "longer", "first"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in range(min(_upper_depths(w, shared.value), len(w) + 1)):
                    rows = [(i, w, w, n, False, False)]
                    if i < len(w):
                        rows.append((i, w[:i] + w[i + 1 :], w, n, True, not i or w[i - 1] != w[i]))
                    for row in rows:
                        for column, v in zip(out, row):
                            column.append(v)
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = vocab.select("word", "n").mapInArrow(send, "at int, rest string, word string, n long, longer boolean, first boolean")
    own = F.struct((-F.col("n")).alias("less"), "word")
    met = rows.groupBy("at", "rest").agg(
        F.array_sort(F.collect_list(F.when(F.col("longer"), F.struct((-F.col("n")).alias("less"), "word", "first")))).alias("longer"),
        F.max(F.when(~F.col("longer"), own)).alias("shorter"),
    )
    met = met.where((F.size("longer") > 1) | ((F.size("longer") > 0) & F.col("shorter").isNotNull()))
    plain = lambda c: F.when(c.isNotNull(), F.struct(c["less"].alias("less"), c["word"].alias("word")))
    each = met.select("longer", "shorter", F.explode("longer").alias("own"))
    other = F.when(F.col("own.word") == F.col("longer")[0]["word"], F.get("longer", F.lit(1))).otherwise(F.get("longer", F.lit(0)))
    with_short = F.when(F.col("own.first"), F.col("shorter"))
    longer = each.select(F.col("own.word").alias("word"), (F.size("longer") - 1 + with_short.isNotNull().cast("int")).cast("long").alias("k"), F.least(plain(other), with_short).alias("best"))
    firsts = F.filter("longer", lambda x: x["first"])
    shorter = met.where(F.col("shorter").isNotNull()).select(F.col("shorter.word").alias("word"), F.size(firsts).cast("long").alias("k"), plain(F.get(firsts, F.lit(0))).alias("best"))
    return longer.unionByName(shorter).where("k > 0")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): of (word, form) the word where forms end. Counts grow at each form, so there is an end; steps double in each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(now.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(now)
        now = moved.select("word", "root")
        now.scratch_path = moved.scratch_path
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of :func:`vocabulary`.

    n_near is the number of words at distance one. form is that of them with the most occurrences (of equal ones the first by code
    points), if it has ``RATIO`` times those of the word, else null; root follows forms to the last. Empty tables have no rows; columns
    besides doc_id and text are not read.
    """
    vocab = materialize(vocabulary(docs), "vocabulary")
    leaf_words = max(LEAF_WORDS, vocab.count() // MAX_UPPER)
    upper = upper_nodes(vocab, leaf_words)
    near = _in_subtries(vocab, upper)
    if upper:
        near = near.unionByName(_across_upper(vocab, upper))
    summed = near.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    taken = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    with_form = vocab.join(summed, "word", "left").withColumn("taken", taken)
    found = materialize(with_form.select("word", F.col("taken.word").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("taken.less")).alias("form_n")), "forms")
    drop(vocab)
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
