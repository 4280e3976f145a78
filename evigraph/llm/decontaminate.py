"""Benchmark decontamination: short items found inside long documents by size-partitioned MinHash, verified by exact containment.

An item is the set of its distinct runs of ``WIDTH`` words (of an item with fewer words: its one run), A-Z as a-z. A document
contains it if it holds at least ``THRESHOLD`` of the set in its whole text.

Items are partitioned by size: those with ``u/2 < q <= u`` shingles, u a power of two, form a class. For each class a document is
cut into windows of 2u shingles that begin every u shingles, so that an item's passage lies within one. A window that holds the
share t of an item has a Jaccard similarity with it of at least ``t q / (2 u + (1 - t) q)``, thus above ``t / (5 - t)``: the length
of the documents no longer matters. With one row to a band a window and an item collide in one of b bands with probability
``1 - (1 - J) ** b``; b is the least for which that is ``RECALL`` at the threshold (for a whole passage it is 1 - 1e-6).
Items of one shingle are held whole or not at all and are looked up as they are.
Windows' minima come from minima over blocks, so that each hash costs one product and one pass.

Items are handled in blocks of ``MAX_ITEMS`` or ``MAX_BYTES`` that are broadcast, and each block is one pass over the documents; no row
of a document is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import words as W
from evigraph.plans.scratch import materialize, small_side

WIDTH = 5
THRESHOLD = 0.75
RECALL = 0.9999
MAX_ITEMS, MAX_BYTES = 20_000, 64 << 20
MAX_BROADCAST_IDS = 1 << 20


def bands(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold / (5 - threshold)))


def size_class(q: int) -> int:
    return 1 << (q - 1).bit_length()


def _multipliers(n: int) -> np.ndarray:
    return W.mix(np.arange(n, dtype=W.U), 31) | W.U(1)


@dataclass
class Items:
    """A block of items of one width."""

    ids: list
    sets: list[np.ndarray]
    threshold: float
    #: By class: for each band a filter over the top 16 bits of a minimum, the sorted minima and the items that have them.
    classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)
    #: The same for the shingles of items that have one.
    single: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def index(self, multipliers: np.ndarray) -> Items:
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            by_class.setdefault(size_class(len(s)), []).append(i)
        if 1 in by_class:
            own = np.array(by_class.pop(1))
            own = own[np.argsort([self.sets[i][0] for i in own], kind="stable")]
            least = np.array([self.sets[i][0] for i in own], W.U)
            top = np.zeros(1 << 16, bool)
            top[least >> W.U(48)] = True
            self.single = (top, least, own)
        for u, own in by_class.items():
            self.classes[u] = []
            for a in multipliers:
                least = np.array([(self.sets[i] * a).min() for i in own], W.U)
                order = np.argsort(least)
                top = np.zeros(1 << 16, bool)
                top[least >> W.U(48)] = True
                self.classes[u].append((top, least[order], np.array(own)[order]))
        return self


def _levels(before: np.ndarray, least: int, most: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For u from ``least`` to ``most``: where blocks begin in the level below, the text of each block, whether its text has a next."""
    counts, base = np.diff(before), before[:-1]
    out, u, step = [], least, least
    while u <= most:
        blocks = -(-counts // step)
        first = np.zeros(len(blocks) + 1, np.int64)
        np.cumsum(blocks, out=first[1:])
        owner = np.repeat(np.arange(len(blocks)), blocks)
        begins = (np.arange(first[-1]) - first[owner]) * step + base[owner]
        follows = np.zeros(first[-1], bool)
        follows[:-1] = owner[1:] == owner[:-1]
        out.append((u, begins, owner, follows))
        counts, base, u, step = blocks, first[:-1], u * 2, 2
    return out


def _search(shingles: np.ndarray, before: np.ndarray, items: Items, multipliers: np.ndarray) -> set[tuple[int, int]]:
    found: set[tuple[int, int]] = set()
    if items.single is not None:
        top, least, who = items.single
        at = np.flatnonzero(top[shingles >> W.U(48)])
        low, high = np.searchsorted(least, shingles[at]), np.searchsorted(least, shingles[at], side="right")
        for j in np.flatnonzero(high > low):
            doc = int(np.searchsorted(before, at[j], side="right")) - 1
            found.update((doc, int(i)) for i in who[low[j] : high[j]])
    if not items.classes:
        return found
    levels = _levels(before, min(items.classes), max(items.classes))
    for k, a in enumerate(multipliers):
        below = shingles * a
        for u, begins, owner, follows in levels:
            below = np.minimum.reduceat(below, begins)
            if u not in items.classes:
                continue
            window = below.copy()
            window[:-1][follows[:-1]] = np.minimum(below[:-1], below[1:])[follows[:-1]]
            top, least, who = items.classes[u][k]
            at = np.flatnonzero(top[window >> W.U(48)])
            low, high = np.searchsorted(least, window[at]), np.searchsorted(least, window[at], side="right")
            for j in np.flatnonzero(high > low):
                found.update((int(owner[at[j]]), int(i)) for i in who[low[j] : high[j]])
    return found


def item_sets(items: DataFrame, plain: bool = False) -> DataFrame:
    """(item_id, width, tokens) of each item with a word; tokens are the bytes of its sorted 64-bit shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, starts = W.hashed(batch.column(1), fold=True, plain=plain)
            sizes = np.diff(starts)
            tokens = [np.unique(W.windows(h[starts[i] : starts[i + 1]], np.array([0, n]), min(WIDTH, n))[0]).tobytes() if n else None for i, n in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(sizes, WIDTH).astype(np.int32)), pa.array(tokens, pa.binary())], ["item_id", "width", "tokens"])

    return items.select("item_id", "text").distinct().mapInArrow(W.returning(run), f"item_id {items.schema['item_id'].dataType.simpleString()}, width int, tokens binary").where("width > 0")


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, plain: bool = False) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): one row for each row of ``docs`` (doc_id, text) and each item (item_id, text) in it.

    Items without a word are in no document; equal rows of ``items`` are one; an id may have several texts, each with a row. Null or
    empty documents hold nothing. Documents with equal ids are searched each for itself. Extra columns are not read.
    ``plain`` ignores ASCII punctuation.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = materialize(item_sets(items, plain), "items")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shared long, n_shingles long"
    n, size = sets.agg(F.count("*"), F.sum(F.length("tokens"))).first()
    blocks = max(1, -(-n // MAX_ITEMS), -(-(size or 0) // MAX_BYTES))
    parts = [_find_block(docs, sets.where(F.pmod(F.xxhash64("item_id", "tokens"), F.lit(blocks)) == k), threshold, schema, plain) for k in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _find_block(docs: DataFrame, sets: DataFrame, threshold: float, schema: str, plain: bool) -> DataFrame | None:
    table = sets.select("item_id", "width", "tokens").toArrow()
    if not table.num_rows:
        return None
    names = table.column("item_id").combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((names, table.column("width").to_pylist(), table.column("tokens").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(bands(threshold))
        by_width: dict[int, Items] = {}
        names = shared.value[0]
        for i, (width, tokens) in enumerate(zip(*shared.value[1:])):
            own = by_width.setdefault(width, Items([], [], threshold))
            own.ids.append(i)
            own.sets.append(np.frombuffer(tokens, W.U))
        for own in by_width.values():
            own.index(multipliers)
        for batch in batches:
            for chunk in W.chunks(batch):
                h, starts = W.hashed(chunk.column(1), fold=True, plain=plain)
                hits = []
                for width, own in by_width.items():
                    shingles, before = W.windows(h, starts, width)
                    if not len(shingles):
                        continue
                    held: dict[int, np.ndarray] = {}
                    for doc, i in sorted(_search(shingles, before, own, multipliers)):
                        if doc not in held:
                            held = {doc: np.unique(shingles[before[doc] : before[doc + 1]])}
                        common = len(np.intersect1d(held[doc], own.sets[i], assume_unique=True))
                        if common >= threshold * len(own.sets[i]):
                            hits.append((doc, own.ids[i], common, len(own.sets[i])))
                if hits:
                    doc, item, common, size = zip(*hits)
                    yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(doc)), names.take(pa.array(item)), pa.array(common, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "n_shared", "n_shingles"])

    return docs.mapInArrow(W.returning(run), schema)


def remove(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that contain no item. Each row is judged by its own text, whatever its doc_id; equal rows share their verdict."""
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    found = materialize(find(docs.select(key.alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias("found_key")).distinct(), "found")
    return docs.join(small_side(found, MAX_BROADCAST_IDS), key == F.col("found_key"), "left_anti")
