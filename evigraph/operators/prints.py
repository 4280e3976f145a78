"""Near items by their fingerprints, whose pairs are judged where their blocks meet: the best rotations, and how alike the vectors are.

A row of a block is an item with all its fingerprints and, where a query asks for them, its stored vectors. What a task finds is thus a
pair of items with its best rotations, and no table of near fingerprints, which is many times as long, goes through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import blocks
from evigraph.operators.blocks import Block, Meeting
from evigraph.plans.scratch import materialize

#: Fingerprints that an item may have here.
SLOTS = 4
#: Rows of a block that are compared at once, so that differing bits stay in the cache.
ROWS = 16
#: Pairs whose vectors are compared at once.
PAIRS = 1 << 14
PRINT, VECTOR = 1, 2


class Prints:
    """Items: up to ``SLOTS`` fingerprints by angle, and a plain vector and one for each fingerprint (the first ``vectors`` of these are kept)."""

    per = 4096

    def __init__(self, vectors: int = 0, width: int = 0, kind: str = "<f4"):
        self.vectors, self.width = vectors, width
        self.dtype = np.dtype([("bits", "<u8", (SLOTS,)), ("angles", "<i4", (SLOTS,)), ("has", "u1", (SLOTS,)), ("plain", "u1"), ("v", kind, (vectors, width))])

    def matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the first fingerprints: they decide which block an item goes to, and nothing else."""
        return np.bitwise_count(a["bits"][:, None, 0] ^ b["bits"][None, :, 0])

    @staticmethod
    def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least distance of any two centres' fingerprints."""
        d = np.bitwise_count(a["bits"][:, None, :, None] ^ b["bits"][None, :, None, :])
        there = ((a["has"] & PRINT) > 0)[:, None, :, None] & ((b["has"] & PRINT) > 0)[None, :, None, :]
        return np.where(there, d, 255).min((2, 3))

    def centre(self, values: np.ndarray) -> bytes:
        out = np.zeros(1, self.dtype)
        for k in range(SLOTS):
            own = values["bits"][(values["has"][:, k] & PRINT) > 0, k]
            if len(own):
                bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
                out["bits"][0, k] = np.packbits(2 * bits.sum(0) >= len(own)).view("<u8")[0]
                out["has"][0, k] = PRINT
        return out.tobytes()

    @staticmethod
    def radius(values: np.ndarray, centre: np.ndarray) -> float:
        d = np.bitwise_count(values["bits"] ^ centre["bits"])
        return float(d[(values["has"] & PRINT) > 0].max())


def packed_items(prints: DataFrame, metric: Prints, vectors: DataFrame | None, per: int | None) -> DataFrame:
    """Blocks of items by ``prints`` (key, own: sorted array of (angle, bits)) and ``vectors`` (key, stored: array of (angle, vector))."""
    rows = prints.join(vectors, "key", "left") if vectors is not None else prints.withColumn("stored", F.lit(None).cast("array<struct<angle:int,vector:array<float>>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, metric.dtype)
            own, stored = batch.column(1).to_pylist(), batch.column(2)
            for r, slots in enumerate(own):
                there = {e["angle"].as_py(): e["vector"] for e in stored[r]} if stored[r].is_valid else {}
                row = out[r]
                if there.get(0) is not None and metric.vectors:
                    row["plain"], row["v"][0] = 1, there[0].values.to_numpy()
                for k, s in enumerate(slots):
                    row["bits"][k], row["angles"][k], row["has"][k] = s["bits"] & (2**64 - 1), s["angle"], PRINT
                    if there.get(s["angle"]) is not None:
                        row["has"][k] |= VECTOR
                        if 1 + k < metric.vectors:
                            row["v"][1 + k] = there[s["angle"]].values.to_numpy()
            size = metric.dtype.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(np.arange(len(out) + 1, dtype=np.int32) * size), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["key", "data"])

    made = materialize(rows.select("key", "own", "stored").mapInArrow(run, "key long, data binary"), "items")
    return blocks.packed(made, metric, per)


def turns(values: np.ndarray) -> list[np.ndarray] | None:
    """For each slot the order of bits that makes it from slot 0 in every item; None if there is none for some slot."""
    if not ((values["has"] & PRINT) > 0).all() or len(values) < 64:
        return None
    signs = np.unpackbits(np.ascontiguousarray(values["bits"]).view(np.uint8).reshape(-1, SLOTS, 8), axis=2).astype(np.float32) * 2 - 1
    out = []
    for k in range(SLOTS):
        equal = signs[:, k].T @ signs[:, 0] == len(values)
        if not (equal.sum(0) == 1).all() or not (equal.sum(1) == 1).all():
            return None
        out.append(equal.argmax(1))
    return out


def combinations(left: list[np.ndarray] | None, right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Pairs of slots of two blocks whose distances hold the least of all, by what :func:`turns` found in both. Where turning a picture only moves bits, by the same order in both
    blocks, slots (x, y) differ in as many bits as (0, z) if y's order after x's inverse is z's."""
    every = [(x, y) for x in range(SLOTS) for y in range(SLOTS)]
    if left is None or right is None or any((x != y).any() for x, y in zip(left, right)):
        return every
    known = {tuple(t): k for k, t in enumerate(left)}
    needed = set()
    for x, y in every:
        # bit p of slot y is bit left[y][p] of slot 0, so bits moved back by x's order stand at left[y][inverse of left[x]]
        z = known.get(tuple(left[y][np.argsort(left[x])]))
        needed.add((x, y) if z is None else (0, z))
    return sorted(needed)


class NearItems(Meeting):
    """Pairs of items within ``radius`` under their best rotations: least distance, then angles, the smaller key's first."""

    def __init__(self, radius: int):
        self.radius, self.turned = radius, {}

    def _turns(self, block: Block) -> list[np.ndarray] | None:
        if block.number not in self.turned:
            self.turned[block.number] = turns(block.values)
        return self.turned[block.number]

    def _close(self, i: Block, j: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of near items in both blocks."""
        a, b = i.values, j.values
        n, best = len(b), np.empty((ROWS, len(b)), np.uint8)
        differ, found = np.empty((ROWS, n), np.uint64), np.empty((ROWS, n), np.uint8)
        gone = [(a["has"][:, k] & PRINT) == 0 for k in range(SLOTS)], [(b["has"][:, k] & PRINT) == 0 for k in range(SLOTS)]
        own = [[np.ascontiguousarray(v["bits"][:, k]) for k in range(SLOTS)] for v in (a, b)]
        used = [(x, y, gone[0][x].any() or gone[1][y].any()) for x, y in combinations(self._turns(i), self._turns(j)) if not gone[0][x].all() and not gone[1][y].all()]
        for at in range(0, len(a), ROWS):
            m = min(ROWS, len(a) - at)
            best[:] = 255
            for x, y, partly in used:
                np.bitwise_xor(own[0][x][at : at + m, None], own[1][y][None], out=differ[:m])
                np.bitwise_count(differ[:m], out=found[:m])
                if partly:
                    found[:m][gone[0][x][at : at + m]] = 255
                    found[:m, gone[1][y]] = 255
                np.minimum(best[:m], found[:m], out=best[:m])
            p, q = np.divmod(np.flatnonzero(best[:m] <= self.radius), n)
            if len(p):
                yield at + p, q

    def hits(self, i: Block, j: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, distance, slot of a, slot of b): a and b are places in both blocks' values, one after the other, a that of the smaller key."""
        keys, values = np.concatenate([i.keys, j.keys]), np.concatenate([i.values, j.values])
        gone = (values["has"] & PRINT) == 0
        bits = np.ascontiguousarray(values["bits"])
        held, n = [], 0

        def judged() -> tuple[np.ndarray, ...]:
            p, q = (np.concatenate(c) for c in zip(*held))
            a, b = np.where(keys[p] < keys[q], p, q), np.where(keys[p] < keys[q], q, p)
            d = np.bitwise_count(bits[a][:, :, None] ^ bits[b][:, None, :]).astype(np.int32)
            d[gone[a][:, :, None] | gone[b][:, None, :]] = 255
            d = d.reshape(len(a), -1)
            best = d.argmin(1)
            return a, b, d[np.arange(len(a)), best], best // SLOTS, best % SLOTS

        for p, q in self._close(i, j):
            if i.number == j.number:
                p, q = p[p < q], q[p < q]
            held.append((p, q + len(i.keys)))
            n += len(p)
            if n >= PAIRS:
                yield judged()
                held, n = [], 0
        if n:
            yield judged()

    def meet(self, i: Block, j: Block) -> Iterator[list[np.ndarray]]:
        keys, angles = np.concatenate([i.keys, j.keys]), np.concatenate([i.values["angles"], j.values["angles"]])
        for a, b, d, x, y in self.hits(i, j):
            yield [keys[a], keys[b], d, angles[a, x], angles[b, y]]


def cosines(v: np.ndarray, a: np.ndarray, x: np.ndarray | int, b: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """Inner product over norms, at least 1e-12, in doubles."""
    p, q = v[a, x].astype(np.float64), v[b, y].astype(np.float64)
    dot = lambda s, t: np.einsum("ij,ij->i", s, t)
    return dot(p, q) / np.maximum(np.sqrt(dot(p, p)) * np.sqrt(dot(q, q)), 1e-12)


class Judged(NearItems):
    """Near items with both plain vectors: ``alike`` takes those of similarity ``least``, ``turned`` also those whose vectors at the
    hit's unlike angles are; ``missing`` lists (item, angle) whose vectors the latter lack."""

    def __init__(self, radius: int, least: float, mode: str):
        super().__init__(radius)
        self.least, self.mode = least, mode

    def meet(self, i: Block, j: Block) -> Iterator[list[np.ndarray]]:
        keys, v = np.concatenate([i.keys, j.keys]), np.concatenate([i.values, j.values])
        plain, has, angles, vectors = v["plain"] > 0, (v["has"] & VECTOR) > 0, v["angles"], v["v"]
        for hit in self.hits(i, j):
            both = plain[hit[0]] & plain[hit[1]]
            a, b, d, x, y = (c[both] for c in hit)
            base = cosines(vectors, a, 0, b, 0)
            alike = base >= self.least
            if self.mode != "missing":
                yield [keys[a][alike], keys[b][alike], d[alike], *([np.zeros(alike.sum(), int)] if self.mode == "turned" else []), base[alike]]
            if self.mode == "alike":
                continue
            a, b, d, x, y = (c[(base < self.least) & (angles[a, x] != angles[b, y])] for c in (a, b, d, x, y))
            if self.mode == "missing":
                for e, s in ((a, x), (b, y)):
                    e, s = e[~has[e, s]], s[~has[e, s]]
                    rows = np.unique(np.stack([keys[e], angles[e, s]]), axis=1)
                    yield [rows[0], rows[1]]
                continue
            there = has[a, x] & has[b, y]
            a, b, d, x, y = (c[there] for c in (a, b, d, x, y))
            sim = cosines(vectors, a, 1 + x, b, 1 + y)
            good = sim >= self.least
            yield [keys[a][good], keys[b][good], d[good], np.ones(good.sum(), int), sim[good]]


def grouped(prints: DataFrame) -> DataFrame | None:
    """(key, own) of ``prints`` (key, angle, bits); None if some item can't be a row of a block: keys must be integers, fingerprints
    at most ``SLOTS``, and angles known."""
    if prints.schema["key"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return None
    own = prints.where("key IS NOT NULL AND bits IS NOT NULL")
    odd = own.groupBy("key").agg(F.count("*").alias("n"), F.count("angle").alias("known")).where((F.col("n") > SLOTS) | (F.col("known") < F.col("n")))
    if not odd.isEmpty():
        return None
    return own.groupBy(F.col("key").cast("long").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("angle").cast("int").alias("angle"), "bits"))).alias("own"))


def near_items(items: DataFrame, radius: int, per: int | None = None) -> DataFrame:
    """(a, b, distance, angle_a, angle_b) of all :func:`grouped` items within ``radius``. Exact at any radius."""
    metric = Prints()
    made = packed_items(items, metric, None, per)
    return blocks.meet(made, blocks.partners(made, metric, radius, ordered=False), metric, lambda: NearItems(radius), "a long, b long, distance int, angle_a int, angle_b int")


SCHEMAS = {"alike": "a long, b long, distance int, sim double", "turned": "a long, b long, distance int, turned int, sim double", "missing": "id long, angle int"}


def judged_items(items: DataFrame, vectors: DataFrame, radius: int, least: float, mode: str, per: int | None = None) -> DataFrame:
    """What :class:`Judged` finds in :func:`grouped` items with ``vectors`` (key, angle, vector); at most one of an item's angle."""
    kind = "<f8" if "double" in vectors.schema["vector"].dataType.simpleString() else "<f4"
    known = vectors.where("vector IS NOT NULL AND size(vector) > 0")
    first = known.select(F.size("vector").alias("n")).first()
    width = first.n if first else 0
    metric = Prints(1 + SLOTS if mode == "turned" else 1, width, kind)
    # a turned vector that no pair is compared by need not be carried, only that it is there
    vector = F.col("vector") if mode == "turned" else F.when(F.col("angle") == 0, F.col("vector")).otherwise(F.slice("vector", 1, 0))
    stored = known.groupBy(F.col("key").cast("long").alias("key")).agg(F.collect_list(F.struct(F.col("angle").cast("int").alias("angle"), vector.alias("vector"))).alias("stored"))
    made = packed_items(items, metric, stored, per)
    out = blocks.meet(made, blocks.partners(made, metric, radius, ordered=False), metric, lambda: Judged(radius, least, mode), SCHEMAS[mode])
    return out.distinct() if mode == "missing" else out
