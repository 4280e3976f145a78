"""All near pairs, and nearest neighbours, of fingerprints or vectors, by blocks that are packed into rows and met in strips.

Rows (key, data) go to the nearest of a bounded number of pivots; what gathers at a pivot is cut into blocks of about ``per`` rows. A
block is one row with all its keys and values, its centre and its radius. By the triangle inequality two blocks may hold a near pair
only if their centres are no further apart than both radii and the reach together; only such blocks meet and are compared as matrices
within a task. Blocks lie in strips of consecutive numbers, and a task takes two strips: it holds the blocks of one and reads those of
the other one by one, so a block is sent once for each strip that it meets and not for each block. Nothing but pivots, centres and radii
passes through the driver. Values that cannot be told apart by any index (random bits at a wide radius) are compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.plans.scratch import materialize

#: Pivots at most, chosen from a sample of four times as many rows (which decides about speed only); beyond ``MAX_PIVOTS * per`` rows blocks grow in number by cutting what gathers at a pivot.
MAX_PIVOTS = 4096
TILE = 256
#: Rows of vectors that are compared in single precision at once: their similarities stay in the cache.
SINGLE = 64
#: Strips that there are at least, if there are as many blocks, and blocks of a strip at most.
STRIPS, HELD = 6, 32
#: Rows of a result that go to the JVM at once.
OUT = 1 << 16


class Hamming:
    """64-bit values, eight bytes each, the most significant first."""

    per = 16_384

    @staticmethod
    def matrix(data: bytes) -> np.ndarray:
        return np.frombuffer(data, ">u8").astype(np.uint64)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a[:, None] ^ b[None])

    @staticmethod
    def centre(values: np.ndarray) -> bytes:
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        return np.packbits(2 * bits.sum(0) >= len(values)).tobytes()

    @classmethod
    def radius(cls, values: np.ndarray, centre: np.ndarray) -> float:
        return float(cls.distances(values, centre).max())

    gaps = distances


class Angle:
    """Unit vectors of doubles; the distance is the angle. A block that holds a null vector has the largest radius."""

    per = 4096

    def __init__(self, width: int):
        self.width = width

    def matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<f8").reshape(-1, self.width)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(a @ b.T, -1, 1))

    @staticmethod
    def centre(values: np.ndarray) -> bytes:
        mean = values.mean(0)
        size = np.linalg.norm(mean)
        return (mean / size if size > 1e-9 else values[0]).astype("<f8").tobytes()

    def radius(self, values: np.ndarray, centre: np.ndarray) -> float:
        if not (np.linalg.norm(values, axis=1) > 0.5).all():
            return float(np.pi)
        return float(self.distances(values, centre).max()) + 1e-7

    gaps = distances


def packed(rows: DataFrame, metric, per: int | None = None) -> DataFrame:
    """(block, n, keys, data, centre, radius) of ``rows`` (key long, data binary); keys are in ascending order within a block."""
    spark = rows.sparkSession
    per, n = per or metric.per, rows.count()
    if not n:
        return spark.createDataFrame([], "block int, n int, keys binary, data binary, centre binary, radius double")
    dealt = rows.select(F.lit(0).alias("block"), "key", "data") if n <= per else _dealt(rows, metric, per, n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, data = None, [], []

        def done() -> pa.RecordBatch:
            value = b"".join(data)
            centre = metric.centre(metric.matrix(value))
            columns = [[block], [len(keys)], [np.array(keys, "<i8").tobytes()], [value], [centre], [metric.radius(metric.matrix(value), metric.matrix(centre))]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "n", "keys", "data", "centre", "radius"])

        for batch in batches:
            for b, key, value in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if keys:
                        yield done()
                    block, keys, data = b, [], []
                keys.append(key)
                data.append(value)
        if keys:
            yield done()

    made = dealt.repartition("block").sortWithinPartitions("block", "key")
    return materialize(made.mapInArrow(pack, "block int, n int, keys binary, data binary, centre binary, radius double"), "packed")


def spread(values: np.ndarray, metric, p: int) -> list[int]:
    """Places of ``p`` values, each as far as can be from those before it."""
    chosen, far = [0], metric.distances(values[:1], values)[0]
    while len(chosen) < min(p, len(values)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, metric.distances(values[chosen[-1] :][:1], values)[0])
    return chosen


def _dealt(rows: DataFrame, metric, per: int, n: int) -> DataFrame:
    """(block, key, data): rows by their nearest pivot, and what gathers there cut by the key's hash."""
    p = int(min(MAX_PIVOTS, -(-n // per)))
    sample = [bytes(r.data) for r in rows.orderBy(F.xxhash64("key"), "key").limit(4 * p).select("data").collect()]
    shared = rows.sparkSession.sparkContext.broadcast(b"".join(sample[i] for i in spread(metric.matrix(b"".join(sample)), metric, p)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = metric.matrix(shared.value)
        for batch in batches:
            values = metric.matrix(b"".join(batch.column(1).to_pylist()))
            nearest = [metric.distances(values[at : at + TILE], own).argmin(1) for at in range(0, len(values), TILE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(nearest).astype(np.int32))], ["key", "data", "pivot"])

    assigned = materialize(rows.select("key", "data").mapInArrow(assign, "key long, data binary, pivot int"), "assigned")
    counts, blocks = [], 0
    for r in assigned.groupBy("pivot").count().collect():
        counts.append((r.pivot, blocks, -(-r["count"] // per)))
        blocks += counts[-1][2]
    cuts = F.broadcast(rows.sparkSession.createDataFrame(counts, "pivot int, first int, cuts int"))
    return assigned.join(cuts, "pivot").select((F.col("first") + F.pmod(F.xxhash64("key", F.lit(7)), F.col("cuts"))).cast("int").alias("block"), "key", "data")


def partners(blocks: DataFrame, metric, reach: np.ndarray | float, ordered: bool) -> DataFrame:
    """(i, j) of blocks that may hold a pair within ``reach`` (one number, or one for each block i).

    ``ordered``: both (i, j) and (j, i) but not (i, i); else i <= j.
    """
    spark = blocks.sparkSession
    rows = blocks.select("block", "centre", "radius").orderBy("block").collect()
    numbers = np.array([r.block for r in rows], np.int64)
    reach = np.broadcast_to(np.asarray(reach, float), len(rows))
    shared = spark.sparkContext.broadcast((numbers, b"".join(bytes(r.centre) for r in rows), np.array([r.radius for r in rows]), reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres, radius, reach = shared.value
        centres = metric.matrix(centres) if len(numbers) else None
        for batch in batches:
            for i in batch.column(0).to_numpy():
                at = int(np.searchsorted(numbers, i))
                near = metric.gaps(centres[at : at + 1], centres)[0] <= radius[at] + radius + reach[at] + 1e-9
                near[at] = True
                j = numbers[near & ((numbers != i) if ordered else (numbers >= i))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(j.astype(np.int32))], ["i", "j"])

    return blocks.select("block").repartition("block").mapInArrow(run, "i int, j int")


@dataclass
class Block:
    number: int
    keys: np.ndarray
    values: np.ndarray
    partners: frozenset[int] = frozenset()
    floor: np.ndarray | None = None


class Meeting:
    """What a task does with the blocks of two strips: arrays of the result's columns for each two blocks, and for those that end."""

    def meet(self, i: Block, j: Block) -> Iterator[list[np.ndarray]]:
        return iter(())

    def done(self, held: list[Block]) -> Iterator[list[np.ndarray]]:
        return iter(())


def meet(blocks: DataFrame, pairs: DataFrame, metric, meeting: Callable[[], Meeting], schema: str) -> DataFrame:
    """What ``meeting`` makes of each pair (i, j) of blocks, as rows of ``schema`` (numbers only). ``blocks`` may have a floor, a number for each key."""
    spark = blocks.sparkSession
    pairs, n = materialize(pairs, "partners"), blocks.count()
    size = max(1, min(HELD, n // STRIPS))
    own = pairs.withColumn("cell", F.floor(F.col("i") / size) * (1 << 32) + F.floor(F.col("j") / size))
    held = own.groupBy("cell", F.col("i").alias("block")).agg(F.sort_array(F.collect_list("j")).alias("js"))
    read = own.select("cell", F.col("j").alias("block"), F.lit(None).cast("array<int>").alias("js")).distinct()
    there = materialize(held.unionByName(read), "strips")
    # a partition for each cell: by a hash some would get several and others none
    cells = materialize(there.select("cell").distinct().withColumn("at", F.row_number().over(Window.orderBy("cell")) - 1), "cells")
    there, count = there.join(F.broadcast(cells), "cell"), max(1, cells.count())
    floor = F.col("floor") if "floor" in blocks.columns else F.lit(None).cast("array<double>").alias("floor")
    rows = blocks.select("block", "keys", "data", floor).join(there, "block").select(F.col("at").alias("cell"), F.col("js").isNull().alias("read"), "block", "js", "keys", "data", "floor")
    names = spark.createDataFrame([], schema).schema.names
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, strip = None, None, []
        made, n = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, n
            columns = [np.concatenate(c) for c in zip(*made)]
            made, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def results() -> Iterator[list[np.ndarray]]:
            nonlocal cell, own, strip
            for batch in batches:
                for r in range(batch.num_rows):
                    c, read, number, js, keys, data, floor = (batch.column(k)[r] for k in range(7))
                    if c.as_py() != cell:
                        if own:
                            yield from own.done(strip)
                        cell, own, strip = c.as_py(), meeting(), []
                    block = Block(number.as_py(), np.frombuffer(keys.as_py(), "<i8"), metric.matrix(data.as_py()), frozenset(js.as_py() or ()))
                    if not read.as_py():
                        block.floor = floor.values.to_numpy() if floor.is_valid else None
                        strip.append(block)
                        continue
                    for i in strip:
                        if block.number in i.partners:
                            yield from own.meet(i, block)
            if own:
                yield from own.done(strip)

        for columns in results():
            made.append(columns)
            n += len(columns[0])
            if n >= OUT:
                yield flush()
        if n:
            yield flush()

    return rows.repartitionById(count, "cell").sortWithinPartitions("cell", "read", "block").mapInArrow(run, schema)


class _NearValues(Meeting):
    def __init__(self, radius: int):
        self.radius = radius

    def meet(self, i: Block, j: Block) -> Iterator[list[np.ndarray]]:
        for at in range(0, len(i.values), TILE):
            d = Hamming.distances(i.values[at : at + TILE], j.values)
            x, y = np.nonzero(d <= self.radius)
            u, v, found = i.keys[at + x], j.keys[y], d[x, y]
            if i.number == j.number:
                u, v, found = u[u < v], v[u < v], found[u < v]
            yield [np.minimum(u, v), np.maximum(u, v), found.astype(np.int32)]


def near_values(values: DataFrame, radius: int, per: int | None = None) -> DataFrame:
    """(u, v, distance), u < v, of distinct 64-bit ``values`` (bits long) within ``radius``. Exact at any radius."""
    rows = values.select(F.col("bits").alias("key"), F.unhex(F.lpad(F.hex("bits"), 16, "0")).alias("data"))
    blocks = packed(rows, Hamming, per)
    return meet(blocks, partners(blocks, Hamming, radius, ordered=False), Hamming, lambda: _NearValues(radius), "u long, v long, distance int")


def best_of_block(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each row; of equal ones the first columns."""
    if sims.shape[1] <= k:
        x, y = np.indices(sims.shape)
        return x.ravel(), y.ravel()
    edge = np.partition(sims, -k, axis=1)[:, -k, None]
    taken = sims > edge
    room = k - taken.sum(1)
    even = sims == edge
    many = np.flatnonzero(even.sum(1) > room)
    for r in many:
        even[r, np.flatnonzero(even[r])[room[r] :]] = False
    return np.nonzero(taken | even)


def _exact(i: Block, j: Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of i, rows of j and similarity of the ``k`` most alike in j, equal ones (to nine places) by key."""
    for at in range(0, len(i.values), TILE):
        sims = i.values[at : at + TILE] @ j.values.T
        x, y = best_of_block(np.round(sims, 9), k)
        yield at + x, y, sims[x, y]


class _Nearest(Meeting):
    """The k most alike of each row of the held blocks, over all blocks read.

    Once a row has k, or a floor that k others reach, similarities in single precision leave out what is below its k-th by more than their error; what remains is
    computed in double precision.
    """

    def __init__(self, k: int):
        self.k, self.best, self.least, self.new, self.single = k, {}, {}, {}, (None, None)

    def _merge(self, i: Block) -> None:
        x, keys, sims = (np.concatenate(c) for c in zip(*([self.best[i.number]] if i.number in self.best else []), *self.new.pop(i.number)))
        rounded = np.round(sims, 9)
        order = np.lexsort((keys, -rounded, x))
        x = x[order]
        nth = np.arange(len(x)) - np.searchsorted(x, x)
        taken, full = nth < self.k, nth == self.k - 1
        least = np.full(len(i.keys), -np.inf)
        least[x[full]] = rounded[order][full]
        self.least[i.number] = least if i.floor is None else np.maximum(least, i.floor)
        self.best[i.number] = (x[taken], keys[order][taken], sims[order][taken])

    def meet(self, i: Block, j: Block) -> Iterator[list[np.ndarray]]:
        new = self.new.setdefault(i.number, [])
        least = self.least.get(i.number, i.floor)
        if least is None or not (least >= -1).all():
            new += [(x, j.keys[y], sims) for x, y, sims in _exact(i, j, self.k)]
            self._merge(i)
            return iter(())
        width = i.values.shape[1]
        least = least - 1e-9 - (width + 8) * 2.0**-23
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
        if self.single[0] != j.number:
            self.single = (j.number, np.ascontiguousarray(j.values.T.astype(np.float32)))
        a = i.values.astype(np.float32)
        for at in range(0, len(a), SINGLE):
            x, y = np.divmod(np.flatnonzero(a[at : at + SINGLE] @ self.single[1] >= least[at : at + SINGLE]), len(j.keys))
            if len(x):
                new.append((at + x, j.keys[y], np.einsum("ij,ij->i", i.values[at + x], j.values[y])))
        if sum(len(x) for x, _, _ in new) >= len(a) * self.k / 2:
            self._merge(i)
        return iter(())

    def done(self, held: list[Block]) -> Iterator[list[np.ndarray]]:
        for i in held:
            if self.new.get(i.number):
                self._merge(i)
            if i.number in self.best:
                x, keys, sims = self.best.pop(i.number)
                yield [np.full(len(x), i.number), i.keys[x], keys, sims]


def nearest(rows: DataFrame, width: int, k: int, per: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, match, sim): at least the k most alike of each of ``rows`` (key, data), equal ones by key; and the pairs of blocks that met.

    Each block is first compared with itself. The k-th similarity of the query that has found least tells how far its block has to
    look; blocks beyond are left out.
    """
    metric = Angle(width)
    blocks = packed(rows, metric, per)
    schema = "block int, query long, match long, sim double"
    itself = blocks.select(F.col("block").alias("i"), F.col("block").alias("j"))
    own = materialize(meet(blocks, itself, metric, lambda: _Nearest(k), schema), "nearest")
    found = own.groupBy("block", "query").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-1.0).alias("kth"))
    least = {r.block: r.kth for r in found.groupBy("block").agg(F.min("kth").alias("kth")).collect()}
    reach = np.array([np.arccos(np.clip(least[b] - 1e-8, -1, 1)) for b in sorted(least)])
    met = materialize(partners(blocks, metric, reach, ordered=True), "partners")
    floors = found.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("query", "kth"))), lambda x: F.round(x["kth"], 9)).alias("floor"))
    return own.unionByName(meet(blocks.join(floors, "block"), met, metric, lambda: _Nearest(k), schema)).drop("block"), met
