"""Candidate pairs: exact duplicates, top-K cosine, Hamming radius over rotations, their union and filters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators import blocks
from evigraph.operators import prints as P
from evigraph.plans.scratch import materialize

#: Bits of a 16-bit part up to which its neighbours are listed: 137 of 65 536 values.
INDEXED = 2
#: Values of a part's list that are joined by rows; longer lists go to the comparison by blocks.
CROWDED = 4096


def exact_duplicates(items: DataFrame, key: str = "id", digest: str = "sha256") -> DataFrame:
    """(a, b), a < b, of equal digests."""
    a, b = items.select(F.col(key).alias("a"), digest), items.select(F.col(key).alias("b"), digest)
    return a.join(b, digest).where("a < b").select("a", "b")


def duplicate_classes(items: DataFrame, key: str = "id", digest: str = "sha256") -> DataFrame:
    """(id, representative, size) of items that share their digest: linear in the rows, where pairs grow with the square of a class."""
    classes = items.groupBy(digest).agg(F.min(key).alias("representative"), F.count("*").alias("size")).where("size > 1")
    return items.join(classes, digest).select(F.col(key).alias("id"), "representative", "size")


def needed_rotations(hits: DataFrame) -> DataFrame:
    """(id, angle) whose turned vectors fingerprint hits (a, b, angle_a, angle_b, base) ask for: those alike by fingerprint only, at unlike angles."""
    own = hits.where("angle_a <> angle_b").select(F.explode(F.array(*[F.struct(F.col(s).alias("id"), F.col(f"angle_{s}").alias("angle")) for s in "ab"])).alias("x"))
    return own.select("x.*").distinct()


def missing_rotations(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """What the model has to embed: needed (id, angle) that ``stored`` (id, angle, vector) lacks."""
    return needed_rotations(hits).join(stored.select("id", "angle"), ["id", "angle"], "left_anti")


def aligned_cosine(hits: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, distance, source, sim) of fingerprint hits (a, b, distance, angle_a, angle_b) whose vectors are alike as they are, or turned alike.

    ``vectors`` (id, angle, vector) are stored ones; angle 0 is the plain one. Hits alike by their plain vectors pass. Of the others,
    those whose angles differ are compared by both sides' vectors at their own angle; a hit without one of these vectors doesn't pass.
    """
    side = lambda s, v, *on: v.select(F.col("id").alias(s), *on, F.col("vector").alias(f"v{s}"))
    plain = vectors.where("angle = 0")
    rows = hits.join(side("a", plain), "a").join(side("b", plain), "b").withColumn("base", cosine(F.col("va"), F.col("vb"))).drop("va", "vb")
    rows = materialize(rows, "hits")
    alike = rows.where(F.col("base") >= least).select("a", "b", "distance", F.lit("phash_and_base").alias("source"), F.col("base").alias("sim"))
    rest = rows.where((F.col("base") < least) & (F.col("angle_a") != F.col("angle_b")))
    turned = vectors.join(needed_rotations(rest), ["id", "angle"], "left_semi")
    for s in "ab":
        rest = rest.join(side(s, turned, F.col("angle").alias(f"angle_{s}")), [s, f"angle_{s}"])
    rest = rest.withColumn("sim", cosine(F.col("va"), F.col("vb"))).where(F.col("sim") >= least)
    return alike.unionByName(rest.select("a", "b", "distance", F.lit("phash_and_rotated").alias("source"), "sim"))


def cosine(a: Column, b: Column) -> Column:
    """Inner product over norms, at least 1e-12, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, data): each vector over its norm, as bytes; null and empty ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v.astype("<f8")], pa.binary())], ["key", "data"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    return rows.mapInArrow(run, "key long, data binary")


def topk_cosine(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", per: int | None = None) -> DataFrame:
    """(query, match, sim, rank): the k nearest of every vector, itself included; ties by key. Exact.

    Equal vectors are one query and one entry of the index with its k smallest keys, so n of them give n * k rows and no more work
    than one. Blocks of vectors are compared within tasks (:mod:`evigraph.operators.blocks`), those too far away are left out. Null and
    empty vectors have no match.
    """
    spark = vectors.sparkSession
    rows = materialize(unit_vectors(vectors, key, vector), "vectors")
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], "query long, match long, sim double, rank int")
    same = Window.partitionBy("data").orderBy("key")
    kept = materialize(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k), "kept")
    alone = kept.where("nth = 1").select("key", "data")
    out, _ = blocks.nearest(alone, len(first.data) // 8, k, per)
    best = Window.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "match")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = ranked(out)
    if rows.count() == alone.count():
        return out
    names = materialize(rows.join(alone.withColumnRenamed("key", "named"), "data").select("key", "named"), "named")
    members = kept.join(alone.withColumnRenamed("key", "named"), "data").select(F.col("named").alias("match"), F.col("key").alias("member"))
    out = ranked(out.drop("rank").join(members, "match").select("query", F.col("member").alias("match"), "sim"))
    return out.withColumnRenamed("query", "named").join(names.withColumnRenamed("key", "query"), "named").select("query", "match", "sim", "rank")


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def _masks(width: int, most: int) -> list[int]:
    return [sum(1 << p for p in c) for k in range(most + 1) for c in combinations(range(width), k)]


def hamming_pairs(prints: DataFrame, radius: int, key: str = "vec_id", rotations: bool = True, per: int | None = None) -> DataFrame:
    """(a, b, distance, angle_a, angle_b), a < b, within ``radius`` under the best rotations: least distance, then angles. Exact.

    At a radius that no index helps, items are compared with all their fingerprints (:mod:`evigraph.operators.prints`). Else only
    distinct fingerprints are (:func:`near_prints`), and all that share one have its partners.
    """
    own = _bits(prints, key)
    own = own if rotations else own.where("angle = 0")
    own = materialize(own, "prints")
    if not _indexable(radius) and (items := P.grouped(own)) is not None:
        found = P.near_items(items, radius, per)
        kind = {c: own.schema["key" if c in "ab" else "angle"].dataType for c in ("a", "b", "angle_a", "angle_b")}
        return found.select(*[F.col(c).cast(kind[c]).alias(c) if c in kind else c for c in found.columns])
    near = near_prints(own, radius, per)
    side = lambda s, on: own.select(F.col("bits").alias(on), F.col("key").alias(s), F.col("angle").alias(f"angle_{s}"))
    met = near.join(side("a", "u"), "u").join(side("b", "v"), "v").where("a <> b")
    ordered = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    hits = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", ordered("angle_a", "angle_b").alias("angle_a"), ordered("angle_b", "angle_a").alias("angle_b"))
    best = hits.groupBy("a", "b").agg(F.min(F.struct("distance", "angle_a", "angle_b")).alias("m"))
    return best.select("a", "b", "m.*")


def _bits(prints: DataFrame, key: str) -> DataFrame:
    return prints.select(F.col(key).alias("key"), "angle", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("bits"))


def _indexable(radius: int) -> bool:
    return max(part_radii(radius)) <= INDEXED


def _judged(prints: DataFrame, vectors: DataFrame, radius: int, least: float, mode: str, key: str, per: int | None) -> DataFrame | None:
    if _indexable(radius) or (items := P.grouped(materialize(_bits(prints, key), "prints"))) is None:
        return None
    return P.judged_items(items, vectors.withColumnRenamed("id", "key"), radius, least, mode, per)


def near_and_alike(prints: DataFrame, vectors: DataFrame, radius: int, least: float, key: str = "vec_id", per: int | None = None) -> DataFrame:
    """(a, b, distance, sim) of fingerprint hits whose plain ``vectors`` (id, angle, vector) are alike: hits are judged where they are found."""
    if (out := _judged(prints, vectors.where("angle = 0"), radius, least, "alike", key, per)) is not None:
        return out
    side = lambda s: vectors.where("angle = 0").select(F.col("id").alias(s), F.col("vector").alias(f"v{s}"))
    rows = hamming_pairs(prints, radius, key, per=per).join(side("a"), "a").join(side("b"), "b")
    return rows.withColumn("sim", cosine(F.col("va"), F.col("vb"))).where(F.col("sim") >= least).select("a", "b", "distance", "sim")


def near_and_turned(prints: DataFrame, vectors: DataFrame, radius: int, least: float, key: str = "vec_id", per: int | None = None) -> DataFrame:
    """:func:`aligned_cosine` of all fingerprint hits, which are judged where they are found."""
    out = _judged(prints, vectors, radius, least, "turned", key, per)
    if out is None:
        return aligned_cosine(hamming_pairs(prints, radius, key, per=per), vectors, least)
    source = F.when(F.col("turned") == 0, "phash_and_base").otherwise("phash_and_rotated")
    return out.select("a", "b", "distance", source.alias("source"), "sim")


def near_and_missing(prints: DataFrame, vectors: DataFrame, radius: int, least: float, key: str = "vec_id", per: int | None = None) -> DataFrame:
    """:func:`missing_rotations` of all fingerprint hits whose plain vectors are less alike than ``least``."""
    if (out := _judged(prints, vectors, radius, least, "missing", key, per)) is not None:
        return out
    side = lambda s: vectors.where("angle = 0").select(F.col("id").alias(s), F.col("vector").alias(f"v{s}"))
    hits = hamming_pairs(prints, radius, key, per=per).join(side("a"), "a").join(side("b"), "b")
    return missing_rotations(hits.where(cosine(F.col("va"), F.col("vb")) < least), vectors)


def near_prints(prints: DataFrame, radius: int, per: int | None = None) -> DataFrame:
    """(u, v, distance), u <= v, of all fingerprints in ``prints`` (bits) within ``radius``, each with itself. Exact.

    If each part i of four 16-bit parts differed in more than t_i bits, all would differ in the sum of (t_i + 1) at least; with that sum
    just above the radius one part is within its t_i. Up to INDEXED bits that is rare, and an equi-join over parts finds the
    candidates; values of parts that crowd are left to the comparison by blocks. At wider radii a part's neighbourhood holds a large
    share of all values, and comparing blocks (:mod:`evigraph.operators.blocks`) costs less than any index over parts.
    """
    values = materialize(prints.select("bits").distinct(), "values")
    itself = values.select(F.col("bits").alias("u"), F.col("bits").alias("v"), F.lit(0).alias("distance"))
    near = _indexed(values, radius, per) if _indexable(radius) else blocks.near_values(values, radius, per)
    return near.unionByName(itself)


def part_radii(radius: int, parts: int = 4) -> list[int]:
    """The widest radius for each part such that sum(t + 1) = radius + 1; -1 needs no look at that part."""
    return [(radius + 1 + k) // parts - 1 for k in range(parts)]


def _indexed(values: DataFrame, radius: int, per: int | None) -> DataFrame:
    """Multi-index hashing: one side brings the values within its radius of each part, the other the part itself."""
    part = lambda k: F.shiftrightunsigned("bits", 48 - 16 * k).bitwiseAND(F.lit(65535))
    wide = part_radii(radius)
    own = values.select("bits", F.posexplode(F.array(*map(part, range(4)))).alias("part", "value"))
    own = own.where(F.col("part").isin(*[k for k, t in enumerate(wide) if t >= 0]))
    # at most one value in CROWDED rows of a part crowds
    crowded = materialize(own.groupBy("part", "value").count().where(F.col("count") > CROWDED).select("part", "value"), "crowded")
    masks = F.array(*[F.array(*[F.lit(m) for m in _masks(16, max(t, 0))]) for t in wide])
    near = own.withColumn("mask", F.explode(F.get(masks, F.col("part")))).withColumn("value", F.col("value").bitwiseXOR(F.col("mask").cast("long"))).drop("mask")
    sparse = own.join(F.broadcast(crowded), ["part", "value"], "left_anti")
    met = near.alias("x").join(sparse.alias("y"), F.expr("x.part = y.part AND x.value = y.value AND x.bits <> y.bits"))
    pairs = met.select(F.least("x.bits", "y.bits").alias("u"), F.greatest("x.bits", "y.bits").alias("v"))
    pairs = pairs.withColumn("distance", F.bit_count(F.col("u").bitwiseXOR(F.col("v")))).where(F.col("distance") <= radius)
    if not crowded.isEmpty():
        # both sides of a pair that only a crowded value would show lie in its neighbourhood
        around = near.join(F.broadcast(crowded), ["part", "value"], "left_semi").select("bits").distinct()
        pairs = pairs.unionByName(blocks.near_values(materialize(around, "around"), radius, per))
    return pairs.distinct()


def union_sources(*legs: tuple[str, int, DataFrame]) -> DataFrame:
    """(a, b, sources, sim): all legs' pairs (a, b, sim), their names sorted, and the score of the leg of highest priority."""
    rows = None
    for name, priority, leg in legs:
        own = leg.select("a", "b", "sim", F.lit(name).alias("source"), F.lit(priority).alias("priority"))
        rows = own if rows is None else rows.unionByName(own)
    return united(rows)


def united(rows: DataFrame) -> DataFrame:
    """:func:`union_sources` of rows (a, b, sim, source, priority)."""
    best = F.max(F.struct("priority", "sim"))
    return rows.groupBy("a", "b").agg(F.array_sort(F.collect_set("source")).alias("sources"), best.alias("m")).select("a", "b", "sources", F.col("m.sim").alias("sim"))


def unseen(candidates: DataFrame, seen: DataFrame, force: bool = False) -> DataFrame:
    return candidates if force else candidates.join(seen.select("a", "b"), ["a", "b"], "left_anti")
