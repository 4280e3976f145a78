"""What happens to files and rows before analysis: selection, validation, paths, caches, the vector index, updates and deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.evidence import cascade
from evigraph.functions.metadata import blank_to_null, usable

# fixed values: accepted formats and their types, and the four angles of a complete fingerprint
FORMATS = {"JPEG": "image/jpeg", "PNG": "image/png", "WEBP": "image/webp", "TIFF": "image/tiff", "BMP": "image/bmp"}
ANGLES = 4


def refused(files: DataFrame, allowed: tuple[str, ...] = tuple(FORMATS.values()), most_bytes: int = 5 << 20, most_pixels: int = 40_000_000) -> DataFrame:
    """``files`` (length, decodable, width, height, format) with the first reason why one is refused, or null."""
    kinds = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    mime = F.element_at(kinds, F.col("format"))
    pixels = F.col("width").cast("long") * F.col("height")
    rules = [(F.col("length") > most_bytes, "too_large"), (~F.col("decodable"), "not_decodable"), (pixels > most_pixels, "too_many_pixels"), (mime.isNull(), "unsupported_format"), (~mime.isin(*allowed), "type_disabled")]
    return files.withColumn("reason", cascade(rules, None))


def upload_selection(files: DataFrame, batch: str, most_files: int = 5000, most_total: int = 1000 << 20, most_bytes: int = 5 << 20) -> DataFrame:
    """``files`` (``batch``, mime, size) with accepted: of a known type and size, in a batch that is not too long or too heavy.

    A batch counts all its files, and the bytes of its valid ones; one above either limit is refused whole.
    """
    valid = F.col("mime").isin(*FORMATS.values()) & (F.col("size") <= most_bytes)
    marked = files.withColumn("valid", F.coalesce(valid, F.lit(False)))
    totals = marked.groupBy(batch).agg(((F.count("*") <= most_files) & (F.coalesce(F.sum(F.when(F.col("valid"), F.col("size"))), F.lit(0)) <= most_total)).alias("fits"))
    return marked.join(totals, batch).withColumn("accepted", F.col("valid") & F.col("fits")).drop("valid", "fits")


def upload_plan(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, existing_id, action) of ``uploads`` (id, sha256): the item that has the digest already, the smallest, or an insert."""
    known = existing.groupBy("sha256").agg(F.min("id").alias("existing_id"))
    return uploads.join(known, "sha256", "left").select("id", "existing_id", F.when(F.col("existing_id").isNull(), "insert").otherwise("existing").alias("action"))


def resolved_paths(items: DataFrame, files: DataFrame, root: str, readable: tuple[str, ...] = ()) -> DataFrame:
    """(id, path) of ``items`` (id, storage_path): the stored path if it exists (in ``files``, path) and is trusted, else the one file
    named by the id in its folder of the root, else null.

    A path is trusted within the root if its stem is the id, or within a readable root; none with a step to a parent folder is.
    """
    stored = F.col("storage_path")
    stem = lambda p: F.regexp_replace(F.substring_index(p, "/", -1), r"\.[^.]*$", "")
    inside = lambda p, top: p.startswith(top.rstrip("/") + "/")
    others = [inside(stored, r) for r in readable if r != root]
    trusted = ~stored.contains("/../") & reduce(lambda a, b: a | b, others, inside(stored, root) & (stem(stored) == F.col("id")))
    present = files.select(F.col("path").alias("storage_path"), F.lit(True).alias("present")).distinct()
    named = files.select("path", stem(F.col("path")).alias("id")).distinct()
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), F.substring("id", 1, 2))
    named = named.where(F.regexp_replace("path", "/[^/]*$", "") == folder)
    single = named.groupBy("id").agg(F.min("path").alias("own"), F.count("*").alias("n")).where("n = 1").select("id", "own")
    rows = items.select("id", "storage_path").join(present, "storage_path", "left").join(single, "id", "left")
    return rows.select("id", F.when(F.coalesce(F.col("present") & trusted, F.lit(False)), stored).otherwise(F.col("own")).alias("path"))


def legacy(items: DataFrame, version: str) -> DataFrame:
    """Rows that older versions left unfinished, with needs_import, needs_quality and needs_rotations.

    ``items`` has image_quality_version, sha256 and n_rotations besides the usual columns.
    """
    status = F.col("image_quality_status")
    rows = items.select(
        "*",
        (F.col("source_archive_date").isNotNull() & blank_to_null(F.col("sha256")).isNull() & status.isNull()).alias("needs_import"),
        (~F.col("image_quality_version").eqNullSafe(F.lit(version))).alias("needs_quality"),
        (usable(status) & ~F.col("n_rotations").eqNullSafe(F.lit(ANGLES))).alias("needs_rotations"),
    )
    return rows.where("needs_import OR needs_quality OR needs_rotations")


def updated(items: DataFrame, results: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``items`` whose ``columns`` are taken from ``results`` where that has the key (once), nulls included."""
    new = results.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = items.join(new, key, "left")
    return rows.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in items.columns])


def next_steps(items: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """(id, action): finished items are skipped unless forced, unusable ones completed as they are, all others processed."""
    rows = items.join(done.select("id", F.lit(True).alias("done")).distinct(), "id", "left")
    skip = F.lit(False) if force else F.coalesce("done", F.lit(False))
    return rows.select("id", F.when(skip, "skip").when(~usable(F.col("image_quality_status")), "complete").otherwise("process").alias("action"))


def public(items: DataFrame) -> DataFrame:
    """What is shown of a row: all but where its file lies."""
    return items.drop("storage_path")


def unit(v: Column) -> Column:
    """A vector over its length; a null or zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def index_add(index: DataFrame, new: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``index`` and the unit vectors of those of ``new`` whose key it lacks; one row for each key."""
    return index.unionByName(new.join(index.select(key), key, "left_anti").select(key, unit(F.col(vector)).alias(vector)).dropDuplicates([key]))


def index_remove(index: DataFrame, gone: DataFrame, key: str = "vec_id") -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def with_features(items: DataFrame, cache: DataFrame, params: str, compute: Column) -> tuple[DataFrame, DataFrame]:
    """``items`` (sha256, ...) with cached and feature, and the rows that the cache (sha256, params, feature) lacked.

    Each digest that the cache lacks for these parameters is computed once, from the smallest of its rows by all columns.
    """
    known = cache.where(F.col("params") == params).select("sha256", "feature", F.lit(True).alias("cached"))
    one = items.join(known, "sha256", "left_anti").groupBy("sha256").agg(F.min(F.struct(*[c for c in items.columns if c != "sha256"])).alias("r")).select("sha256", "r.*")
    new = one.select("sha256", F.lit(params).alias("params"), compute.alias("feature"))
    every = known.unionByName(new.select("sha256", "feature", F.lit(False).alias("cached")))
    return items.join(every, "sha256"), new


def restricted(gone: DataFrame, children: DataFrame, *foreign: str) -> DataFrame:
    """(id, blocked) of ``gone`` (id): whether a row of ``children`` refers to it, so that it must stay."""
    used = reduce(lambda a, b: a.unionByName(b), [children.select(F.col(c).alias("id")) for c in foreign]).distinct()
    return gone.select("id").join(used.withColumn("used", F.lit(True)), "id", "left").select("id", F.col("used").isNotNull().alias("blocked"))
