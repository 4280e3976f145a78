"""Deterministic projections of the driver's tables to items, pairs, evidence and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the classes of pairs
CLASSES = ("exact_file", "same_image", "edited_or_cropped", "background_replaced", "similar_person", "same_scene_new_capture", "repeated_checkin", "unrelated", "unverifiable")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence item for each order."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("new", "ma-mat", "ma-new", "ma-splice", "x"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    date = F.when(k % 11 == 0, "null").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    place = F.when(k % 5 == 0, "splitter").when(k % 5 == 4, "other").otherwise("home")
    customer = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    name = F.concat_ws("_", kind, date, place, customer, F.concat(F.lit("T"), F.lpad((k % 37).cast("string"), 3, "0")), F.concat(k.cast("string"), F.lit(".jpg")))
    conf = (F.lit(50) + k % 50) / 100
    box = F.concat(F.lit('{"model":"lat-long/v1","metadata_version":2,"lat_long":[],"datetime":[{"bbox":[12.6,34.3,118.7,59],"confidence":'), conf.cast("decimal(4,2)").cast("string"), F.lit("}]}"))
    meta = F.when(k % 7 == 0, box).when(k % 7 == 1, '{"model":"lat-long/v1","metadata_version":2,"lat_long":[],"datetime":[]}').when(k % 7 == 2, "not-json").when(k % 7 == 3, '{"model":"lat-long/v1","lat_long":[],"datetime":[]}')
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.lpad(k.cast("string"), 8, "0").alias("id"),
        name.alias("original_filename"),
        F.when(k % 13 == 0, customer).when(k % 17 == 0, "").alias("source_job_number"),
        none.alias("source_checkin_date"), none.alias("source_technician_id"), none.alias("source_job_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("source_archive_date"),
        F.when(k % 10 != 0, F.col("o_orderpriority")).alias("source_category"),
        F.when(F.col("o_orderstatus") == "F", "VERIFIABLE").when(F.col("o_orderstatus") == "P", "UNVERIFIABLE").alias("image_quality_status"),
        F.element_at(F.array(*map(F.lit, ("QUEUED", "COMPLETED", "UNVERIFIABLE", "COMPLETED"))), (k % 4 + 1).cast("int")).alias("analysis_status"),
        meta.alias("ai_metadata_json"),
        F.col("o_orderdate").alias("created_at"),
    )


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, score, lvl) of each line, before one row of each pair is chosen."""
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    line = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))
    other = (7 * F.col("l_orderkey") + 131 * F.col("l_linenumber") + F.col("l_partkey")) % F.col("n")
    score = F.floor(F.col("l_discount") * 1000 + 0.5) / 100
    rows = line.select(F.least("l_orderkey", other).alias("a"), F.greatest("l_orderkey", other).alias("b"), score.alias("score"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 9).alias("lvl"))
    return rows.where("a <> b")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair the row with the largest score * 100 + lvl, as stored pairwise results."""
    best = raw_pairs(spark, sf_dir).groupBy("a", "b").agg(F.max(F.struct((F.col("score") * 100 + F.col("lvl")).alias("rank"), "score", "lvl")).alias("m"))
    name = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("m.lvl") + 1).cast("int"))
    key = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    return best.select(key("a").alias("image_a_id"), key("b").alias("image_b_id"), F.col("m.score").alias("relationship_score"), name.alias("relationship_level"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a compared pair for each line."""
    q = F.col("l_quantity").cast("int")
    m = lambda k: (31 * F.col("l_partkey") + 17 * F.col("l_suppkey") + 7 * F.col("l_linenumber") + k * q + k * k) % 9973
    part = lambda k, n: (m(k) % n).cast("int")
    ratio = lambda k, n: m(k) % n / 100
    line = F.col("l_linenumber")
    transform = F.when(line == 1, "horizontal_flip").when(line == 2, "rotate_90").when(line == 3, "rotate_180").otherwise("original")
    normal = part(17, 40)
    distance = F.when(F.col("l_partkey") % 19 != 0, F.when(transform == "original", normal).otherwise(part(83, 65)))
    parts = F.create_map(*[x for name, k, n in (("head", 61, 60), ("neck", 67, 60), ("torso", 71, 20), ("uarm", 73, 12), ("hand", 79, 24)) for x in (F.lit(name), part(k, n))])
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(False).alias("exact_duplicate"), transform.alias("detected_transform"), (line == 1).alias("flip_detected"),
        F.when(line == 2, 90).when(line == 3, 180).otherwise(0).alias("rotation_degrees"),
        part(3, 90).alias("ransac_inliers"), ratio(5, 101).alias("ransac_inlier_ratio"), ratio(11, 50).alias("ransac_coverage"),
        (part(3, 90) + part(13, 60)).alias("sift_good_matches"), (20 * (F.col("l_partkey") % 60)).cast("int").alias("sift_reference_features"),
        F.when(F.col("l_suppkey") % 7 != 0, F.floor(F.col("l_discount") * 1000 + 0.5) / 100).alias("embedding_similarity"),
        normal.alias("phash_normal_distance"), distance.alias("phash_distance"), F.lit(64).alias("phash_max_distance"),
        part(19, 60).alias("foreground_inliers"), ratio(23, 101).alias("foreground_ratio"), ratio(29, 30).alias("foreground_coverage"),
        part(31, 80).alias("background_inliers"), ratio(37, 101).alias("background_ratio"), ratio(41, 10).alias("background_coverage"),
        part(43, 400).cast("double").alias("blur_variance_a"), part(47, 400).cast("double").alias("blur_variance_b"),
        ratio(53, 101).alias("heatmap_foreground_change"), ratio(59, 101).alias("heatmap_background_change"), parts.alias("body_part_inliers"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, angle, hi, lo): sign bits of each vector, most significant first, shifted cyclically by 16 places for each 90 degrees."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v > 0).cast("long")).alias("bits"))
    turned = e.select("vec_id", "bits", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("angle"))
    at = lambda i: F.get(F.col("bits"), ((F.lit(i) + F.col("angle") / 90 * 16) % 64).cast("int"))
    half = lambda a: sum((at(a + i) * (1 << (31 - i)) for i in range(32)), F.lit(0).cast("long"))
    return turned.select("vec_id", "angle", half(0).alias("hi"), half(32).alias("lo"))


def rotated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, angle, vector) as stored embeddings of turned images: all plain ones, and the turned ones of two ids in three.

    The driver's vectors have no pictures, so a cyclic shift by 16 places for each 90 degrees stands for what the model would return.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("angle")).where("angle = 0 OR id % 3 <> 0")
    at = (F.col("angle") / 90 * 16).cast("int")
    return e.select("id", "angle", F.concat(F.slice("embedding", at + 1, F.size("embedding")), F.slice("embedding", F.lit(1), at)).alias("vector"))
