"""Dated archives of image files: ``<root>/<YYYY-MM-DD>/<category>/.../<file>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.metadata import IMAGE_TYPES

# fixed value: the category of files at a date's root
ROOT = "__date_root__"


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, archive_date, category, name, length, sha256 if ``content``) of image files in folders that are real dates.

    Directories that are no date and files of other types are left out; the category of a file at a date's root is ROOT. Without
    ``content`` only file status is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2}/[^?]*)$", 1)
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    rows = found.withColumns({"relative": relative, "archive_date": F.get(parts, F.lit(0)), "name": name}).where(F.try_to_timestamp("archive_date", F.lit("yyyy-MM-dd")).isNotNull() & F.lower(F.substring_index("name", ".", -1)).isin(*IMAGE_TYPES))
    category = F.when(F.size(F.split("relative", "/")) > 2, F.get(F.split("relative", "/"), F.lit(1))).otherwise(ROOT)
    extra = [F.sha2("content", 256).alias("sha256")] if content else []
    return rows.select("path", "archive_date", category.alias("category"), "name", "length", *extra)


def select(listed: DataFrame, date: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """Files of one date or all, of some categories or all; an unknown category is an error."""
    chosen = listed if date is None else listed.where(F.col("archive_date") == date)
    if categories is not None:
        known = {r.category for r in chosen.select("category").where(F.col("category").isin(*categories)).distinct().collect()}
        if unknown := sorted(set(categories) - known):
            raise ValueError(f"unknown categories: {', '.join(unknown)}")
        chosen = chosen.where(F.col("category").isin(*categories))
    return chosen


def valid(listed: DataFrame, most_bytes: int = 5 << 20) -> DataFrame:
    """``listed`` with the reason why a file is refused, or null."""
    return listed.withColumn("reason", F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large"))
