"""Structured Streaming over arriving items: exact duplicates against all earlier ones, batch by batch.

The stream's checkpoint says which files are done; each batch is written under its own number, so a batch that runs again replaces
itself and the result has every item once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(arriving: DataFrame, library: str, links: str, checkpoint: str) -> StreamingQuery:
    """Append (id, sha256) of ``arriving`` to ``library`` and pairs of equal digests to ``links``, then stop when all is read."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("id", "sha256").write.mode("overwrite").parquet(f"{library}/batch={number}")
        known = spark.read.schema("id string, sha256 string, batch int").parquet(library).where(F.col("batch") <= number)
        new = known.where(F.col("batch") == number)
        pairs = new.alias("n").join(known.alias("k"), "sha256").where("n.id <> k.id AND (k.batch < n.batch OR k.id < n.id)")
        pairs.select(F.least("n.id", "k.id").alias("a"), F.greatest("n.id", "k.id").alias("b")).distinct().write.mode("overwrite").parquet(f"{links}/batch={number}")

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(arriving: DataFrame, within: str = "1 day") -> DataFrame:
    """Each digest once within the watermark of ``created_at``."""
    return arriving.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["sha256"])


def read_links(spark: SparkSession, links: str) -> DataFrame:
    return spark.read.schema("a string, b string, batch int").parquet(links).select("a", "b").distinct()
