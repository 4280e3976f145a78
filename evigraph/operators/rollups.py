"""Daily roll-ups that can be added up: counts, and sets of customers as bitmaps, so that distinct counts of any period are exact.

Customers have dense numbers in a table of their own. A day is a few rows, one for each 32 768 numbers that occur, with the bitmap of all
customers and that of those with reused images; plain counts stand in the row of bucket -1. A period's distinct customers are the bits of
its days' bitmaps or-ed bucket by bucket. A day that comes again, with what was late, takes the place of the one that was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.display import numbered
from evigraph.plans.scratch import materialize
from evigraph.sources.tables import Table

COUNTS = ("total_images", "reused_images", "overlay_images", "scanned_images")


class Rollups:
    """Tables ``days`` and ``numbers`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        # a key of days is a date: an upsert replaces all rows of the days that it brings
        self.days, self.numbers = Table(spark, f"{path}/days", ["checkin_date"]), Table(spark, f"{path}/numbers", ["customer_id"])
        if not self.numbers.versions():
            self.numbers.upsert(spark.createDataFrame([], "customer_id string, number long"), "begin")

    def _numbered(self, chosen: DataFrame, batch: str) -> DataFrame:
        """``chosen`` with its customers' numbers; new customers get the next ones."""
        known = self.numbers.read()
        new = materialize(chosen.where("customer_id IS NOT NULL").select("customer_id").distinct().join(known, "customer_id", "left_anti"), "customers")
        if not new.isEmpty():
            most = known.agg(F.max("number")).first()[0] or 0
            self.numbers.upsert(numbered(new, "customer_id").select("customer_id", (F.col("number") + most).cast("long").alias("number")), batch)
        return chosen.join(self.numbers.read(), "customer_id", "left")

    def put(self, chosen: DataFrame, batch: str) -> None:
        """Store the days of ``chosen`` (checkin_date, customer_id, reused, overlay, scanned), all images of each of them; undated ones are left out."""
        if batch in (self.days.manifest()["batches"]):
            return
        rows = materialize(self._numbered(chosen.where("checkin_date IS NOT NULL").select("checkin_date", "customer_id", "reused", "overlay", "scanned"), batch), "rows")
        none = F.lit(None).cast("binary")
        counts = rows.groupBy("checkin_date").agg(F.count("*").alias("total_images"), F.count_if("reused").alias("reused_images"), F.count_if("overlay").alias("overlay_images"), F.count_if("scanned").alias("scanned_images"))
        counts = counts.select("checkin_date", F.lit(-1).cast("long").alias("bucket"), *COUNTS, none.alias("customers"), none.alias("reused_customers"))
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("number"))
        reused = F.bitmap_construct_agg(F.bitmap_bit_position(F.when(F.col("reused"), F.col("number"))))
        sets = rows.where("number IS NOT NULL").groupBy("checkin_date", F.bitmap_bucket_number("number").alias("bucket")).agg(bits.alias("customers"), reused.alias("reused_customers"))
        sets = sets.select("checkin_date", "bucket", *[F.lit(0).cast("long").alias(c) for c in COUNTS], "customers", "reused_customers")
        self.days.upsert(counts.unionByName(sets), batch)

    def _period(self, first: str | None, last: str | None) -> DataFrame:
        rows = self.days.read()
        rows = rows if first is None else rows.where(F.col("checkin_date") >= first)
        return rows if last is None else rows.where(F.col("checkin_date") <= last)

    def daily(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The days of a period as :func:`evigraph.operators.reports.daily` has them."""
        size = lambda c: F.coalesce(F.sum(F.bitmap_count(c)), F.lit(0))
        out = self._period(first, last).groupBy("checkin_date").agg(*[F.sum(c).alias(c) for c in COUNTS], size("customers").alias("total_customer_ids"), size("reused_customers").alias("reused_customer_ids"))
        return out.select("checkin_date", "total_images", "reused_images", "total_customer_ids", "reused_customer_ids", "overlay_images")

    def headline(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """A period's figures as :func:`evigraph.operators.reports.headline` has them, of dated images."""
        rows = self._period(first, last)
        buckets = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS], F.bitmap_count(F.bitmap_or_agg("customers")).alias("jobs"), F.bitmap_count(F.bitmap_or_agg("reused_customers")).alias("reused"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        images, scanned = total("total_images"), total("scanned_images")
        return buckets.agg(images.alias("images_in_system"), total("reused_images").alias("reused_images"), total("overlay_images").alias("overlay_images"), scanned.alias("scanned_images"), (images - scanned).alias("pending_images"), total("jobs").alias("total_jobs"), total("reused").alias("reused_jobs"))
