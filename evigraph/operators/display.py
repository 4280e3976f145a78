"""What screens and sheets show: report rows, period matches, lookups, numbering, chart points, totals and detection sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.evidence import verdict
from evigraph.functions.metadata import day_month_year, in_range
from evigraph.operators.groups import resolved_items
from evigraph.plans.scratch import materialize

RESUMABLE = ("CANCELLED", "INTERRUPTED", "FAILED")


def matching_groups(grouped: DataFrame, items: DataFrame, first: str, last: str, customers: DataFrame | None = None) -> DataFrame:
    """(group_id) of groups that have an image of the period and, if ``customers`` (customer_id) is given, of one of them."""
    rows = grouped.join(resolved_items(items).select("id", "customer_id", "checkin_date"), "id").where(in_range(F.col("checkin_date"), first, last))
    rows = rows if customers is None else rows.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    return rows.select("group_id").distinct()


def report_row(grouped: DataFrame, items: DataFrame, report_id: str, first: str, last: str) -> DataFrame:
    """The row of a report over ``grouped``: its number of groups and images, and the first and last date that they really have."""
    rows = grouped.join(resolved_items(items).select("id", "checkin_date"), "id")
    return rows.agg(F.lit(report_id).alias("export_report_id"), F.coalesce(F.min("checkin_date"), F.lit(first)).alias("date_from"), F.coalesce(F.max("checkin_date"), F.lit(last)).alias("date_to"), F.count_distinct("group_id").alias("group_count"), F.count("*").alias("image_count"))


def lookup(grouped: DataFrame, items: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (customer_id, asked_id, previous_id) with group_id: the first group of the customer, else the asked one if it
    exists, else the previous one if it does, else the first of all; null without groups."""
    owners = grouped.join(resolved_items(items).select("id", "customer_id"), "id").where("customer_id IS NOT NULL").groupBy("customer_id").agg(F.min("group_id").alias("own"))
    ids = grouped.select("group_id").distinct()
    rows = requests.join(owners, "customer_id", "left")
    for c in ("asked", "previous"):
        rows = rows.join(ids.select(F.col("group_id").alias(f"{c}_id"), F.col("group_id").alias(c)), f"{c}_id", "left")
    first = ids.agg(F.min("group_id").alias("first"))
    return rows.crossJoin(F.broadcast(first)).select(*requests.columns, F.coalesce("own", "asked", "previous", "first").alias("group_id"))


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with number, from 1 in the order of ``keys``: places within ranges of the keys, and the sizes of the ranges before.

    Only one count for each range comes to one place, so that no task sorts all rows. Keys must be unique for a stable result.
    """
    dealt = materialize(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    ahead = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return dealt.withColumn("_place", place).join(F.broadcast(ahead), "_range").withColumn("number", F.col("_ahead") + F.col("_place")).drop("_range", "_ahead", "_place")


def last_points(daily: DataFrame, value: str, n: int = 14) -> DataFrame:
    """The ``n`` last days of a roll-up; the number of points is what the chart shows."""
    return daily.orderBy(F.desc("checkin_date")).limit(n).select(F.lit("daily").alias("chart"), F.col("checkin_date").alias("label"), F.col(value).alias("value"))


def top_bars(ranking: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` first technicians of a ranking; the number of bars is what the chart shows."""
    return ranking.orderBy(F.desc("reused_customer_ids"), "technician_id").limit(n).select(F.lit("technician").alias("chart"), F.col("technician_id").alias("label"), F.col("reused_customer_ids").alias("value"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up, at most 100; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100), F.floor(100 * part / whole + F.lit(0.5)))).otherwise(F.lit(0)).cast("long")


def totals(status: DataFrame, manual_total: int = 0) -> DataFrame:
    """Sums over archive dates with the share that is analysed, what is left to analyse, and the total that charts divide by."""
    sums = status.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("image_count", "images"), ("analyzed", "analyzed"), ("pending", "pending"), ("not_imported", "not_imported"))])
    return sums.select("*", percent(F.col("analyzed"), F.col("images")).alias("percent"), F.greatest(F.lit(0), F.col("images") - F.col("pending")).alias("analyzed_card"), F.greatest(F.lit(manual_total), F.col("images")).alias("safe_total"))


def resumable(jobs: DataFrame, owner: str) -> DataFrame:
    """Of each owner the newest job that ended early and has items left; ``jobs`` has status, processed, total, created_at and job_id."""
    rows = jobs.where(F.col("status").isin(*RESUMABLE) & (F.col("processed") < F.col("total")))
    return rows.groupBy(owner).agg(F.max(F.struct("created_at", "job_id", "status")).alias("m")).select(owner, "m.job_id", "m.status")


def first_place_last_value(records: DataFrame, key: str, place: str, *values: str) -> DataFrame:
    """A row for each key: the place of its first record and the values of its last one."""
    return records.groupBy(key).agg(F.min(place).alias("position"), F.max(F.struct(place, *values)).alias("m")).select(key, "position", *[f"m.{v}" for v in values])


def embedded(job_items: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(job_id, embedded): how many different images of each job (job_id, image_id) have a vector in ``embeddings`` (image_id)."""
    return job_items.join(embeddings.select("image_id").distinct(), "image_id").groupBy("job_id").agg(F.count_distinct("image_id").alias("embedded"))


#: Columns of the detection sheet in their order.
SHEET = ("checked_at", "detect_category", "detect_sub_category", "image_a_technician_id", "image_b_technician_id", "image_a_customer_id", "image_b_customer_id", "image_a_filename", "image_a_captured_at", "image_a_job_type", "image_b_filename", "image_b_captured_at", "image_b_job_type")


def detection_sheet(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (with checked_at) as text with blanks for nulls, by the lesser date, customer and job type, then the time."""
    own = resolved_items(items).select("id", "customer_id", "checkin_date", "technician_id", "job_type", "original_filename")
    side = lambda s: own.select(*[F.col(c).alias(f"{s}_{c}" if c != "id" else f"image_{s}_id") for c in own.columns])
    rows = pairs.join(side("a"), "image_a_id").join(side("b"), "image_b_id")
    text = lambda c: F.coalesce(c, F.lit(""))
    low = lambda n: F.least(text(F.col(f"a_{n}")), text(F.col(f"b_{n}")))
    time = F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss")
    shown = {"checked_at": time, "detect_category": verdict(F.col("relationship_level")), "detect_sub_category": F.col("relationship_level")}
    for s in ("a", "b"):
        shown |= {f"image_{s}_technician_id": F.col(f"{s}_technician_id"), f"image_{s}_customer_id": F.col(f"{s}_customer_id"), f"image_{s}_filename": F.col(f"{s}_original_filename"), f"image_{s}_captured_at": day_month_year(F.col(f"{s}_checkin_date")), f"image_{s}_job_type": F.col(f"{s}_job_type")}
    ordered = rows.orderBy(low("checkin_date"), low("customer_id"), low("job_type"), text(time), "image_a_id", "image_b_id")
    return ordered.select(*[text(shown[c]).alias(c) for c in SHEET])
