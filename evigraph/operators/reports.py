"""Dashboard counts, roll-ups, previews and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.metadata import bangkok, boxes, day_month_year, in_range, not_after, scanned
from evigraph.sources.archive import ROOT
from evigraph.operators.groups import groups, joined_by_owner, qualified, resolved_items
from evigraph.plans.scratch import materialize

PENDING_DONE = ("COMPLETED", "CANCELLED", "FAILED")
ACTIVE_DONE = ("COMPLETED", "CANCELLED", "INTERRUPTED", "FAILED")


def endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("image_a_id", "image_b_id")).alias("id")).distinct()


def selected(items: DataFrame, pairs: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Resolved items of the period with reused, overlay and scanned flags; ``pairs`` are qualified."""
    rows = resolved_items(items).where(in_range(F.col("checkin_date"), first, last))
    reused = endpoints(pairs).withColumn("reused", F.lit(True))
    marked = rows.join(reused, "id", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    return marked.withColumn("overlay", F.size(boxes(F.col("ai_metadata_json"), "datetime")) > 0).withColumn("scanned", scanned(F.col("ai_metadata_json")))


def headline(chosen: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return chosen.agg(F.count("*").alias("images_in_system"), n(F.col("reused")).alias("reused_images"), n(F.col("overlay")).alias("overlay_images"), n(F.col("scanned")).alias("scanned_images"), n(~F.col("scanned")).alias("pending_images"), F.count_distinct("customer_id").alias("total_jobs"), F.count_distinct(F.when(F.col("reused"), F.col("customer_id"))).alias("reused_jobs"))


def daily(chosen: DataFrame) -> DataFrame:
    rows = chosen.where("checkin_date IS NOT NULL").groupBy("checkin_date")
    return rows.agg(F.count("*").alias("total_images"), F.count_if("reused").alias("reused_images"), F.count_distinct("customer_id").alias("total_customer_ids"), F.count_distinct(F.when(F.col("reused"), F.col("customer_id"))).alias("reused_customer_ids"), F.count_if("overlay").alias("overlay_images"))


def technicians(chosen: DataFrame) -> DataFrame:
    rows = chosen.where("reused AND technician_id IS NOT NULL AND customer_id IS NOT NULL")
    return rows.groupBy("technician_id").agg(F.count_distinct("customer_id").alias("reused_customer_ids")).orderBy(F.desc("reused_customer_ids"), "technician_id")


def duplicate_jobs(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each reused customer its images, reused images and pairs; a pair counts once for each customer that it touches."""
    known = chosen.where("customer_id IS NOT NULL")
    per = known.groupBy("customer_id").agg(F.count("*").alias("images_in_system"), F.count_if("reused").alias("reused_images")).where("reused_images > 0")
    sides = pairs.select("image_a_id", "image_b_id", F.explode(F.array("image_a_id", "image_b_id")).alias("id")).join(known.select("id", "customer_id"), "id")
    links = sides.select("image_a_id", "image_b_id", "customer_id").distinct().groupBy("customer_id").agg(F.count("*").alias("evidence_links"))
    return per.join(links, "customer_id", "left").select("customer_id", "images_in_system", "reused_images", F.coalesce("evidence_links", F.lit(0)).alias("evidence_links"))


def report_images(items: DataFrame, pairs: DataFrame, min_score: float, first: str | None, last: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The images of all groups that the period touches, merged by customer, as (id, group_id, customer_id, checkin_date, technician_id,
    overlay, chosen), chosen being those of the period; qualified pairs; chosen ids.

    Items are resolved and pairs qualified once. Groups are as of the period's end: pairs of later items leave before components are built.
    """
    overlay = F.size(boxes(F.col("ai_metadata_json"), "datetime")) > 0
    known = materialize(resolved_items(items).select("id", "image_quality_status", "customer_id", "checkin_date", "technician_id", overlay.alias("overlay")), "items")
    good = materialize(qualified(pairs, known, ("exact_file", "same_image", "edited_or_cropped"), min_score).select("image_a_id", "image_b_id"), "pairs")
    chosen = known.where(in_range(F.col("checkin_date"), first, last)).select("id", F.lit(True).alias("chosen"))
    early = known.where(not_after(F.col("checkin_date"), last)).select("id")
    both = good.join(early.withColumnRenamed("id", "image_a_id"), "image_a_id", "left_semi").join(early.withColumnRenamed("id", "image_b_id"), "image_b_id", "left_semi")
    grouped = materialize(groups(both), "groups")
    touched = grouped.join(chosen, "id", "left_semi").select("group_id").distinct()
    merged = joined_by_owner(grouped.join(touched, "group_id", "left_semi"), known.select("id", "customer_id"))
    rows = merged.join(known.drop("image_quality_status"), "id").join(chosen, "id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return rows, good, chosen


def export_preview(items: DataFrame, pairs: DataFrame, min_score: float, first: str | None, last: str | None) -> DataFrame:
    rows, good, chosen = report_images(items, pairs, min_score, first, last)
    other = ~F.col("chosen")
    only = lambda c, x: F.when(c, F.col(x))
    report = rows.agg(
        F.count_distinct("group_id").alias("group_count"), F.count("*").alias("report_images"), F.count_if(other).alias("cross_date_images"),
        F.count_distinct(only(F.col("chosen"), "customer_id")).alias("selected_date_customer_ids"), F.count_distinct(only(other, "customer_id")).alias("cross_date_customer_ids"),
        F.count_distinct("technician_id").alias("technician_ids"), F.count_distinct(only(other, "checkin_date")).alias("cross_dates"), F.count_if("overlay").alias("overlay_images"),
    )
    reused = endpoints(good).join(chosen, "id").agg(F.count("*").alias("selected_images"))
    return report.crossJoin(reused)


def exportable_customers(merged: DataFrame, items: DataFrame, exported: DataFrame, first: str, last: str, search: str = "") -> DataFrame:
    """Of each customer with images in the period: count, dates, the customers of its groups, and whether it was exported."""
    rows = merged.join(resolved_items(items).select("id", "customer_id", "checkin_date"), "id").where("customer_id IS NOT NULL")
    hits = rows.where(F.col("checkin_date").between(first, last) & F.col("customer_id").contains(search))
    counts = hits.groupBy("customer_id").agg(F.count("*").alias("image_count"), F.array_sort(F.collect_set("checkin_date")).alias("dates"))
    everyone = rows.select("group_id", F.col("customer_id").alias("related")).distinct()
    related = hits.select("customer_id", "group_id").distinct().join(everyone, "group_id").groupBy("customer_id").agg(F.array_sort(F.collect_set("related")).alias("related_customer_ids"))
    done = exported.select(F.col("source_job_number").alias("customer_id")).where("customer_id IS NOT NULL").distinct().withColumn("exported", F.lit(True))
    return counts.join(related, "customer_id").join(done, "customer_id", "left").withColumn("exported", F.coalesce("exported", F.lit(False)))


def technician_customers(grouped: DataFrame, items: DataFrame, first: str, last: str) -> DataFrame:
    """Customers of all grouped images of the technicians that have a grouped image in the period."""
    rows = grouped.join(resolved_items(items).select("id", "technician_id", "customer_id", "checkin_date"), "id").where("technician_id IS NOT NULL AND customer_id IS NOT NULL")
    active = rows.where(F.col("checkin_date").between(first, last)).select("technician_id").distinct()
    return rows.join(active, "technician_id", "left_semi").groupBy("technician_id").agg(F.array_sort(F.collect_set("customer_id")).alias("customers"))


def detection_rows(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Export rows: both sides' customer and shown date, the time in Bangkok, and sort keys in which nulls come first as ''."""
    own = resolved_items(items).select("id", "customer_id", "checkin_date", "job_type", "created_at")
    side = lambda s: own.select(*[F.col(c).alias(f"{c}_{s}" if c != "id" else f"image_{s}_id") for c in own.columns])
    rows = pairs.join(side("a"), "image_a_id").join(side("b"), "image_b_id")
    text = lambda c: F.coalesce(c, F.lit(""))
    low = lambda n: F.least(text(F.col(f"{n}_a")), text(F.col(f"{n}_b")))
    shown = lambda s: F.coalesce(day_month_year(F.col(f"checkin_date_{s}")), F.lit("-"))
    return rows.select("image_a_id", "image_b_id", "customer_id_a", "customer_id_b", shown("a").alias("date_a"), shown("b").alias("date_b"), F.date_format(bangkok(F.col("created_at_a")), "yyyy-MM-dd HH:mm:ss").alias("time_a"), low("checkin_date").alias("sort_date"), low("customer_id").alias("sort_customer"), low("job_type").alias("sort_job_type")).orderBy("sort_date", "sort_customer", "sort_job_type", "image_a_id", "image_b_id")


def overlay_sections(items: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """(technician_id, customer_id, images): images with an overlay box as sorted structs with the best box's confidence and corner."""
    rows = resolved_items(items).where(in_range(F.col("checkin_date"), first, last)).withColumn("found", boxes(F.col("ai_metadata_json"), "datetime")).where(F.size("found") > 0)
    # the first of the most confident boxes
    top = F.element_at(F.array_sort(F.transform("found", lambda b, i: F.struct((-b["confidence"]).alias("c"), i.alias("i"), b.alias("b")))), 1)["b"]
    best = rows.withColumn("best", top)
    image = F.struct(F.coalesce("checkin_date", F.lit("")).alias("date"), F.col("original_filename").alias("name"), F.col("best.confidence").alias("confidence"), F.col("best.x1").alias("x1"))
    return best.groupBy("technician_id", "customer_id").agg(F.array_sort(F.collect_list(image)).alias("images"))


def archive_catalogue(items: DataFrame) -> DataFrame:
    """Of each archive date its files and categories; files without one belong to the root, which sorts first."""
    root = ROOT
    cat = F.coalesce("source_category", F.lit(root))
    key = F.struct((cat != root).alias("named"), F.lower(cat).alias("low"), cat.alias("name"))
    rows = items.groupBy("source_archive_date").agg(F.count("*").alias("image_count"), F.array_sort(F.collect_set(key)).alias("c"))
    return rows.select("source_archive_date", "image_count", F.transform("c", lambda x: x["name"]).alias("categories")).orderBy(F.desc("source_archive_date"))


def archive_status(files: DataFrame, items: DataFrame) -> DataFrame:
    """``files`` (source_archive_date, image_count) with imported, analysed and pending items, what is not imported, and completeness."""
    done = F.col("analysis_status").isin("COMPLETED", "UNVERIFIABLE")
    counts = items.groupBy("source_archive_date").agg(F.count("*").alias("imported"), F.count_if(done).alias("analyzed"), F.count_if(~done).alias("pending"))
    rows = files.select("source_archive_date", "image_count").join(counts, "source_archive_date", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("source_archive_date", "image_count", z("imported").alias("imported"), z("analyzed").alias("analyzed"), z("pending").alias("pending"), F.greatest(F.lit(0), F.col("image_count") - z("imported")).alias("not_imported"), ((F.col("image_count") > 0) & (z("analyzed") >= F.col("image_count"))).alias("complete"))


def progress(total, processed, completed):
    """What is shown: the larger of both counters, at most the total if there is one."""
    most = F.greatest(processed, completed)
    return F.when(total != 0, F.least(total, most)).otherwise(most)
