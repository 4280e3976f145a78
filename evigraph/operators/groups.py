"""Groups of related items: qualified pairs, components, as-of graphs and merges by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.metadata import not_after, resolved, usable
from evigraph.operators.components import connected_components
from evigraph.plans.scratch import materialize

REPORTABLE = ("exact_file", "same_image", "edited_or_cropped")
GROUPABLE = (*REPORTABLE, "background_replaced", "similar_person", "same_scene_new_capture", "repeated_checkin")


def resolved_items(items: DataFrame) -> DataFrame:
    """``items`` with customer_id, checkin_date, technician_id and job_type."""
    return items.select("*", *[c.alias(n) for n, c in resolved().items()])


def qualified(pairs: DataFrame, items: DataFrame, classes: tuple[str, ...], min_score: float) -> DataFrame:
    """Pairs of the classes with the score, both of whose items exist and are usable."""
    ok = items.where(usable(F.col("image_quality_status"))).select("id")
    kept = pairs.where(F.col("relationship_level").isin(*classes) & (F.col("relationship_score") >= min_score))
    return kept.join(ok.withColumnRenamed("id", "image_a_id"), "image_a_id", "left_semi").join(ok.withColumnRenamed("id", "image_b_id"), "image_b_id", "left_semi")


def groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id) of all items of qualified pairs; the group is its smallest id."""
    return connected_components(pairs, "image_a_id", "image_b_id").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def reportable_groups(items: DataFrame, pairs: DataFrame, min_score: float, classes: tuple[str, ...] = REPORTABLE) -> DataFrame:
    return materialize(groups(qualified(pairs, items, classes, min_score)), "groups")


def as_of_groups(items: DataFrame, pairs: DataFrame, min_score: float, cutoff: str | None) -> DataFrame:
    """Items after the cutoff leave before components are built, so that they cannot bridge; undated ones stay."""
    early = resolved_items(items).where(not_after(F.col("checkin_date"), cutoff))
    return reportable_groups(early, pairs, min_score)


def merged_by_customer(grouped: DataFrame, items: DataFrame) -> DataFrame:
    """(id, group_id) after groups that share a customer are joined, by one edge from each group to the customer's first."""
    return joined_by_owner(grouped, resolved_items(items).select("id", "customer_id"))


def joined_by_owner(grouped: DataFrame, owner: DataFrame) -> DataFrame:
    """As :func:`merged_by_customer`, with each item's customer given as ``owner`` (id, customer_id)."""
    owners = grouped.join(owner, "id").where("customer_id IS NOT NULL").select("group_id", "customer_id").distinct()
    first = owners.groupBy("customer_id").agg(F.min("group_id").alias("first"))
    merged = connected_components(owners.join(first, "customer_id").select(F.col("group_id").alias("src"), F.col("first").alias("dst")))
    joined = grouped.join(merged.withColumnRenamed("node", "group_id"), "group_id", "left")
    return materialize(joined.select("id", F.coalesce("component", "group_id").alias("group_id")), "groups")


def with_relations(grouped: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group_id, image_a_id, image_b_id, ...) of pairs both of whose items are in one group."""
    a = grouped.select(F.col("id").alias("image_a_id"), "group_id")
    b = grouped.select(F.col("id").alias("image_b_id"), F.col("group_id").alias("group_b"))
    return pairs.join(a, "image_a_id").join(b, "image_b_id").where("group_id = group_b").drop("group_b")


def detail(grouped: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group_id, size, relationship_count, customers, technicians, members): a row for each group."""
    rows = grouped.join(resolved_items(items).select("id", "customer_id", "technician_id"), "id")
    own = rows.groupBy("group_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("customer_id")).alias("customers"), F.array_sort(F.collect_set("technician_id")).alias("technicians"), F.array_sort(F.collect_list("id")).alias("members"))
    links = with_relations(grouped, pairs).groupBy("group_id").agg(F.count("*").alias("relationship_count"))
    return own.join(links, "group_id", "left").withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))
