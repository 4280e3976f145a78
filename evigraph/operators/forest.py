"""Groups as of any date, from one minimum spanning forest.

A pair exists from the later of its items' dates on. A minimum spanning forest under these dates joins, at every date, the same items as
all pairs that exist by then: so groups as of a date are the components of the forest's edges up to it, of which there are fewer than
items, and nothing is qualified or joined anew for another date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.components import connected_components
from evigraph.operators.groups import resolved_items
from evigraph.plans.scratch import drop, materialize

MAX_ROUNDS = 60


def dated_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, w) of qualified pairs; w is the later date, and '' where neither item has one: such a pair exists at every date."""
    own = resolved_items(items).select("id", F.coalesce("checkin_date", F.lit("")).alias("d"))
    rows = pairs.select(F.col("image_a_id").alias("a"), F.col("image_b_id").alias("b"))
    for s in "ab":
        rows = rows.join(own.select(F.col("id").alias(s), F.col("d").alias(f"d{s}")), s)
    return rows.select("a", "b", F.greatest("da", "db").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Those (a, b, w) of ``edges`` that make the minimum spanning forest; of equal w the smaller (a, b) first, so there is only one.

    Borůvka: each component takes its least edge to another one, as a grouped minimum, and components that have thus met become one. The
    number of components at least halves each round, and of several edges between two components only the least goes on. Loops and
    edges with a null end are left out; of repeated edges one may be taken.
    """
    own = edges.where("a < b OR a > b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    now = materialize(own.groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")), "edges")
    forest = None
    for _ in range(MAX_ROUNDS):
        if now.isEmpty():
            break
        edge = F.struct("w", "a", "b", "x", "y").alias("e")
        least = now.select(F.explode(F.array("x", "y")).alias("c"), edge).groupBy("c").agg(F.min("e").alias("e"))
        chosen = materialize(least.select("e.*").distinct(), "chosen")
        taken = chosen.select("a", "b", "w")
        forest = taken if forest is None else forest.unionByName(taken)
        comps = materialize(connected_components(chosen, "x", "y"), "components")
        for s in "xy":
            now_s = now if s == "x" else moved
            moved = now_s.join(comps.select(F.col("node").alias(s), F.col("component").alias("to")), s).drop(s).withColumnRenamed("to", s)
        between = moved.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("w", "a", "b")).alias("m"))
        following = materialize(between.select("m.a", "m.b", "m.w", "x", "y"), "edges")
        drop(now)
        drop(comps)
        now = following
    else:
        raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
    return now.select("a", "b", "w") if forest is None else materialize(forest, "forest")


def groups_at(forest: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, id, group_id) for each of ``cutoffs`` (cutoff), a bounded list; an item is in a group from its first pair on."""
    early = forest.join(F.broadcast(cutoffs), F.col("w") <= F.col("cutoff"))
    at = lambda c: F.struct("cutoff", F.col(c).alias("id"))
    found = connected_components(early.select(at("a").alias("src"), at("b").alias("dst")))
    return found.select("node.cutoff", "node.id", F.col("component.id").alias("group_id"))
