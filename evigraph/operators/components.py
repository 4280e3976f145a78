"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evigraph.plans.scratch import drop, materialize

MAX_ROUNDS = 60


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table as it is written, and its count and checksum, which the write itself observes."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each endpoint of ``edges``; the component is its smallest node.

    Self-loops count as nodes of their own. Rows with a null endpoint are ignored; repeated edges and either direction are the
    same. Each round is a few grouped minima and joins: a hub's edges meet as partial minima, and no neighbour list is built. The
    number of rounds grows with the logarithm of the longest chain.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = both.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now, state = _written(both.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, last = state, now
        now, state = _written(moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        drop(last)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(loops)
    return named.groupBy("node").agg(F.min("component").alias("component"))
