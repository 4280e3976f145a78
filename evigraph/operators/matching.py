"""Mutual matches of descriptors as joins: which points of two images are each other's nearest and clearly nearer than the next.

A descriptor is a row (image, point, vector). The descriptors of the images of a pair meet by joins on the image, so that no image is one
row or one call; the two least distances of a point are kept by a window that Spark limits before the shuffle. A pair's work is split
among its points, and the points of an image that is in many pairs among the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 0.75


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def _clear(met: DataFrame, point: str, ratio: float) -> DataFrame:
    """(a, b, pa, pb) of each point's nearest, if it is nearer than ``ratio`` times the next; a point with one neighbour only has no next and is out."""
    near = Window.partitionBy("a", "b", point).orderBy("d", "pb" if point == "pa" else "pa")
    two = met.withColumn("nth", F.row_number().over(near)).where("nth <= 2")
    best = two.groupBy("a", "b", point).agg(F.min_by(F.struct("pa", "pb"), "nth").alias("m"), F.min("d").alias("near"), F.max("d").alias("far"), F.count("*").alias("n"))
    return best.where((F.col("n") == 2) & (F.col("near") < ratio * ratio * F.col("far"))).select("a", "b", "m.pa", "m.pb", "near")


def mutual_matches(pairs: DataFrame, descriptors: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(a, b, pa, pb, distance): matches of each of ``pairs`` (a, b), by ``descriptors`` (image, point, vector).

    A match is the nearest of both its points and passes the ratio test on both sides. Images without descriptors have none; of points
    equally near the smaller number is the nearest (such a tie fails the test unless the distance is 0, which is never less than 0).
    """
    side = lambda i, p, v: descriptors.select(F.col("image").alias(i), F.col("point").alias(p), F.col("vector").alias(v))
    own = pairs.select("a", "b").distinct()
    met = own.join(side("a", "pa", "va"), "a").join(side("b", "pb", "vb"), "b").select("a", "b", "pa", "pb", squared_distance(F.col("va"), F.col("vb")).alias("d"))
    both = _clear(met, "pa", ratio).join(_clear(met, "pb", ratio).drop("near"), ["a", "b", "pa", "pb"])
    return both.select("a", "b", "pa", "pb", F.sqrt("near").alias("distance"))


def match_counts(pairs: DataFrame, descriptors: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(a, b, matches, reference) of each pair: its mutual matches, and the points of the image that has fewer."""
    n = descriptors.groupBy("image").agg(F.count("*").alias("n"))
    found = mutual_matches(pairs, descriptors, ratio).groupBy("a", "b").agg(F.count("*").alias("matches"))
    rows = pairs.select("a", "b").distinct().join(found, ["a", "b"], "left")
    for s in "ab":
        rows = rows.join(n.select(F.col("image").alias(s), F.col("n").alias(f"n{s}")), s, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("a", "b", zero("matches").alias("matches"), F.least(zero("na"), zero("nb")).alias("reference"))
