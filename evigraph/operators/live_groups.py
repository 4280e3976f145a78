"""Groups that follow a growing and shrinking table of pairs without being built anew.

Labels (node, component) are kept as a table beside the pairs. New pairs are taken from nodes to the components that hold them now, which
leaves a small graph; its components tell which labels change. Pairs that go may split their components: these, and no others, are
built again from the pairs that are left in them. A component is named by its smallest node, so labels equal those of a full run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.components import connected_components
from evigraph.plans.scratch import materialize
from evigraph.sources.tables import Table


class LiveGroups:
    """Tables ``pairs`` (a, b) and ``labels`` (node, component) under ``path``; batches carry an id each, and one that comes again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string"):
        self.spark, self.kind = spark, kind
        self.pairs, self.labels = Table(spark, f"{path}/pairs", ["a", "b"]), Table(spark, f"{path}/labels", ["node"])
        if not self.pairs.versions():
            self.pairs.upsert(spark.createDataFrame([], f"a {kind}, b {kind}"), "begin")
        if not self.labels.versions():
            self.labels.upsert(spark.createDataFrame([], f"node {kind}, component {kind}"), "begin")

    def groups(self) -> DataFrame:
        return self.labels.read()

    def _clean(self, pairs: DataFrame) -> DataFrame:
        """Null endpoints and loops are no pairs; either direction is the same."""
        return materialize(pairs.where("a < b OR a > b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "batch")

    def add(self, pairs: DataFrame, batch: str) -> None:
        """Labels are written before pairs: a batch that broke off between the two writes its pairs when it comes again."""
        new = self._clean(pairs)
        if batch not in self.labels.manifest()["batches"]:
            self.labels.upsert(self.joined(new), batch)
        self.pairs.upsert(new, batch)

    def joined(self, new: DataFrame) -> DataFrame:
        """(node, component) of all nodes whose label the pairs ``new`` change or bring."""
        now = self.labels.read()
        side = lambda s: now.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
        held = materialize(new.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")), "held")
        moves = materialize(connected_components(held, "x", "y").where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("to")), "moves")
        changed = now.join(moves, "component").select("node", F.col("to").alias("component"))
        fresh = held.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(now.select("node"), "node", "left_anti")
        fresh = fresh.join(moves, fresh.node == moves.component, "left").select("node", F.coalesce("to", "node").alias("component"))
        return materialize(changed.unionByName(fresh), "labels")

    def remove(self, pairs: DataFrame, batch: str) -> None:
        """Pairs go first and labels follow, from the version before; nodes without a pair lose their label."""
        gone = self._clean(pairs)
        version = self.pairs.delete(gone, batch)
        if batch in self.labels.manifest()["batches"]:
            return
        now = self.labels.read()
        side = lambda s: gone.select(F.col(s).alias("node"))
        touched = materialize(now.join(side("a").unionByName(side("b")), "node", "left_semi").select("component").distinct(), "touched")
        members = materialize(now.join(touched, "component", "left_semi").select("node"), "members")
        left = self.pairs.read(version).join(members.withColumnRenamed("node", "a"), "a", "left_semi")
        built = materialize(connected_components(left, "a", "b"), "labels")
        lone = members.join(built.select("node"), "node", "left_anti")
        # one version: new labels, and none for nodes that stand alone now
        step = built.unionByName(lone.select("node", F.lit(None).cast(self.kind).alias("component")))
        if not step.isEmpty():
            self.labels.upsert(step.where("component IS NOT NULL"), f"{batch}:built")
        self.labels.delete(lone, batch)


def follow(groups: LiveGroups, arriving: DataFrame, checkpoint: str):
    """Add the pairs (a, b) of a stream, batch by batch, until all that is there is read."""

    def step(rows: DataFrame, number: int) -> None:
        groups.add(rows, f"stream-{number}")

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
