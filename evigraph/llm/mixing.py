"""Mixing sources to target weights on a low-discrepancy schedule.

Every source's documents stand in a shuffled order (by MD5 of seed and doc_id) and are cut, with the order repeated, into blocks of
``BLOCK`` words. A schedule of slots takes the points ``i * golden ratio mod 1``, in whole numbers modulo 2**40, through the
cumulative targets; the r-th slot of a source takes its block r. A source uses as many slots as its target needs, the last in part;
the few that the schedule's first M points leave short (their discrepancy grows with log M) follow at its end.

Running totals never need a source in one task: words are summed by source and hash bucket, buckets are summed up, and documents
only within a bucket; slots likewise by runs of ``RUN``. The tables of sources are joined by broadcast while they are small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.plans.scratch import materialize, small_side

BLOCK = 256
CAP = 3
SEED = "mix-1"
RUN = 1 << 16
UNIT_BITS = 40
#: The golden ratio's fraction in units of 2**-40; odd, so that points repeat after 2**40 slots only.
STEP = 679_559_893_309
MAX_SOURCES = 100_000
WORD = "[^ \\t-\\r]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, sid, target) from (source, source_size): shares by weight 1, 2, 3 in turn, filled up to the caps.

    With sources in the order of cap / weight, all before some place are capped and the rest get the same multiple of their weight.
    One row for each source; windows here run over sources only.
    """
    by_name = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = by_name.select("*", (F.pmod(F.col("sid") - 1, F.lit(3)) + 1).alias("weight"), (CAP * F.col("source_size")).alias("cap"))
    every = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "sid")
    total = F.sum("source_size").over(every)
    capped = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("level", (total - capped) / left).withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    final = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "sid", "level"))).over(every)["level"]
    return level.select("source", "source_size", "sid", F.when(F.col("free"), final * F.col("weight")).otherwise(F.col("cap")).cast("double").alias("target"))


def _placed(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their first word's place in the source's order, and the sources."""
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("ord")), "sized")
    sources = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    n = sized.count()
    width = max(2, math.ceil(math.log(max(n, 1) / 50_000 + 1, 16)))
    small = small_side(sources.withColumnRenamed("source", "name"), MAX_SOURCES)
    known = sized.join(small, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", F.substring("ord", 1, width))
    buckets = known.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(buckets.select("sid", "bucket", ahead.alias("ahead")), "buckets")
    inner = Window.partitionBy("sid", "bucket").orderBy("ord", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = known.select("*", F.row_number().over(inner).alias("rn"), before.alias("before")).join(small_side(offsets, MAX_SOURCES), ["sid", "bucket"])
    return at.select("doc_id", "source", "size", "source_size", "target", "sid", "bucket", "rn", (F.col("ahead") + F.col("before")).alias("start")), sources


def slots(sources: DataFrame, block: int) -> DataFrame:
    """(slot, sid, rank): a slot for each block that a source's target needs."""
    need = sources.select("sid", "target", F.ceil(F.floor("target") / block).cast("long").alias("need"))
    m, count, total = need.agg(F.sum("need"), F.count("*"), F.sum("target")).first()
    unit = 1 << UNIT_BITS
    cells = 4 << max(0, (count or 1) - 1).bit_length()
    width = unit // cells
    upto = F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("sid"))
    ends = need.select("*", F.floor(upto / (total or 1) * unit).cast("long").alias("end"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("sid"))).alias("back"))
    ends = ends.withColumn("end", F.when(F.col("back") == 1, F.lit(unit)).otherwise(F.col("end"))).drop("back")
    begin = F.coalesce(F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("sid")), F.lit(0))
    spans = ends.withColumn("begin", begin).where("end > begin AND need > 0")
    guide = spans.select("sid", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))).alias("cell"))
    guide = materialize(guide, "guide")
    low = 1 << 20
    point = (F.pmod("slot", F.lit(low)) * STEP + F.shiftright("slot", 20) * (STEP * low % unit)) % unit
    points = sources.sparkSession.range(m or 0).select(F.col("id").alias("slot")).select("slot", point.alias("u"))
    drawn = points.withColumn("cell", F.floor(F.col("u") / width)).join(small_side(guide, 8 * MAX_SOURCES), "cell").where("u >= begin AND u < end").select("slot", "sid", F.floor(F.col("slot") / RUN).alias("run"))
    per_run = drawn.groupBy("sid", "run").agg(F.count("*").alias("n"))
    runs = materialize(per_run.select("*", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")), "runs")
    ranked = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot"))).join(small_side(runs.select("sid", "run", "ahead"), MAX_SOURCES), ["sid", "run"])
    needed = small_side(need.select("sid", "need"), MAX_SOURCES, count)
    scheduled = ranked.select("slot", "sid", (F.col("ahead") + F.col("rn") - 1).alias("rank")).join(needed, "sid").where("rank < need").select("slot", "sid", "rank")
    got = need.join(runs.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").select("sid", "need", F.coalesce("got", F.lit(0)).alias("got"))
    prior = F.coalesce(F.sum(F.greatest(F.col("need") - F.col("got"), F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = got.withColumn("prior", prior).where("got < need")
    tail = short.select("sid", (F.lit(m or 0) + F.col("prior") - F.col("got")).alias("shift"), F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return scheduled.unionByName(tail.select((F.col("shift") + F.col("rank")).alias("slot"), "sid", "rank"))


def pieces(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The mix in order of ``slot``, ``at``: words ``first`` to ``last`` (from 0, exclusive) of a document stand there.

    A row for every document (doc_id, source, size, source_size, target, sid, bucket, rn) and slot; a document that the mix leaves
    out has one row with null slot, at, first and last.
    """
    placed, sources = _placed(docs, seed)
    sources = materialize(sources, "sources")
    stop = F.floor("target")
    epochs = placed.withColumn("begin", F.explode(F.transform(F.sequence(F.lit(0), F.lit(CAP - 1)), lambda e: F.col("start") + e * F.col("source_size"))))
    used = epochs.withColumn("end", F.least(F.col("begin") + F.col("size"), stop)).where("end > begin")
    cut = used.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    taken = cut.join(slots(sources, block), ["sid", "rank"])
    own = ["doc_id", "source", "size", "source_size", "target", "sid", "bucket", "rn"]
    first, last = F.greatest(F.col("begin"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    rows = taken.select(*own, "slot", (first - F.col("rank") * block).alias("at"), (first - F.col("begin")).alias("first"), (last - F.col("begin")).alias("last"))
    none = F.lit(None).cast("long")
    idle = placed.where(F.col("size").isin(0) | (F.col("start") >= stop))
    return rows.unionByName(idle.select(*own, none.alias("slot"), none.alias("at"), none.alias("first"), none.alias("last")))


def mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, n_pieces): a row for each row of ``docs`` (doc_id, text, source).

    The words taken are those of the row's ``n_pieces`` pieces in the schedule, the first in ``first_slot`` (null: none).
    A null or blank text has size 0 and is never taken; a null source is one source, last in the order; a null doc_id takes its place by
    the hash of the empty text. Documents with equal ids and sizes may exchange their places. The result depends on the rows only,
    not on their order or partitions. No words at all give targets of 0. Extra columns are not read.
    """
    parts = pieces(docs, block, seed)
    summed = parts.groupBy("sid", "bucket", "rn").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")], F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_pieces"))
    return summed.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_pieces")
