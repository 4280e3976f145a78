"""A ledger of jobs over a stream of item events: which items a job has, how far each is, and whether the job still moves.

Each event stands for all levels up to its step, and the first row of each (job, item, level) is kept by a deduplication whose state the
JVM holds in RocksDB: of the items that a job has, how many got to a level, is then the number of that level's rows. Their sums by job go
to ``transformWithState``, so Python and its calls to the state see jobs, not items, and a job may have any number of items. An event
that comes again, or later than one of a further step, changes nothing, so batches may be repeated, late or out of order. A job from
which nothing came for a time (``STALE_MS``, between arrivals at the stream) and which is not done is interrupted; the next event sets it
going again. What is done or cancelled stays so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evigraph.plans.scratch import drop, materialize
from evigraph.sources.tables import Table

#: Steps of an item in turn. ``skipped`` (unusable) is as far as ``completed``.
STEPS = {"registered": 0, "embedded": 1, "completed": 2, "skipped": 2}
CANCEL = "cancel"
STALE_MS = 15 * 60 * 1000
LEDGER = "job string, total long, processed long, completed long, state string"
#: Rows of a task that are held before they are summed by job.
HELD = 1 << 20
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shown(total: Column, processed: Column, completed: Column) -> Column:
    """The larger of both counters, at most the total if there is one."""
    most = F.greatest(processed, completed)
    return F.when(total != 0, F.least(total, most)).otherwise(most)


class Jobs(StatefulProcessor):
    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "total long, processed long, completed long, cancelled boolean, stale boolean, due long")

    def _row(self, key, sums) -> pd.DataFrame:
        total, processed, completed, cancelled, stale, _ = sums
        state = "CANCELLED" if cancelled else "COMPLETED" if total and completed >= total else "INTERRUPTED" if stale else "EMBEDDING" if processed else "QUEUED"
        return pd.DataFrame({"job": [key[0]], "total": [total], "processed": [processed], "completed": [completed], "state": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, processed, completed, cancelled, _, due = self.sums.get() or (0, 0, 0, False, False, 0)
        last = 0
        for part in rows:
            last = max(last, int(part["arrived"].max().timestamp() * 1000))
            cancelled = cancelled or bool(part["cancelled"].any())
            total, processed, completed = (old + int(part[c].sum()) for old, c in ((total, "total"), (processed, "processed"), (completed, "completed")))
        if due:
            self.handle.deleteTimer(due)
        due = last + self.stale_ms
        self.handle.registerTimer(due)
        sums = (total, processed, completed, cancelled, False, due)
        self.sums.update(sums)
        yield self._row(key, sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, processed, completed, cancelled, _, _ = self.sums.get()
        sums = (total, processed, completed, cancelled, True, 0)
        self.sums.update(sums)
        yield self._row(key, sums)

    def close(self) -> None:
        pass


def first_levels(events: DataFrame) -> DataFrame:
    """(job, item, level) of ``events`` (job, item, step), each once over the whole stream: 0 is registered, 1 processed, 2 completed."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv]), F.col("step"))
    own = events.where(F.col("step").isin(*STEPS) & F.col("item").isNotNull())
    levels = own.select("job", "item", F.explode(F.sequence(F.lit(0), rank)).alias("level"), "arrived")
    return levels.dropDuplicates(["job", "item", "level"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(held)
        kinds = {c: "max" if c in ("cancelled", "arrived") else "sum" for c in own.column_names if c != "job"}
        out = own.group_by("job").aggregate(list(kinds.items())).select(["job", *[f"{c}_{k}" for c, k in kinds.items()]])
        held.clear()
        return iter(out.rename_columns(own.column_names).cast(own.schema).combine_chunks().to_batches(10_000))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield from done()
    if held:
        yield from done()


def ledger(events: DataFrame, stale_ms: int = STALE_MS) -> DataFrame:
    """(job, total, processed, completed, state), a row for each job that a batch or a timer changes; ``events`` has job, item, step.

    Null jobs are one job; steps of other names than ``STEPS`` and ``CANCEL``, and null items, are ignored. Needs the RocksDB state
    store (``PROVIDER``).
    """
    # event time is the time of arrival, so that no event is ever late, and timers wait for what arrives after them
    own = events.select(F.coalesce("job", F.lit("")).alias("job"), "item", "step", F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds")
    none, at = F.lit(0).cast("long"), lambda k: (F.col("level") == k).cast("long")
    counted = first_levels(own).select("job", at(0).alias("total"), at(1).alias("processed"), at(2).alias("completed"), F.lit(False).alias("cancelled"), "arrived")
    # every event is a sign of life, those that change nothing too
    seen = own.select("job", none.alias("total"), none.alias("processed"), none.alias("completed"), (F.coalesce("step", F.lit("")) == CANCEL).alias("cancelled"), "arrived")
    rows = counted.unionByName(seen)
    sums = rows.mapInArrow(_summed, rows.schema)
    return sums.groupBy("job").transformWithStateInPandas(statefulProcessor=Jobs(stale_ms), outputStructType=LEDGER, outputMode="Update", timeMode="EventTime")


def keep(events: DataFrame, table: Table, checkpoint: str, stale_ms: int = STALE_MS) -> StreamingQuery:
    """Write the ledger of all that has arrived to ``table`` (key job), each batch as one version."""

    def step(rows: DataFrame, number: int) -> None:
        # should a timer and events change a job in one batch, the events count
        last = F.max(F.struct((F.col("state") != "INTERRUPTED").alias("moves"), "completed", "processed", "total", "state")).alias("m")
        # the table reads its rows more than once, and each time the stream's batch would be run anew
        own = materialize(rows.groupBy("job").agg(last).select("job", "m.total", "m.processed", "m.completed", "m.state"), "ledger")
        table.upsert(own, f"batch-{number}")
        drop(own)

    return ledger(events, stale_ms).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
