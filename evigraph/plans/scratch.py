"""Tables between the steps of a job, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a new temporary one is set in local mode; on a cluster that is an error."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if (old := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            return old.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="evigraph-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batch_rows(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Queries that run meanwhile hand ``most`` rows at once to Python at most, or fewer if the session says so; None leaves it as it is.

    A batch of rows lies in memory in the executor and in its Python worker, so its size must follow the rows'.
    """
    was = spark.conf.get(BATCH_KEY)
    if most is not None and not 0 < int(was) <= most:
        spark.conf.set(BATCH_KEY, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, was)


def materialize(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and any executor can read it. ``rows``: see :func:`batch_rows`."""
    path = new_path(df.sparkSession, name)
    with batch_rows(df.sparkSession, rows):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Delete a table that :func:`materialize` made and that nothing will read again."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, most_rows: int, rows: int | None = None) -> DataFrame:
    """Mark a materialized side for broadcast if it has ``most_rows`` at most; else it stays as it is and Spark joins by shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most_rows else df


def release(spark: SparkSession) -> None:
    """Have the driver collect garbage between the rounds of a loop: Spark deletes the shuffle files of queries that nothing refers to
    any more, which else stay until the driver's heap happens to fill up. What the first pass frees may hold others."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
