"""Library tables that change: Parquet files written aside, and a manifest for each version that says which of them are the table.

A table is dealt into buckets by a hash of its keys. A change rewrites the buckets that it touches into a new folder; the manifest of the
next version names these and, for all others, the folders that were there. The manifest is written under another name and renamed to its
version, which fails if that version exists. So a job that breaks off leaves the table as it was, a reader keeps the version it began
with, and of two writers one has to try again. Every change carries the id of its batch; a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Table:
    """A table at ``path`` whose rows have ``keys`` once; ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        return sorted(int(m[1]) for m in map(re.compile(r"(\d+)\.json").fullmatch, names) if m)

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, buckets: {number: folder}, batches: {id: version}} of a version, the last by default."""
        there = self.versions()
        if not there:
            return {"version": 0, "schema": None, "buckets": {}, "batches": {}}
        if version is not None and version not in there:
            raise ValueError(f"no version {version} of {self.path}")
        fs, file = self._fs(f"{self.path}/versions/{there[-1] if version is None else version}.json")
        stream = fs.open(file)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; what is written later doesn't change them."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        schema = StructType.fromJson(found["schema"])
        folders = sorted(set(found["buckets"].values()))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, found: dict, numbers: list[int]) -> DataFrame:
        """The present rows of some buckets."""
        schema = StructType.fromJson(found["schema"])
        folders = [found["buckets"][str(b)] for b in numbers if str(b) in found["buckets"]]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, found: dict, rows: DataFrame, numbers: list[int], batch: str) -> int:
        """Write ``rows``, all that the buckets ``numbers`` hold from now on, and the next version's manifest."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition(min(self.buckets, max(1, len(numbers))), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, target = self._fs(f"{self.path}/{folder}")
        there = {str(s.getPath().getName()) for s in fs.listStatus(target)}
        made = {str(b): f"{folder}/_bucket={b}" for b in numbers if f"_bucket={b}" in there}
        kept = {b: f for b, f in found["buckets"].items() if int(b) not in numbers}
        version = found["version"] + 1
        schema = json.loads(rows.schema.json())
        self._publish({"version": version, "schema": schema, "buckets": kept | made, "batches": found["batches"] | {batch: version}})
        return version

    def _publish(self, manifest: dict) -> None:
        fs, aside = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        # without options the rename refuses a target that exists
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._fs(f"{self.path}/versions/{manifest['version']}.json")[1], options)
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(f"{self.path} has a version {manifest['version']} by now") from e

    def _numbers(self, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, rows: DataFrame, batch: str) -> int:
        """``rows`` (a key once) take the place of those of their keys, or are added. The version that has them."""
        found = self.manifest()
        if batch in found["batches"]:
            return found["batches"][batch]
        if found["schema"] is None:
            return self._commit(found, rows, list(range(self.buckets)), batch)
        numbers = self._numbers(rows)
        own = self._touched(found, numbers)
        kept = own.join(rows.select(*self.keys), self.keys, "left_anti")
        return self._commit(found, kept.unionByName(rows.select(*own.columns)), numbers, batch)

    def update(self, results: DataFrame, batch: str) -> int:
        """Columns of ``results`` (keys and some columns, a key once) replace those of the rows with these keys; others stay."""
        found = self.manifest()
        if batch in found["batches"]:
            return found["batches"][batch]
        numbers = self._numbers(results)
        own = self._touched(found, numbers)
        changed = [c for c in results.columns if c not in self.keys]
        new = results.select(*self.keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in changed])
        rows = own.join(new, self.keys, "left")
        taken = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in changed}
        return self._commit(found, rows.select(*[taken[c].alias(c) if c in taken else F.col(c) for c in own.columns]), numbers, batch)

    def delete(self, keys: DataFrame, batch: str) -> int:
        """Rows with one of these keys go."""
        found = self.manifest()
        if batch in found["batches"]:
            return found["batches"][batch]
        numbers = self._numbers(keys)
        own = self._touched(found, numbers)
        return self._commit(found, own.join(keys.select(*self.keys), self.keys, "left_anti"), numbers, batch)

    def restore(self, version: int, batch: str) -> int:
        """A new version with the rows of an old one; no file is written but the manifest."""
        found, old = self.manifest(), self.manifest(version)
        if batch in found["batches"]:
            return found["batches"][batch]
        number = found["version"] + 1
        self._publish(old | {"version": number, "batches": found["batches"] | {batch: number}})
        return number

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all manifests but the last ``keep``, and folders that none of these names, those of jobs that broke off included.

        No writer may be at work meanwhile. The folders that went.
        """
        there = self.versions()
        named = {f.rsplit("/", 1)[0] for v in there[-keep:] for f in self.manifest(v)["buckets"].values()}
        for v in there[:-keep]:
            fs, file = self._fs(f"{self.path}/versions/{v}.json")
            fs.delete(file, False)
        fs, folder = self._fs(f"{self.path}/data")
        gone = [f"data/{s.getPath().getName()}" for s in fs.listStatus(folder) if f"data/{s.getPath().getName()}" not in named]
        for f in gone:
            fs.delete(self._fs(f"{self.path}/{f}")[1], True)
        return gone
