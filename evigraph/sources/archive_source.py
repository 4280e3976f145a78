"""The dated archive as a data source: ``spark.read.format("dated_archive").load(root)``.

A partition is one date folder, so dates are listed in parallel, and a filter on ``archive_date`` (equal, or one of a list) leaves all other
folders unopened; a filter on ``category`` lists only these below each date. Filters reach the source where
``spark.sql.python.filterPushdown.enabled`` is set, and are applied by Spark anyway. The root may be of any file system that ``pyarrow.fs``
knows.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from evigraph.functions.metadata import IMAGE_TYPES
from evigraph.sources.archive import ROOT

SCHEMA = "path string, archive_date string, category string, name string, length long"
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


class Day(InputPartition):
    def __init__(self, date: str):
        self.date = date


def _is_date(name: str) -> bool:
    if not _DATE.fullmatch(name):
        return False
    try:
        return bool(dt.date.fromisoformat(name))
    except ValueError:
        return False


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.dates: set[str] | None = None
        self.categories: set[str] | None = None

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("archive_date",):
                self.dates = values if self.dates is None else self.dates & values
            elif values is not None and f.attribute == ("category",):
                self.categories = values if self.categories is None else self.categories & values
            yield f

    def partitions(self) -> list[Day]:
        """Folders whose names are real dates; a link in the place of a folder is none."""
        from pyarrow import fs

        system, root = self._open()
        if self.dates is not None:
            found = system.get_file_info([f"{root}/{d}" for d in sorted(self.dates) if _is_date(d)])
        else:
            found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        days = [x.base_name for x in found if x.type == fs.FileType.Directory and _is_date(x.base_name)]
        if isinstance(system, fs.LocalFileSystem):
            days = [d for d in days if not os.path.islink(f"{root}/{d}")]
        return [Day(d) for d in sorted(days)]

    def read(self, partition: Day | None) -> Iterator[tuple]:
        """Image files below a date, each once and none outside of it (links), by path without regard to case; without dates no partition is given."""
        from pyarrow import fs

        if partition is None:
            return
        system, root = self._open()
        day = f"{root}/{partition.date}"
        local = isinstance(system, fs.LocalFileSystem)
        if self.categories is None or ROOT in self.categories:
            places = [fs.FileSelector(day, recursive=self.categories is None)]
        else:
            places = []
        places += [fs.FileSelector(f"{day}/{c}", recursive=True, allow_not_found=True) for c in sorted((self.categories or set()) - {ROOT}) if c and "/" not in c and c not in (".", "..")]
        rows, seen = [], set()
        for place in places:
            for x in system.get_file_info(place):
                if x.type != fs.FileType.File or x.extension.lower() not in IMAGE_TYPES:
                    continue
                path = os.path.realpath(x.path) if local else x.path
                top = os.path.realpath(day) if local else day
                if path in seen or not path.startswith(f"{top}/"):
                    continue
                seen.add(path)
                parts = path[len(top) + 1 :].split("/")
                rows.append((path, partition.date, parts[0] if len(parts) > 1 else ROOT, parts[-1], x.size))
        yield from sorted(rows, key=lambda r: r[0].casefold())


class DatedArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dated_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DatedArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
