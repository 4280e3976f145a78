"""The archive as a data source: dates, links, suffixes, order, and what filters leave unopened."""

import os

from evigraph.sources import archive_source as A
from evigraph.sources.archive import ROOT


def make(root):
    for path in ("2026-08-13/cat/a.png", "2026-08-13/cat/deep/B.JPG", "2026-08-13/b.jpeg", "2026-08-14/dog/c.webp", "2026-08-14/dog/n.txt", "2026-13-45/x/d.png", "other/x/e.png", "outside.png"):
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"xy")
    os.symlink(root / "outside.png", root / "2026-08-14/dog/link.png")
    os.symlink(root / "2026-08-13/b.jpeg", root / "2026-08-13/cat/again.jpeg")
    os.symlink(root / "2026-08-13", root / "2026-08-15")


def test_files_of_real_dates(spark, tmp_path):
    make(tmp_path)
    A.register(spark)
    df = spark.read.format("dated_archive").load(str(tmp_path))
    every = {("2026-08-13", "cat", "a.png", 2), ("2026-08-13", "cat", "B.JPG", 2), ("2026-08-13", ROOT, "b.jpeg", 2), ("2026-08-14", "dog", "c.webp", 2)}
    assert {tuple(r)[1:] for r in df.collect()} == every and df.count() == 4
    assert {r.name for r in df.where("archive_date = '2026-08-13' AND category IN ('cat', 'bird')").collect()} == {"a.png", "B.JPG"}
    assert {r.name for r in df.where(f"category = '{ROOT}'").collect()} == {"b.jpeg"}
    assert df.where("archive_date = '2026-08-15'").count() == 0 == df.where("archive_date = '../x'").count()
    assert {r.name for r in spark.read.format("dated_archive").load(f"file://{tmp_path}").collect()} == {x[2] for x in every}


def test_filters_leave_other_folders_unopened(tmp_path):
    make(tmp_path)
    reader = A.Reader(str(tmp_path))
    assert [p.date for p in reader.partitions()] == ["2026-08-13", "2026-08-14"]
    assert len(list(reader.pushFilters([A.EqualTo(("archive_date",), "2026-08-14"), A.In(("category",), ("dog",))]))) == 2
    os.rename(tmp_path / "2026-08-13", tmp_path / "gone")
    assert [p.date for p in reader.partitions()] == ["2026-08-14"]
    assert [r[3] for r in reader.read(A.Day("2026-08-14"))] == ["c.webp"]


def test_order_is_without_case(tmp_path):
    day = tmp_path / "2026-01-02"
    day.mkdir()
    for n in ("b.png", "C.png", "a.png", "B2.png"):
        (day / n).write_bytes(b"")
    assert [r[3] for r in A.Reader(str(tmp_path)).read(A.Day("2026-01-02"))] == ["a.png", "b.png", "B2.png", "C.png"]
