"""Versions of tables, broken-off and repeated jobs, and groups that follow them."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators.live_groups import LiveGroups, follow
from evigraph.sources.tables import Conflict, Table

from tests.test_components import closure

SCHEMA = "a string, b string, score double, level string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_update_delete_and_old_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "pairs"), ["a", "b"], buckets=4)
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    with pytest.raises(ValueError):
        t.read()
    assert t.upsert(make(("a", "b", 0.1, "x"), ("c", "d", 0.2, None)), "one") == 1
    old = t.read()
    assert t.upsert(make(("a", "b", 0.9, "y"), ("e", "f", 0.8, "y")), "two") == 2
    assert t.upsert(make(("z", "z", 0.0, "never")), "two") == 2
    assert rows(t.read()) == [("a", "b", 0.9, "y"), ("c", "d", 0.2, None), ("e", "f", 0.8, "y")]
    # a reader keeps its version, and old ones can be named
    assert rows(old) == rows(t.read(1)) == [("a", "b", 0.1, "x"), ("c", "d", 0.2, None)]
    assert t.update(spark.createDataFrame([("c", "d", "z"), ("no", "row", "z"), ("e", "f", None)], "a string, b string, level string"), "three") == 3
    assert rows(t.read()) == [("a", "b", 0.9, "y"), ("c", "d", 0.2, "z"), ("e", "f", 0.8, None)]
    assert t.delete(spark.createDataFrame([("a", "b"), ("e", "f")], "a string, b string"), "four") == 4
    assert rows(t.read()) == [("c", "d", 0.2, "z")]
    assert t.restore(2, "five") == 5 and rows(t.read()) == rows(t.read(2))
    assert t.manifest()["batches"] == {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
    with pytest.raises(ValueError):
        t.read(9)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ["k"], buckets=8)
    t.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("v")), "all")
    before = t.manifest()["buckets"]
    t.upsert(spark.createDataFrame([(5, 1)], "k long, v int"), "one")
    after = t.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert t.read().where("v = 1").count() == 1 and t.read().count() == 200


def test_a_job_that_breaks_off_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t"), ["k"])
    one = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    t.upsert(one, "one")
    monkeypatch.setattr(Table, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("executor and driver are gone")))
    with pytest.raises(OSError):
        t.upsert(spark.createDataFrame([(1, 9)], "k int, v int"), "two")
    monkeypatch.undo()
    assert t.versions() == [1] and rows(t.read()) == rows(one)
    assert t.upsert(spark.createDataFrame([(1, 9)], "k int, v int"), "two") == 2
    assert rows(t.read()) == [(1, 9), (2, 2)]
    # what the broken job had written goes, and what old versions hold
    assert len(t.vacuum(keep=2)) == 1 and rows(t.read(1)) == rows(one)
    t.vacuum()
    assert t.versions() == [2] and rows(t.read()) == [(1, 9), (2, 2)]


def test_of_two_writers_one_has_to_try_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a, b = Table(spark, path, ["k"]), Table(spark, path, ["k"])
    a.upsert(spark.createDataFrame([(1, 1)], "k int, v int"), "one")
    seen = b.manifest()
    a.upsert(spark.createDataFrame([(2, 2)], "k int, v int"), "two")
    monkeypatch.setattr(b, "manifest", lambda version=None: seen)
    with pytest.raises(Conflict):
        b.upsert(spark.createDataFrame([(3, 3)], "k int, v int"), "three")
    monkeypatch.undo()
    b.upsert(spark.createDataFrame([(3, 3)], "k int, v int"), "three")
    assert rows(a.read()) == [(1, 1), (2, 2), (3, 3)]


def labels(groups):
    return {r.node: r.component for r in groups.groups().collect()}


def test_groups_follow_added_and_removed_pairs(spark, tmp_path):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)})
    rng.shuffle(pairs)
    groups = LiveGroups(spark, str(tmp_path / "g"), "long")
    make = lambda p: spark.createDataFrame(p, "a long, b long")
    for n, at in enumerate(range(0, 70, 25)):
        part = pairs[at : at + 25]
        groups.add(make([*part, (None, 1), (5, 5), *[(b, a) for a, b in part[:3]]]), f"b{n}")
        groups.add(make(part), f"b{n}")
        assert labels(groups) == closure(pairs[: at + 25])
    gone = pairs[::4]
    groups.remove(make(gone), "r")
    groups.remove(make(gone), "r")
    assert labels(groups) == closure([p for p in pairs if p not in gone])
    assert {tuple(r) for r in groups.pairs.read().collect()} == set(pairs) - set(gone)


def test_a_batch_that_broke_off_between_labels_and_pairs_is_finished(spark, tmp_path, monkeypatch):
    groups = LiveGroups(spark, str(tmp_path / "g"), "long")
    batch = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    monkeypatch.setattr(groups.pairs, "upsert", lambda *a: (_ for _ in ()).throw(OSError))
    with pytest.raises(OSError):
        groups.add(batch, "x")
    monkeypatch.undo()
    groups.add(batch, "x")
    assert labels(groups) == {1: 1, 2: 1, 3: 1} and groups.pairs.read().count() == 2


def test_a_stream_of_pairs_equals_one_full_run(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema = "a string, b string"
    groups = LiveGroups(spark, str(tmp_path / "g"))
    every = []
    for part in ([("a", "b"), ("c", "d")], [("b", "c"), ("x", "y")], [("y", "a")]):
        every += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        follow(groups, spark.readStream.schema(schema).parquet(source), mark).awaitTermination()
        assert labels(groups) == closure(every)
