"""The ledger of jobs: repeated, shuffled and late events against plain counts, cancelled and stale jobs."""

import random

import pytest

from evigraph.sources.tables import Table
from evigraph.streaming import ledger as L

SCHEMA = "job string, item string, step string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, L.PROVIDER)
    yield spark
    spark.conf.set(key, old)


def run(spark, tmp_path, batches, stale_ms=L.STALE_MS):
    source, table = str(tmp_path / "in"), Table(spark, str(tmp_path / "jobs"), ["job"], buckets=2)
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        L.keep(spark.readStream.schema(SCHEMA).parquet(source), table, str(tmp_path / "mark"), stale_ms).awaitTermination()
    return {r.job: (r.total, r.processed, r.completed, r.state) for r in table.read().collect()}


def plain(events):
    seen = {}
    for job, item, step in events:
        if step in L.STEPS and item is not None:
            own = seen.setdefault(job, {})
            own[item] = max(own.get(item, -1), L.STEPS[step])
    return {j: (len(x), sum(s > 0 for s in x.values()), sum(s > 1 for s in x.values())) for j, x in seen.items()}


def test_repeated_and_shuffled_batches_equal_plain_counts(rocks, tmp_path):
    rng = random.Random(2)
    events = [(f"j{rng.randrange(3)}", f"i{rng.randrange(25)}", rng.choice(["registered", "embedded", "completed", "skipped", "other"])) for _ in range(150)]
    parts = [events[:60], events[60:100] + events[:40], events[100:] + events[30:90]]
    for p in parts:
        rng.shuffle(p)
    got = run(rocks, tmp_path, parts)
    assert {j: x[:3] for j, x in got.items()} == plain(events)
    assert all(x[3] in ("EMBEDDING", "COMPLETED", "QUEUED") for x in got.values())


def test_done_cancelled_and_stale_jobs(rocks, tmp_path):
    first = [("done", "a", "registered"), ("done", "a", "completed"), ("cut", "a", "embedded"), ("cut", None, "cancel"), ("slow", "a", "embedded"), ("slow", "b", "registered"), (None, "a", "registered")]
    got = run(rocks, tmp_path, [first])
    assert got == {"done": (1, 1, 1, "COMPLETED"), "cut": (1, 1, 0, "CANCELLED"), "slow": (2, 1, 0, "EMBEDDING"), "": (1, 0, 0, "QUEUED")}
    # events with a short time to go stale, and a batch behind it
    got = run(rocks, tmp_path, [[("slow", "a", "embedded"), (None, "a", "registered"), ("done", "a", "embedded"), ("cut", "a", "completed")], [("other", "a", "registered")]], stale_ms=1)
    assert got == {"done": (1, 1, 1, "COMPLETED"), "cut": (1, 1, 1, "CANCELLED"), "slow": (2, 1, 0, "INTERRUPTED"), "": (1, 0, 0, "INTERRUPTED"), "other": (1, 0, 0, "QUEUED")}
    # an interrupted job goes on where it was
    got = run(rocks, tmp_path, [[("slow", "b", "completed"), ("slow", "a", "embedded")]])
    assert got["slow"] == (2, 2, 1, "EMBEDDING")


class Calls:
    """A state handle that counts what is asked of it."""

    def __init__(self):
        self.n, self.value = 0, None

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            self.value = args[0] if name == "update" else self.value
            return self if name == "getValueState" else self.value

        return call


def test_calls_to_the_state_do_not_grow_with_a_jobs_items(spark):
    items = spark.range(3000).selectExpr("'j' AS job", "cast(id AS string) AS item", "element_at(array('registered', 'embedded', 'completed'), cast(id % 3 + 1 AS int)) AS step", "timestamp'2024-01-01' AS arrived")
    levels = L.first_levels(items.unionByName(items)).selectExpr("level", "1 AS n").groupBy("level").sum("n").collect()
    assert {r[0]: r[1] for r in levels} == {0: 3000, 1: 2000, 2: 1000}
    rows = items.selectExpr("job", "1L AS total", "cast(step <> 'registered' AS long) AS processed", "cast(step = 'completed' AS long) AS completed", "false AS cancelled", "arrived")
    summed = rows.coalesce(1).mapInArrow(L._summed, rows.schema).toPandas()
    assert len(summed) == 1
    handle, jobs = Calls(), L.Jobs(1000)
    jobs.init(handle)
    for k in (1, 2):
        out = list(jobs.handleInputRows(("j",), iter([summed]), None))
        assert out[0].iloc[0].tolist() == ["j", 3000 * k, 2000 * k, 1000 * k, "EMBEDDING"]
    assert handle.n < 12
