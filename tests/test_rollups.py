"""Stored roll-ups against plain counts, and mutual matches against NumPy."""

import numpy as np
import pytest

from evigraph.operators import matching as X
from evigraph.operators.rollups import Rollups

CHOSEN = "checkin_date string, customer_id string, reused boolean, overlay boolean, scanned boolean"


def plain(rows, first, last):
    rows = [r for r in rows if r[0] is not None and first <= r[0] <= last]
    customers = lambda rs: len({r[1] for r in rs if r[1] is not None})
    reused = [r for r in rows if r[2]]
    return (len(rows), len(reused), sum(r[3] for r in rows), sum(r[4] for r in rows), sum(not r[4] for r in rows), customers(rows), customers(reused))


def test_periods_and_late_days(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(None if i % 29 == 0 else f"199601{i % 9 + 1:02d}", None if i % 13 == 0 else f"c{rng.integers(40)}", bool(i % 3 == 0), bool(i % 5 == 0), bool(i % 2)) for i in range(300)]
    rollups = Rollups(spark, str(tmp_path / "r"))
    early = [r for k, r in enumerate(rows) if r[0] is not None and (r[0] < "19960106" or k % 2)]
    rollups.put(spark.createDataFrame(early, CHOSEN), "early")
    late = spark.createDataFrame([r for r in rows if r[0] is None or r[0] >= "19960106"], CHOSEN)
    for _ in range(2):
        rollups.put(late, "late")
    for first, last in (("19960101", "19960131"), ("19960103", "19960107"), ("19970101", "19970102")):
        assert tuple(rollups.headline(first, last).first()) == plain(rows, first, last)
    days = {r.checkin_date: tuple(r)[1:] for r in rollups.daily().collect()}
    for d, got in days.items():
        n, reused, overlay, _, _, customers, reused_customers = plain(rows, d, d)
        assert got == (n, reused, customers, reused_customers, overlay)
    assert len(days) == 9


@pytest.mark.parametrize("ratio", [0.75, 0.95])
def test_mutual_matches_equal_plain_ones(spark, ratio):
    rng = np.random.default_rng(4)
    vectors = {"a": rng.normal(size=(20, 4)), "d": rng.normal(size=(1, 4))}
    vectors["b"] = vectors["a"][::-1] + rng.normal(size=(20, 4)) * 0.2
    vectors["c"] = rng.normal(size=(15, 4))
    rows = [(i, k, v.tolist()) for i, m in vectors.items() for k, v in enumerate(m)]
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("a", "none"), ("a", "b")]
    got = X.mutual_matches(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(rows, "image string, point int, vector array<double>"), ratio).collect()
    expected = set()
    for a, b in set(pairs):
        if a in vectors and b in vectors:
            d = np.linalg.norm(vectors[a][:, None] - vectors[b][None], axis=2)
            clear = lambda m: {i: int(r.argmin()) for i, r in enumerate(m) if len(r) > 1 and np.sort(r)[0] < ratio * np.sort(r)[1]}
            back = clear(d.T)
            expected |= {(a, b, i, j) for i, j in clear(d).items() if back.get(j) == i}
    assert {tuple(r)[:4] for r in got} == expected and any(p[:2] == ("a", "b") for p in expected)
    counts = X.match_counts(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(rows, "image string, point int, vector array<double>"), ratio)
    own = {(r.a, r.b): (r.matches, r.reference) for r in counts.collect()}
    assert own["a", "none"] == (0, 0) and own["a", "d"] == (0, 1) and own["a", "b"] == (sum(p[:2] == ("a", "b") for p in expected), 20)
