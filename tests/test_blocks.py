"""Near fingerprints and nearest vectors against all pairs in plain NumPy; which blocks meet; stored rotations."""

import numpy as np
import pytest

from evigraph.operators import blocks as B
from evigraph.operators import candidates as C
from evigraph.operators import prints as P

PRINTS = "vec_id long, angle int, hi long, lo long"


def clustered_bits(rng, centres, each, flips):
    base = rng.integers(0, 2**63, centres, dtype=np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, centres).astype(np.uint64)
    out = []
    for b in base:
        for _ in range(each):
            mask = sum(1 << int(k) for k in rng.choice(64, rng.integers(0, flips + 1), replace=False))
            out.append(int(b) ^ mask)
    return out


def prints(spark, values, angles=(0,)):
    return spark.createDataFrame([(i, a, v >> 32, v & 0xFFFFFFFF) for i, (v, a) in enumerate((v, angles[k % len(angles)]) for k, v in enumerate(values))], PRINTS)


def plain_pairs(rows, radius):
    best = {}
    for a, x, hx, lx in rows:
        for b, y, hy, ly in rows:
            d = ((hx ^ hy).bit_count()) + ((lx ^ ly).bit_count())
            if a < b and d <= radius:
                best[a, b] = min(best.get((a, b), (99, 0, 0)), (d, x, y))
    return {(a, b, *m) for (a, b), m in best.items()}


@pytest.mark.parametrize("radius,per", [(18, 16), (18, 10_000), (10, None), (3, None), (1, None)])
def test_near_prints_equal_all_pairs(spark, radius, per):
    rng = np.random.default_rng(radius)
    values = clustered_bits(rng, 12, 14, 14) + [0] * 5 + [2**64 - 1] * 3 + [1, 2**63]
    df = prints(spark, values).unionByName(prints(spark, values[::-1]).selectExpr("vec_id", "90 AS angle", "hi", "lo"))
    rows = [tuple(r) for r in df.collect()]
    assert {tuple(r) for r in C.hamming_pairs(df, radius, per=per).collect()} == plain_pairs(rows, radius)
    flat = [r for r in rows if r[1] == 0]
    assert {tuple(r)[:3] for r in C.hamming_pairs(df, radius, rotations=False, per=per).collect()} == {p[:3] for p in plain_pairs(flat, radius)}


def test_crowded_parts_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "CROWDED", 10)
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 1 << 20, 120)] + clustered_bits(rng, 5, 8, 6)
    df = prints(spark, values)
    assert {tuple(r) for r in C.hamming_pairs(df, 6).collect()} == plain_pairs([tuple(r) for r in df.collect()], 6)


def test_part_radii_leave_no_pair_out():
    for radius in range(12):
        t = C.part_radii(radius)
        assert sum(x + 1 for x in t) == radius + 1 and max(t) - min(t) <= 1


def plain_topk(rows, k):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    sims = np.round(v @ v.T, 9)
    return {(int(ids[q]), int(ids[m]), rank) for q in range(len(ids)) for rank, m in enumerate(sorted(range(len(ids)), key=lambda m: (-sims[q, m], ids[m]))[:k], 1)}


@pytest.mark.parametrize("k,per", [(3, 8), (5, 4096), (1, 3)])
def test_nearest_vectors_equal_all_pairs(spark, k, per):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.05).tolist()) for i in range(70)]
    rows += [(100 + i, rows[3][1]) for i in range(9)] + [(200, [0.0] * 5), (201, [0.0] * 5)]
    df = spark.createDataFrame([*rows, (300, None), (301, [])], "vec_id long, embedding array<double>").repartition(3)
    got = C.topk_cosine(df, k, per=per).collect()
    assert {(r.query, r["match"], r["rank"]) for r in got} == plain_topk(rows, k)
    assert len(got) == k * len(rows)
    assert C.topk_cosine(df.where("vec_id > 299"), k).collect() == []


def test_far_blocks_do_not_meet(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 5
    v = (centres[np.arange(1200) % 40] + rng.normal(size=(1200, 16)) * 0.02).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    _, met = B.nearest(C.unit_vectors(df, "vec_id", "embedding"), 16, 5, per=20)
    n = met.select("i").distinct().count()
    assert met.count() < 0.3 * n * n
    bits = clustered_bits(rng, 40, 30, 3)
    values = spark.createDataFrame([(int(np.uint64(b).astype(np.int64)),) for b in set(bits)], "bits long")
    rows = values.selectExpr("bits AS key", "unhex(lpad(hex(bits), 16, '0')) AS data")
    packed = B.packed(rows, B.Hamming, 20)
    n = packed.count()
    # blocks of one centre only, and those at the border between two
    assert B.partners(packed, B.Hamming, 10, ordered=False).count() < 0.6 * n * (n + 1) / 2


def test_equal_values_grow_with_their_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<double>")
    got = C.topk_cosine(same, 4).collect()
    assert len(got) == 1600 and {r["match"] for r in got} == {0, 1, 2, 3}


def test_turned_vectors_are_stored_rows(spark):
    hits = spark.createDataFrame([("a", "b", 3, 0, 90), ("a", "c", 4, 90, 90), ("a", "d", 5, 0, 180), ("b", "d", 6, 0, 0)], "a string, b string, distance int, angle_a int, angle_b int")
    stored = [("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("c", 0, [0.0, 1.0]), ("d", 0, [0.0, 1.0]), ("b", 90, [1.0, 0.1]), ("c", 90, [1.0, 0.0]), ("a", 90, [1.0, 0.0])]
    vectors = spark.createDataFrame(stored, "id string, angle int, vector array<double>")
    got = {(r.a, r.b): r.source for r in C.aligned_cosine(hits, vectors, 0.5).collect()}
    # a-c has equal angles, so turned vectors are not asked for; the vector of d at 180 is not stored
    assert got == {("a", "b"): "phash_and_rotated", ("b", "d"): "phash_and_base"}
    unlike = hits.where("NOT (a = 'b')")
    assert {tuple(r) for r in C.missing_rotations(unlike, vectors).collect()} == {("d", 180)}


def test_blocks_are_sent_once_for_each_strip(spark, monkeypatch):
    """A block that meets many goes to the tasks of the strips that it meets, not to one row for each pair."""
    sent = []
    monkeypatch.setattr(B, "STRIPS", 2)
    kind = type(spark.range(0))
    plain = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, n, c: sent.append((self, n)) or plain(self, n, c))
    rng = np.random.default_rng(3)
    values = spark.createDataFrame([(int(v),) for v in rng.integers(-(2**63), 2**63, 300)], "bits long")
    got = B.near_values(values, 18, per=10).count()
    bits = np.array([r.bits for r in values.collect()]).astype(np.uint64)
    assert got == (np.triu(np.bitwise_count(bits[:, None] ^ bits[None]), 1) + 65 * np.tri(300, dtype=int) <= 18).sum()
    blocks = sent[0][0].select("block").distinct().count()
    assert blocks > 25 and sent[0][1] <= 6 and sent[0][0].count() <= 4 * blocks


def turned(rng, n, angles=(0, 90, 180, 270), like=0.3):
    """Prints whose turns are shifts, and vectors whose signs they are; some near copies."""
    v = rng.normal(size=(n, 64))
    v[n // 2 :] = v[: n - n // 2] + rng.normal(size=(n - n // 2, 64)) * like
    shifted = {a: np.roll(v, -(a // 90) * 16, axis=1) for a in (0, 90, 180, 270)}
    bits = {a: np.packbits(x > 0, axis=1).view(">u8").ravel() for a, x in shifted.items()}
    rows = [(i, a, int(bits[a][i]) >> 32, int(bits[a][i]) & 0xFFFFFFFF) for i in range(n) for a in angles]
    vectors = [(i, a, shifted[a][i].tolist()) for i in range(n) for a in angles if a == 0 or i % 3]
    return rows, vectors


@pytest.mark.parametrize("angles", [(0, 90, 180, 270), (0, 90), (270, 180)])
def test_items_are_judged_where_they_are_found(spark, angles):
    """All three kinds of judging against hits that are joined with their vectors afterwards; some items have other turns than the rest."""
    rng = np.random.default_rng(len(angles))
    rows, vectors = turned(rng, 400, angles)
    rows = [(i, a, hi ^ (1 << 7) if a == 90 and i % 50 == 0 else hi, lo) for i, a, hi, lo in rows if (i, a) != (4, 90)]
    df, v = spark.createDataFrame(rows, PRINTS), spark.createDataFrame(vectors, "id long, angle int, vector array<double>")
    hits = C.hamming_pairs(df, 18, per=90).cache()
    assert {tuple(r) for r in hits.collect()} == plain_pairs(rows, 18)
    rounded = lambda out: {(*r[:-1], round(r[-1], 9)) for r in out.collect()}
    assert rounded(C.near_and_turned(df, v, 18, 0.2, per=90)) == rounded(C.aligned_cosine(hits, v, 0.2))
    side = lambda s: v.where("angle = 0").selectExpr(f"id AS {s}", f"vector AS v{s}")
    judged = hits.join(side("a"), "a").join(side("b"), "b").withColumn("sim", C.cosine(C.F.col("va"), C.F.col("vb")))
    assert rounded(C.near_and_alike(df, v, 18, 0.2, per=90)) == rounded(judged.where("sim >= 0.2").select("a", "b", "distance", "sim"))
    missing = {tuple(r) for r in C.missing_rotations(judged.where("sim < 0.2"), v).collect()}
    assert {tuple(r) for r in C.near_and_missing(df, v, 18, 0.2, per=90).collect()} == missing and (missing or 0 not in angles)


def test_turns_that_move_bits_are_compared_once(spark):
    rows, _ = turned(np.random.default_rng(2), 200)
    items = P.grouped(spark.createDataFrame(rows, PRINTS).selectExpr("vec_id AS key", "angle", "shiftleft(hi, 32) | lo AS bits"))
    made = P.packed_items(items, P.Prints(), None, None).first()
    values = P.Prints().matrix(made.data)
    assert P.combinations(P.turns(values), P.turns(values)) == [(0, z) for z in range(4)]
    other = values.copy()
    other["bits"][3, 2] ^= np.uint64(1)
    assert len(P.combinations(P.turns(values), P.turns(other))) == 16


def test_items_of_many_prints_and_other_keys(spark):
    rng = np.random.default_rng(9)
    values = clustered_bits(rng, 6, 5, 10)
    many = [(i % 3, 90 * (i % 4), v >> 32, v & 0xFFFFFFFF) for i, v in enumerate(values)]
    assert {tuple(r) for r in C.hamming_pairs(spark.createDataFrame(many, PRINTS), 18).collect()} == plain_pairs(many, 18)
    named = spark.createDataFrame([(f"k{k}", *r) for k, *r in many], PRINTS.replace("vec_id long", "vec_id string"))
    assert {tuple(r) for r in C.hamming_pairs(named, 18).collect()} == {(f"k{a}", f"k{b}", *m) for a, b, *m in plain_pairs(many, 18)}
