"""Literal cases of the rules: filenames, metadata, scores, candidates, groups and the library."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.config import Rules, Weights, from_environment
from evigraph.functions import evidence as E
from evigraph.functions import metadata as M
from evigraph.operators import candidates as C
from evigraph.operators import groups as G
from evigraph.operators import library as L
from evigraph.operators import reports as R

ITEM = "id string, original_filename string, source_job_number string, source_checkin_date string, source_technician_id string, source_job_type string, image_quality_status string, ai_metadata_json string"


def items(spark, rows):
    return spark.createDataFrame([(i, name, job, date, tech, None, status, meta) for i, name, job, date, tech, status, meta in rows], ITEM)


def test_filenames(spark):
    names = ["new_20250417_home_7301946582_TX9_Q_20250417101112_4.jpeg", "new_20250602_splitter_6612093847_any-one_1.jpeg", "x_other_7301946582_1.jpg", "new_20250417_home_77_1.jpeg", "plain.jpeg", "MA-Splice_20251120_upload.jpg", "a/b/ma-new_NULL_home_7301946582.jpg"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    n = F.col("n")
    rows = df.select("i", M.customer(n), M.checkin_date(n), M.job_type(n), M.technician(n)).orderBy("i").collect()
    assert [tuple(r[1:]) for r in rows] == [("7301946582", "20250417", "new", "TX9"), ("6612093847", "20250602", "new", "any-one"), (None, None, None, None), (None, None, "new", None), (None, None, None, None), (None, None, "ma-splice", None), ("7301946582", None, "ma-new", None)]


def test_resolution_prefers_stored_values(spark):
    name = "ma-new_20251120_home_7301946582_K7_1.jpeg"
    rows = G.resolved_items(items(spark, [("1", name, "stored-1", None, None, None, None), ("2", name, "", "", "", None, None)])).orderBy("id").collect()
    assert [(r.customer_id, r.checkin_date, r.technician_id, r.job_type) for r in rows] == [("stored-1", "20251120", "K7", "ma-new"), ("7301946582", "20251120", "K7", "ma-new")]


def test_boxes_and_scans(spark):
    box = {"bbox": [12.6, 34.3, 118.7, 59], "confidence": 0.97}
    bad = [{"bbox": [5, 5, 5, 9], "confidence": 1}, {"bbox": [1, 2, 3], "confidence": 1}, {"bbox": [1, 2, 3, 4]}]
    base = {"model": "lat-long/v1", "metadata_version": 2, "lat_long": []}
    metas = [json.dumps({**base, "datetime": [box, *bad]}), json.dumps({**base, "datetime": []}), "not-json", json.dumps({"model": "lat-long/v1", "lat_long": [], "datetime": []}), None, json.dumps({**base, "datetime": None}), json.dumps({**base, "datetime": [], "error": "x"}), json.dumps({**base, "datetime": [{"bbox": [0.5, 1.5, 2.5, 3.5], "confidence": 0.1}]})]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(metas)], "i int, m string")
    rows = df.select("i", M.boxes(F.col("m"), "datetime").alias("b"), M.scanned(F.col("m")).alias("s")).orderBy("i").collect()
    assert [tuple(map(tuple, r.b)) for r in rows] == [((13, 34, 119, 59, 0.97),), (), (), (), (), (), (), ((0, 2, 2, 4, 0.1),)]
    assert [r.s for r in rows] == [True, True, False, False, False, False, False, True]


def test_dates_ranges_and_progress(spark):
    df = spark.createDataFrame([("20251120",), (None,), ("20251125",)], "d string")
    d = F.col("d")
    rows = df.select(M.in_range(d, None, None), M.in_range(d, "20251120", None), M.in_range(d, None, "20251120"), M.not_after(d, "20251120"), M.day_month_year(d)).collect()
    assert [tuple(r) for r in rows] == [(True, True, True, True, "20/11/2025"), (True, False, False, True, None), (True, True, False, False, "25/11/2025")]
    p = spark.createDataFrame([(80, 31, 44), (80, 52, 17), (80, 93, 71), (0, 3, 1)], "t int, p int, c int")
    assert [r[0] for r in p.select(R.progress(F.col("t"), F.col("p"), F.col("c"))).collect()] == [44, 52, 80, 3]


EMPTY = {"exact_duplicate": False, "detected_transform": "original", "flip_detected": False, "rotation_degrees": 0, "ransac_inliers": 0, "ransac_inlier_ratio": 0.0, "sift_good_matches": 0, "sift_reference_features": 0, "embedding_similarity": None, "phash_distance": None, "phash_max_distance": 64, **dict.fromkeys((*"scene_change_suspected repeated_checkin_suspected recapture_suspected blurred_crop_suspected same_location_suspected similar_person_only body_reuse_gate body_reuse_suspected foreground_source_reuse heatmap_scene_change_support whole_image_fallback_used".split(),), False)}
KIND = {bool: "boolean", int: "int", float: "double", str: "string"}
SCORE = ", ".join(f"{k} {'double' if k == 'embedding_similarity' else 'int' if v is None else KIND[type(v)]}" for k, v in EMPTY.items())
GEOMETRY = {"sift_good_matches": 80, "sift_reference_features": 300, "ransac_inliers": 60, "ransac_inlier_ratio": 0.75}


@pytest.mark.parametrize(
    ("given", "score", "classification", "verdict"),
    [
        ({}, 0.0, "unrelated", "not_reused"),
        ({"exact_duplicate": True}, 1.0, "exact_file", "reused"),
        ({"embedding_similarity": 0.2, "flip_detected": True, "detected_transform": "horizontal_flip", "ransac_inliers": 3, "sift_good_matches": 5}, None, "unrelated", "not_reused"),
        ({**GEOMETRY, "embedding_similarity": 0.9, "phash_distance": 3, "flip_detected": True, "detected_transform": "horizontal_flip"}, None, "edited_or_cropped", "reused"),
        ({**GEOMETRY, "scene_change_suspected": True, "embedding_similarity": 0.1}, 0.72, "background_replaced", "review"),
        ({**GEOMETRY, "scene_change_suspected": True, "heatmap_scene_change_support": True, "embedding_similarity": 0.1}, 0.76, "background_replaced", "review"),
        ({"repeated_checkin_suspected": True, "same_location_suspected": True}, 0.68, "repeated_checkin", "review"),
        ({**GEOMETRY, "phash_distance": 2, "embedding_similarity": 0.99, "recapture_suspected": True, "repeated_checkin_suspected": True}, None, "same_image", "reused"),
        ({**GEOMETRY, "phash_distance": 2, "embedding_similarity": 0.99, "rotation_degrees": 90, "detected_transform": "rotate_90"}, None, "edited_or_cropped", "reused"),
        ({"blurred_crop_suspected": True, "whole_image_fallback_used": True}, 0.70, "edited_or_cropped", "reused"),
        ({"same_location_suspected": True}, 0.67, "same_scene_new_capture", "review"),
        ({**GEOMETRY, "embedding_similarity": 1.0, "similar_person_only": True}, 0.64, "similar_person", "not_reused"),
    ],
)
def test_scores(spark, given, score, classification, verdict):
    row = {**EMPTY, **given}
    df = spark.createDataFrame([tuple(row.values())], SCORE)
    got = E.score(df).first()
    assert (got.classification, got.reuse_verdict) == (classification, verdict)
    assert score is None or abs(got.relationship_score - score) < 1e-9
    assert len(got.reasons) > 0


def test_configuration(monkeypatch):
    with pytest.raises(ValueError):
        Weights(phash=0.5)
    with pytest.raises(ValueError):
        Rules(high=0.95)
    monkeypatch.setenv("RULES__TOP_K", "7")
    monkeypatch.setenv("RULES__HIGH", "0.85")
    assert (from_environment().top_k, from_environment().high) == (7, 0.85)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "image_a_id string, image_b_id string, relationship_level string, relationship_score double")


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_id, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_groups_and_customer_merge(spark):
    jobs = {"p": "K1", "q": "K2", "r": "K2", "s": "K3", "t": "K3", "u": "K4", "v": "K5", "w": "K1"}
    own = items(spark, [(i, "n.jpg", job, "20251120", None, None, None) for i, job in jobs.items()])
    pr = pairs(spark, [("p", "q", "exact_file", 0.7), ("r", "s", "same_image", 0.8), ("t", "u", "edited_or_cropped", 0.6), ("u", "v", "same_scene_new_capture", 1.0), ("v", "w", "same_image", 0.3)])
    groups = G.reportable_groups(own, pr, 0.5)
    assert grouped(groups) == [["p", "q"], ["r", "s"], ["t", "u"]]
    # K2 joins the first two, K3 the last two
    assert grouped(G.merged_by_customer(groups, own)) == [["p", "q", "r", "s", "t", "u"]]
    detail = {r.group_id: r for r in G.detail(groups, own, G.qualified(pr, own, G.REPORTABLE, 0.5)).collect()}
    assert (detail["p"].size, detail["p"].relationship_count, detail["r"].customers) == (2, 1, ["K2", "K3"])
    assert G.reportable_groups(own, pr.limit(0), 0.5).count() == 0


def test_later_items_do_not_bridge(spark):
    own = items(spark, [(f"i{k}", "n.jpg", f"K{k}", d, None, None, None) for k, d in enumerate(("20250101", "20250105", "20250301", None, "20250102"))])
    pr = pairs(spark, [("i0", "i2", "same_image", 0.9), ("i1", "i2", "same_image", 0.9), ("i3", "i4", "same_image", 0.9)])
    assert grouped(G.as_of_groups(own, pr, 0.5, "20250131")) == [["i3", "i4"]]
    assert grouped(G.as_of_groups(own, pr, 0.5, None)) == [["i0", "i1", "i2"], ["i3", "i4"]]


def test_unusable_items_leave(spark):
    own = items(spark, [("a", "u.jpg", "1", None, None, "UNVERIFIABLE", None), ("b", "u.jpg", "2", None, None, None, None), ("c", "u.jpg", "3", None, None, "VERIFIABLE", None)])
    pr = pairs(spark, [("a", "b", "exact_file", 1.0), ("b", "c", "exact_file", 1.0)])
    assert grouped(G.reportable_groups(own, pr, 0.5)) == [["b", "c"]]


def test_hamming_join_is_exact(spark):
    rows = [("a", 0, 0), ("b", 0, 1), ("c", 0, 3), ("d", 0xFFFFFFFF, 0xFFFFFFFF), ("e", 0, 0)]
    fp = spark.createDataFrame([(i, 0, h, x) for i, h, x in rows], "vec_id string, angle int, hi long, lo long")
    got = {(r.a, r.b): r.distance for r in C.hamming_pairs(fp, 2, rotations=False).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "e"): 0, ("b", "c"): 1, ("b", "e"): 1, ("c", "e"): 2}
    assert C.hamming_pairs(fp.where("vec_id = 'd' OR vec_id = 'a'"), 10).count() == 0


def test_hamming_index_and_blocks_agree(spark, monkeypatch):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    flip = lambda x: x ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(12)))
    values = [(i, flip(base[i % 30])) for i in range(120)]
    fp = spark.createDataFrame([(i, a, (v << a) >> 32 & 0xFFFFFFFF, v & 0xFFFFFFFF) for i, v in values for a in (0, 90)], "vec_id long, angle int, hi long, lo long")
    rows = fp.collect()
    brute = {}
    for x in rows:
        for y in rows:
            d = (x.hi ^ y.hi).bit_count() + (x.lo ^ y.lo).bit_count()
            if x.vec_id < y.vec_id and d <= 10:
                brute[x.vec_id, y.vec_id] = min(brute.get((x.vec_id, y.vec_id), (99,)), (d, x.angle, y.angle))
    got = lambda per=None: {(r.a, r.b): (r.distance, r.angle_a, r.angle_b) for r in C.hamming_pairs(fp, 10, per=per).collect()}
    assert got() == brute and brute
    monkeypatch.setattr(C, "INDEXED", 0)
    assert got(70) == brute


def test_topk_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    expected = {(i, j) for i in range(60) for j in sorted(range(60), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:5]}
    for size in (1000, 13):
        assert {(r.query, r.match) for r in C.topk_cosine(df, 5, per=size).collect()} == expected


def test_library(spark):
    old, new = pairs(spark, [("a", "b", "x", 0.1), ("c", "d", "x", 0.2)]), pairs(spark, [("a", "b", "y", 0.9), ("e", "f", "y", 0.8)])
    out = L.upsert(old, new, ["image_a_id", "image_b_id"])
    assert sorted((r.image_a_id, r.relationship_score) for r in out.collect()) == [("a", 0.9), ("c", 0.2), ("e", 0.8)]
    assert sorted(map(tuple, L.upsert(out, new, ["image_a_id", "image_b_id"]).collect())) == sorted(map(tuple, out.collect()))
    files = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p3",)], "path string")
    known = spark.createDataFrame([("p1", "COMPLETED"), ("p2", "QUEUED")], "path string, analysis_status string")
    assert [tuple(r) for r in L.import_plan(files, known).collect()] == [("p2", "requeue"), ("p3", "register")]
    own = items(spark, [("a", "u.jpg", "C1", "1", None, None, None), ("b", "u.jpg", "C1", "1", None, None, None), ("c", "u.jpg", "C1", "2", None, None, None), ("d", "u.jpg", None, "2", None, None, None)])
    pr = pairs(spark, [("a", "b", "x", 1.0), ("b", "c", "x", 1.0), ("c", "d", "x", 1.0)])
    assert sorted(r.image_a_id for r in L.usable_pairs(pr, own).collect()) == ["b", "c"]


def test_import_plan_is_whole(spark):
    files = spark.range(100_005).selectExpr("lpad(id, 6, '0') AS path")
    known = files.where("path < '000003'").selectExpr("path", "'COMPLETED' AS analysis_status")
    plan = L.import_plan(files, known)
    assert plan.count() == 100_002 and plan.agg({"path": "max"}).first()[0] == "100004"
    assert [r.path for r in L.import_plan(files, known, most=2).collect()] == ["000003", "000004"]
