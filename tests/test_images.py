"""Pixels: quality, hashes, matching and homographies; archives and streams of files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.functions import images as I
from evigraph.sources import archive
from evigraph.streaming import incremental


def png(x: np.ndarray) -> bytes:
    rows = b"".join(b"\0" + r.tobytes() for r in np.repeat(x[:, :, None], 3, 2).astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_quality():
    flat = np.full((200, 300), 52.0)
    flat[180:, 170:] = 220
    assert I.quality(flat)[:2] == ("UNVERIFIABLE", "dark_flat_scene")
    built = np.full((180, 240), 20.0)
    built[30:150, 70:180] = 115
    assert I.quality(built)[0] == "VERIFIABLE"
    assert I.quality(np.zeros((50, 50)))[:2] == ("UNVERIFIABLE", "near_black_dominant")
    assert I.quality(np.zeros((0, 0)))[:2] == ("UNVERIFIABLE", "empty_image")


def test_blur_and_hash():
    rng = np.random.default_rng(42)
    x = rng.integers(0, 256, (120, 90)).astype(float)
    p = np.pad(x, 1, mode="reflect")
    brute = np.array([[p[i, j + 1] + p[i + 2, j + 1] + p[i + 1, j] + p[i + 1, j + 2] - 4 * p[i + 1, j + 1] for j in range(90)] for i in range(120)])
    assert abs(I.blur_variance(x) - brute.var()) < 1e-6 and I.blur_variance(I.smooth(x, 2)) < I.blur_variance(x) / 20
    smooth = I.smooth(x, 4)
    near = bin(int(I.dct_hash(smooth), 16) ^ int(I.dct_hash(smooth * 0.9 + 10), 16)).count("1")
    far = bin(int(I.dct_hash(smooth), 16) ^ int(I.dct_hash(I.smooth(rng.integers(0, 256, (120, 90)).astype(float), 4)), 16)).count("1")
    assert near <= 4 < 15 < far


def test_homography_with_outliers():
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 300, (80, 2))
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.9, 12], [1e-4, 2e-4, 1]])
    q = np.c_[a, np.ones(80)] @ h.T
    b = q[:, :2] / q[:, 2:]
    b[60:] = rng.uniform(0, 300, (20, 2))
    inliers, ratio, coverage = I.ransac(a, b, (300, 300), (400, 400))
    assert 60 <= inliers <= 63 and abs(ratio - inliers / 80) < 1e-9 and 0.3 < coverage < 1
    assert I.ransac(a, b, (300, 300), (400, 400)) == (inliers, ratio, coverage)
    assert I.ransac(a[:3], b[:3], (1, 1), (1, 1)) == (0, 0.0, 0.0)
    d = rng.normal(size=(50, 16))
    e = d[::-1] + rng.normal(size=(50, 16)) * 0.01
    assert I.mutual_matches(d, e).tolist() == [[i, 49 - i] for i in range(50)]
    assert abs(I.hull_area(np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1]])) - 12) < 1e-9


def test_archive_and_udfs(spark, tmp_path):
    rng = np.random.default_rng(1)
    picture = np.clip(I.smooth(rng.integers(0, 256, (64, 48)).astype(float), 3) * 4 - 380, 0, 255)
    for path, data in (("2026-08-13/cat/a.png", png(picture)), ("2026-08-13/b.PNG", png(np.zeros((20, 20)))), ("2026-13-45/x/c.png", b"x"), ("2026-08-14/cat/n.txt", b"x"), ("2026-08-14/dog/d.jpg", b"broken")):
        f = tmp_path / "archive" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    root = str(tmp_path / "archive")
    listed = archive.files(spark, root, content=True)
    assert {(r.archive_date, r.category, r.name) for r in listed.collect()} == {("2026-08-13", "cat", "a.png"), ("2026-08-13", archive.ROOT, "b.PNG"), ("2026-08-14", "dog", "d.jpg")}
    assert archive.select(listed, "2026-08-13", ["cat"]).count() == 1
    with pytest.raises(ValueError):
        archive.select(listed, None, ["cat", "bird"])
    assert archive.valid(listed, 10).where("reason = 'too_large'").count() == 2
    images = spark.read.format("image").load(f"{root}/2026-08-13/*", recursiveFileLookup=True).select("image.*")
    got = {r.origin.rsplit("/", 1)[-1]: r for r in images.select("origin", I.quality_udf("data", "height", "width").alias("q"), I.blur_variance_udf("data", "height", "width").alias("b"), I.rotation_hashes_udf("data", "height", "width").alias("h")).collect()}
    assert got["a.png"].q.status == "VERIFIABLE" and got["b.PNG"].q.reason == "near_black_dominant"
    assert got["a.png"].h["0"] == I.dct_hash(np.rint(picture.astype(np.uint8)).astype(float)) and len(got["a.png"].h) == 4 and got["b.PNG"].b == 0.0
    pts = rng.uniform(0, 100, (12, 2))
    one = spark.createDataFrame([(pts.ravel().tolist(), (pts + 5).ravel().tolist(), [100, 100], [120, 120])], "a array<double>, b array<double>, s array<int>, t array<int>")
    assert one.select(I.homography_udf("a", "b", "s", "t").alias("r")).first().r.inliers == 12


def test_stream_of_duplicates(spark, tmp_path):
    source, library, links, mark = (str(tmp_path / x) for x in ("in", "library", "links", "mark"))
    schema = "id string, sha256 string"
    spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], schema).write.mode("append").parquet(source)
    run = lambda: incremental.ingest(spark.readStream.schema(schema).parquet(source), library, links, mark).awaitTermination()
    run()
    assert sorted(map(tuple, incremental.read_links(spark, links).collect())) == [("a", "c")]
    spark.createDataFrame([("d", "2"), ("e", "1"), ("f", "9")], schema).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(map(tuple, incremental.read_links(spark, links).collect())) == [("a", "c"), ("a", "e"), ("b", "d"), ("c", "e")]
    assert spark.read.schema("id string, batch int").parquet(library).count() == 6
    assert spark.read.schema(schema).parquet(library).select(F.count_distinct("id")).first()[0] == 6
