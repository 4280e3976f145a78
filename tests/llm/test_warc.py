import hashlib
import io

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from evigraph.llm import warc as A


def brute(rows):
    out, seen = [], {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        d = hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and d in seen:
            out.append((page, len(data), d, "revisit", seen[d]))
        else:
            seen.setdefault(d, page)
            out.append((page, len(data), d, "response", None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_and_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "PAGES_PER_ARCHIVE", 9)
    rows = [(i, f"http://a/é {i}\r\nX", "x\r\n\r\nWARC/1.1é" * (i % 5) * 4) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "z" * 200000), (None, "u", "z" * 200000), (105, "u", "z" * 200000), (105, "u", "z" * 200000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    folder = f"file://{tmp_path}/w"
    index = A.write(pages, folder)
    assert got(A.read(index, folder)) == brute(rows)
    assert index.select("file").distinct().count() > 3
    # the archives are plain gzip of plain records, and the index says where each is
    system, path = fs.FileSystem.from_uri(folder)
    for r in index.collect():
        with system.open_input_file(f"{path}/{r.file}") as f:
            f.seek(r.offset)
            headers, _ = A.parse(f.read(r.length))
        assert headers["X-Page"] == ("" if r.page_id is None else str(r.page_id)) and headers["WARC-Payload-Digest"] == f"sha256:{r.digest}"
    some = index.where("page_id % 7 = 3")
    assert {r[0] for r in got(A.read(some, folder))} == {r[0] for r in rows if r[0] is not None and r[0] % 7 == 3}
    texts = {r.page_id: bytes(r.payload).decode() for r in A.read(index.where("record_type = 'response'"), folder).collect()}
    assert all(texts[i] == h for i, _, h in rows[:2])
    assert got(A.round_trip(pages.limit(0))) == []


def test_ranges():
    assert A.ranges([(0, 10), (12, 5), (5000, 10), (5010, 90)], gap=4, most=60) == [(0, 2, 0, 17), (2, 3, 5000, 5010), (3, 4, 5010, 5100)]


def test_attempts_leave_one_file_and_reading_follows_bytes(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(A, "PAGES_PER_ARCHIVE", 40)
    monkeypatch.setattr(A, "RUN_BYTES", 1 << 10)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 30) for i in range(200)] + [(7, "http://h/7", "<p>7</p>" * 30)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    first = sorted(map(tuple, A.write(pages, folder).collect()), key=str)
    assert sorted(map(tuple, (index := A.write(pages, folder)).collect()), key=str) == first
    assert all(f.startswith("part-") for f in os.listdir(tmp_path / "w"))
    assert A.read(index, folder).rdd.getNumPartitions() > 4
    assert sorted(r.page_id for r in A.read(index, folder).collect()) == sorted([*range(200), 7])
