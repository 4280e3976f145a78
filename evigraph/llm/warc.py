"""WARC archives that are written with an index and read back by byte ranges.

Writing: pages are dealt to archives by a hash of page_id, and each task writes its pages in order of page_id as gzip members of
``part-<k>.warc.gz``, in the folder given, by the file system of its URI. The rows it returns are the index: file, offset, length, URL
and digest of each record. A task writes under a name of its own attempt and renames the file when it is whole, so that attempts that
run again or side by side leave one file with the same bytes. Payloads that are equal and have
``LEAST_SHARED`` bytes or more are stored once; the other pages revisit the record with the smallest page_id.

Reading: index rows are sorted by file and offset and dealt in runs of a file, and records that lie within ``GAP`` bytes of one
another are fetched by one read of at most ``MOST_READ`` bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.plans.scratch import materialize, new_path, small_side

LEAST_SHARED = 100
GAP = 4096
MOST_READ = 8 << 20
#: Bytes of an archive that a task reads; more where a table would else have over MAX_RUNS tasks.
RUN_BYTES, MAX_RUNS = 4 << 20, 100_000
MAX_SHARED = 1 << 18
PAGES_PER_ARCHIVE = 2000
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("8c9f0b52-6a5b-5d0c-9b1e-3f9d3f4a7c11")


def _uri(page_id: int | None, digest: str, again: int = 0) -> str:
    """Of the record of a page and payload; ``again`` tells rows apart that share both."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest} {again}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, again: int = 0) -> bytes:
    """One gzip member."""
    block = b"" if revisit else payload
    clean = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id, digest, again)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to, digest)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.partition(": ")[::2] for x in lines[1:])
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the index, materialized: page_id, file, offset, length,
    url, digest, record_type.

    A null html is an empty payload and a null url an empty one; a null page_id counts as larger than all others. Of rows that share
    page_id and payload one is the response that the others revisit. Extra columns are not written.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n"))
    ids = keyed.where(F.col("n") >= LEAST_SHARED).select("digest", F.struct(F.col("page_id").isNull().alias("none"), "page_id").alias("id"))
    groups = ids.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1")
    shared = materialize(groups.select(F.col("digest").alias("shared"), F.col("first.page_id").alias("first"), F.lit(True).alias("grouped")), "shared")
    # payloads move once, to their archive, while the digests that several pages share are few enough to be broadcast
    found = keyed.join(small_side(shared, MAX_SHARED), (F.col("digest") == F.col("shared")) & (F.col("n") >= LEAST_SHARED), "left")
    number = max(1, -(-pages.count() // PAGES_PER_ARCHIVE))
    rows = found.select("page_id", "url", "html", "digest", "first", F.coalesce("grouped", F.lit(False)).alias("grouped"), F.pmod(F.xxhash64("page_id", "digest"), F.lit(number)).cast("int").alias("archive"))
    placed = rows.repartition(number, "archive").sortWithinPartitions("archive", F.col("page_id").asc_nulls_last(), "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, offset, last, again = None, None, 0, None, 0

        def finish():
            out.close()
            try:
                system.move(f"{path}/{own}", f"{path}/{name}")
            except OSError:
                # another attempt was first; some file systems do not rename onto a file
                if system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
                    raise
                system.delete_file(f"{path}/{own}")

        whole = False
        try:
            for batch in batches:
                index = []
                for page_id, url, html, digest, first, grouped, archive in zip(*(c.to_pylist() for c in batch.columns)):
                    if archive != at:
                        if out is not None:
                            finish()
                        at, offset, last = archive, 0, None
                        system, path = fs.FileSystem.from_uri(folder)
                        system.create_dir(path, recursive=True)
                        name = f"part-{archive:06d}.warc.gz"
                        own = f".{name}.{uuid.uuid4().hex}"
                        out = system.open_output_stream(f"{path}/{own}", compression=None)
                    revisit = grouped and (page_id != first or (page_id, digest) == last)
                    again = again + 1 if (page_id, digest) == last else 0
                    last = (page_id, digest)
                    data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first, revisit, again)
                    out.write(data)
                    index.append((page_id, name, offset, len(data), url, digest, "revisit" if revisit else "response"))
                    offset += len(data)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), TYPES)], NAMES)
            whole = True
        finally:
            if out is not None and whole:
                finish()
            elif out is not None:
                out.close()
                system.delete_file(f"{path}/{own}")

    return materialize(placed.mapInArrow(run, "page_id long, file string, offset long, length long, url string, digest string, record_type string"), "index")


NAMES = ["page_id", "file", "offset", "length", "url", "digest", "record_type"]
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def ranges(spans: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> list[tuple[int, int, int, int]]:
    """Reads (first span, last span exclusive, begin, end) that cover sorted (offset, length) spans."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            out[-1] = (out[-1][0], i + 1, out[-1][2], max(out[-1][3], offset + length))
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of index rows (file, offset, length): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    The payload of a revisit is null; of a response the digest and length are computed from the bytes read, and must be those of its
    headers. Any selection of index rows can be given; equal rows are read once each.
    """
    chosen = index.select("file", "offset", "length")
    width = Window.partitionBy("file").orderBy("offset")
    total = chosen.agg(F.sum("length")).first()[0] or 0
    size = max(RUN_BYTES, total // MAX_RUNS)
    runs = chosen.withColumn("run", F.floor(F.sum("length").over(width) / size))
    # the index is small, the archives are not: the number of tasks follows the bytes that they read
    dealt = runs.repartition(1 + total // size, "file", "run").sortWithinPartitions("file", "offset")

    def records(file: str, spans: list[tuple[int, int]]) -> Iterator[tuple]:
        system, path = fs.FileSystem.from_uri(folder)
        with system.open_input_file(f"{path}/{file}") as source:
            for first, last, begin, end in ranges(spans):
                source.seek(begin)
                data = source.read(end - begin)
                for offset, length in spans[first:last]:
                    headers, block = parse(data[offset - begin : offset - begin + length])
                    digest, n = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, n):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                    number = lambda x: int(x) if x else None
                    yield number(headers["X-Page"]), headers["WARC-Target-URI"], headers["WARC-Type"], number(headers.get("X-Refers-To-Page", "")), n, digest, None if revisit else block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            spans = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            begin = 0
            while begin < len(files):
                end = begin
                while end < len(files) and files[end] == files[begin] and end - begin < 500:
                    end += 1
                rows = list(records(files[begin], spans[begin:end]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()])], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                begin = end

    return dealt.select("file", "offset", "length").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to a new folder of the shared one (or ``folder``), then read all records back by their index."""
    folder = folder or new_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return read(write(pages, folder), folder)
