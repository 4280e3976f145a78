"""Packing: ids against the vocabulary's own library, every piece in one place, gapless sequences, and their number."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evigraph.llm import packing
from evigraph.llm.queries import QUERIES

HARD = ["", " ", "  a  b\n\n c", "don't we'll I'VE", "naïve Ünïcode ß × ÷ 漢字 🙂🙂 é", "a b c　d\t\te", "x" * 500, "1234567 89,0", "</s><|endoftex", "\x1c\x85 z", "…“quoted”…\r\n"]


def own_ids(texts):
    t = Tokenizer.from_file(packing.VOCABULARY)
    t.encode_special_tokens = True
    return [x.ids + [2] for x in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, expected, size):
    """``rows`` against the ids of each document, in any order of documents."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(expected)
    for doc, ids in expected.items():
        cuts = [(0, len(ids))] if len(ids) <= size else [(a, b) for a, b in zip([0, *range(len(ids) % size or size, len(ids), size)], [*range(len(ids) % size or size, len(ids) + 1, size)])]
        wanted = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc]) == wanted
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_all_documents_are_packed_nearly_full(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip([r.doc_id for r in docs], own_ids([r.text or "" for r in docs])))
    n = check(QUERIES["op11_pattern_packing"](spark, sf_dir).collect(), expected, packing.SIZE)
    assert n <= 1.02 * -(-sum(map(len, expected.values())) // packing.SIZE) + 1


@pytest.mark.parametrize("size", [7, 64])
def test_hard_texts_and_repeated_rows(spark, size):
    texts = HARD + ["a " * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("length", F.lit("x")).withColumn("part", F.lit(None).cast("int")).repartition(5)
    packed = packing.pack(df, size=size, with_ids=True)
    kept = packed.collect()
    expected = dict(zip([r[0] for r in rows], own_ids([r[1] or "" for r in rows])))
    check(kept, expected, size)
    found = defaultdict(list)
    for r in packing.sequences(packed).collect():
        at = 0
        for doc, length in zip(r.doc_ids, r.lengths):
            found[doc].append(r.ids[at : at + length])
            at += length
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(expected[d][r.start : r.start + r.length] for r in kept if r.doc_id == d) for d in expected}


def test_equal_rows_and_null_ids_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(None, "same text")] * 5 + [(1, "same text")] * 2, "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 7 and len({(r.sequence_id, r.offset) for r in rows}) == 7
    assert packing.pack(df.limit(0)).collect() == []


def counted(plan, size):
    out = np.zeros(size + 1, np.int64)
    for own, n in plan:
        assert n > 0 and sum(length * k for length, k in own) <= size
        for length, k in own:
            out[length] += n * k
    return out


@pytest.mark.parametrize("name", ["short", "middle", "long", "mixed", "few lengths", "one"])
def test_plans_hold_all_pieces_in_few_sequences(name):
    rng = np.random.default_rng(3)
    lengths = {
        "short": rng.integers(1, 60, 5000),
        "middle": rng.integers(300, 420, 5000),
        "long": rng.integers(500, 1025, 5000),
        "mixed": np.minimum(1024, rng.geometric(0.005, 5000)),
        "few lengths": rng.choice([1, 340, 341, 511, 513, 700], 5000),
        "one": np.array([3]),
    }[name]
    for times in (1, 1000, 10**9):
        counts = np.bincount(lengths, minlength=1025) * times
        made = packing.plan(counts)
        assert (counted(made, 1024) == counts).all()
        n = sum(k for _, k in made)
        alone = sum(k for _, k in packing.best_fit(counts, 1024))
        assert -(-int(counts @ np.arange(1025)) // 1024) <= n <= 1.003 * alone + 1
        assert len(made) < 6000


def test_fit_is_as_good_as_the_best_of_all_nonnegative_ones():
    lengths = np.array([2, 3, 4, 5, 6, 8])
    bins, times = packing.patterns(lengths, 10)
    dense = np.zeros((11, len(bins)))
    for p in range(len(bins)):
        for b, t in zip(bins[p], times[p]):
            if b:
                dense[b, p] += t
    hidden = np.zeros(len(bins))
    hidden[[0, 2, len(bins) - 1]] = 40, 25, 60
    counts = dense @ hidden
    x = packing.nnls(bins, times, counts)
    assert (x >= 0).all() and np.abs(dense @ x - counts).max() < 0.02 * counts.max()
    # no pattern is steep where the counts can't be met exactly
    counts[8] += 50
    x = packing.nnls(bins, times, counts)
    slope = dense.T @ (counts - dense @ x)
    assert slope.max() < 0.02 * counts.max() * 3
