import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import brown as B
from evigraph.llm.queries import op1_brown_score


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(rows):
    """By doc_id: n_tokens, n_known, train_tokens, base_score."""
    train = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in [*split(t), None])
    n, v = sum(train.values()), len(train)
    return {d: (len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, t in rows for ws in [[*split(t), None]]}


@pytest.mark.parametrize("sizes", [(B.EXCHANGED, B.DICTIONARY), (60, 200)])
def test_query(spark, sf_dir, sizes, monkeypatch):
    monkeypatch.setattr(B.fit, "__defaults__", (*sizes, 4))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected, got = base(rows), op1_brown_score(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, n, s = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, n)
        assert abs(r.base_score - s) < 1e-6 * max(1, abs(s)) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_dictionary_size_changes_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    out = []
    for dictionary in (100, 5000):
        model, counts = B.fit(docs, 50, dictionary, 2)
        out.append({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in B.score(docs, model, counts).collect()})
    assert out[0] == out[1]


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b c. a b d9 é a b") for i in range(20)] + [(30, "x y a b z")], "doc_id long, text string")
    model, counts = B.fit(docs, 3, 5, 3)
    total = 10.0 ** model.transitions.astype(float)
    assert np.allclose(total.sum(2), 1, atol=1e-5)
    rows = {r.word: (r.fixed, r.n) for r in counts.collect()}
    lead = set(model.words[: model.exchanged].tolist())
    for c in range(1, B.CLASSES):
        own = [n for w, (f, n) in rows.items() if w not in lead and f == c and w != B.END]
        if c <= B.FIXED:
            floor = model.class_tokens[c] + 0.5 * (model.class_words[c] + 1)
            assert abs(sum((n + 0.5) / floor for n in own) + 0.5 / floor - 1) < 1e-9
        elif model.class_tokens[c]:
            assert abs(sum(n for n, k in zip(model.counts, model.classes) if k == c) / model.class_tokens[c] - 1) < 1e-9


def test_best_move_is_the_best_by_recounting():
    rng = np.random.default_rng(1)
    n, c = 12, 4
    counts = rng.integers(0, 6, (n, n)).astype(float)
    by = rng.integers(0, c, n)

    def matrix(by):
        out = np.zeros((c, c))
        np.add.at(out, (by[:, None].repeat(n, 1), by[None].repeat(n, 0)), counts)
        return out

    for w in range(n):
        others = np.arange(n) != w
        after = np.bincount(by[others], weights=counts[w, others], minlength=c)
        before = np.bincount(by[others], weights=counts[others, w], minlength=c)
        best, gain = B.best_move(matrix(by), int(by[w]), after, before, counts[w, w], slice(0, c))
        tried = []
        for k in range(c):
            other = by.copy()
            other[w] = k
            tried.append(B.likelihood(matrix(other)) - B.likelihood(matrix(by)))
        assert abs(max(tried) - gain) < 1e-6 and abs(tried[best] - gain) < 1e-6


def test_exchange_raises_the_likelihood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100)
    model, counts = B.fit(docs, 300, 1000, 0)
    pairs = B._pair_counts(docs, model.words[:300])
    rows = pairs.collect()

    def value(by):
        m = np.zeros((B.CLASSES, B.CLASSES))
        for r in rows:
            m[by[r.a], by[r.b]] += r.n
        return B.likelihood(m)

    assert value(B.exchange(pairs, 300, 6)) > value(B.exchange(pairs, 300, 0)) + 1


def test_tokens_and_lookup():
    h, fixed, starts = B.tokens(pa.array(["The the é. 9x", None, " ", "a"]))
    assert np.diff(starts).tolist() == [5, 1, 1, 2]
    assert h[0] == h[1] and (h == B.END).sum() == 4 and (fixed == 0).sum() == 4
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    find = B.Lookup(keys, bits=8)
    probe = np.concatenate([keys, keys + 1])
    assert find(probe).tolist() == [list(keys).index(x) if x in set(keys.tolist()) else -1 for x in probe.tolist()]


def test_edge_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "w " * 100000, 0.5), (3, "w", 0.5), (None, "w v", 0.5), (3, "w", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model, counts = B.fit(docs, 10, 10, 2)
    out = B.score(docs, model, counts)
    assert out.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    assert sorted(r.n_tokens for r in out.collect()) == [1, 1, 2, 2, 3, 100001]
    model, counts = B.fit(docs.limit(0), 10, 10, 2)
    assert B.score(docs.limit(0), model, counts).count() == 0
    assert all(r.n_known == 0 and r.score < 0 for r in B.score(docs, model, counts).collect())


def test_further_words_go_to_their_likeliest_class(spark):
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 50, (B.CLASSES, B.CLASSES)).astype(float)
    rows = [(w, int(code), int(rng.integers(1, 4))) for w in range(12) for k in (0, B.CLASSES) for code in rng.choice(B.CLASSES, 5, False) + k]
    rows += [(99, 3, 1), (99, B.CLASSES, 1)]
    got = {r["word"]: r["class"] for r in B.assign(spark.createDataFrame(rows, "word long, code int, n long"), pairs).collect()}
    expected = {}
    for w in range(12):
        gains = []
        for c in range(1 + B.FIXED, B.CLASSES):
            after = sum(n * math.log((pairs[c, k] + 0.5) / (pairs[c].sum() + 0.5 * B.CLASSES)) for v, k, n in rows if v == w and k < B.CLASSES)
            gains.append(after + sum(n * math.log((pairs[k - B.CLASSES, c] + 0.5) / (pairs[:, c].sum() + 0.5 * B.CLASSES)) for v, k, n in rows if v == w and k >= B.CLASSES))
        expected[w] = B.CLASSES + int(np.argmax(gains))
    assert got == expected


def test_every_repeated_word_has_a_class_by_its_neighbours(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    model, counts = B.fit(docs, 50, 100, 2)
    lead = set(model.words[:50].tolist())
    for r in counts.collect():
        if r.word != B.END and r.word not in lead:
            assert (r.fixed >= B.CLASSES) == (r.n >= B.LEAST)
    assert abs(model.class_tokens.sum() - model.n_tokens) < 1e-9


def test_classes_of_neighbours_and_of_open_words(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, None)], "doc_id long, text string")
    h, fixed, _ = B.tokens(pa.array(["a b a c"]))
    got = {(r.word, r.code): r.n for r in B._neighbours(docs, h[:1], np.array([40])).collect()}
    assert got == {(h[1], 40): 1, (h[1], 40 + B.CLASSES): 1, (h[3], 0): 1, (h[3], 40 + B.CLASSES): 1}
    rows = pa.RecordBatch.from_arrays([pa.array([bytes([1, 2, 0]), bytes([0]), bytes([5, 0])]), pa.array([[1], [], [0]], B.PLACES), pa.array([[140], [], [150]], B.PLACES)], ["classes", "places", "kinds"])
    c, starts = B._classes(rows.slice(1))
    assert c.tolist() == [0, 150, 0] and starts.tolist() == [0, 1, 3]
    assert B._classes(rows)[0].tolist() == [1, 140, 0, 0, 150, 0]
