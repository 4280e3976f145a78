"""Spelling variants against plain Python over all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import spelling


def plain_vocabulary(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(vocab):
    forms, out = {}, {}
    for w, n in vocab.items():
        own = [x for x in vocab if near(w, x)]
        best = min(own, key=lambda x: (-vocab[x], x), default=None)
        forms[w] = best if best is not None and vocab[best] >= 5 * n else None
        out[w] = len(own)
    rows = []
    for w, n in vocab.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], vocab.get(forms[w])))
    return rows


def corpus(seed, letters="abÀé", words=160):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(words)]
    stems += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abbbbb", "abbbbbb", "bbbbbb", "b" * 300, "b" * 299, "b" * 301 + "a"]
    docs = [(i, " ".join(rng.choices(stems, weights=[5.0 ** (k % 4) for k in range(len(stems))], k=300)).upper() if i % 3 else ", ".join(stems)) for i in range(30)]
    return docs + [(None, "aaaaaa " * 9), (None, None), (5, ""), (6, "×÷×÷×÷ " * 7), (7, "short words only " * 20)]


@pytest.mark.parametrize("leaf_words,together,seed", [(512, 1 << 14, 1), (20, 30, 2), (2, 1, 3)])
def test_variants_equal_all_pairs(spark, monkeypatch, leaf_words, together, seed):
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf_words)
    monkeypatch.setattr(spelling, "TOGETHER", together)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(map(tuple, spelling.variants(df).collect()), key=repr)
    expected = sorted(plain_variants(plain_vocabulary(docs)), key=repr)
    assert len(expected) > 50 and any(r[1] for r in expected)
    assert got == expected


def test_tries_of_several_roots_yield_each_pair_once():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)} - {"a", "b", "c"})
    skip = [1] * len(words)
    found = Counter((min(a, b), max(a, b)) for x, y in spelling.Tries(words, skip).pairs() for a, b in zip(x.tolist(), y.tolist()))
    # words that differ in their first letter are in different subtries; of equal letters in a row the first is the inserted one
    def place(a, b):
        a, b = sorted((a, b), key=len)
        return next(i for i in range(len(b)) if (b[:i] + b[i + 1 :] == a if len(a) < len(b) else a[i] != b[i]))

    expected = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j]) and place(words[i], words[j]) >= 1}
    assert set(found) == expected and set(found.values()) == {1}


def test_counts_prefer_frequent_then_small_words():
    words = ["aaaaaa", "aaaaab", "aaaaac", "zzzzzz"]
    count, best = spelling.near_counts(words, np.array([5, 9, 9, 50]), [0] * 4)
    assert count.tolist() == [2, 2, 2, 0] and best.tolist() == [1, 2, 1, -1]


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forms_of_forms_end_at_the_last(spark):
    chain = [("w0", "w1"), ("w1", "w2"), ("w2", "w3"), ("w3", "w4"), ("w4", "w5"), ("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w5" for w in ("w0", "w1", "w2", "w3", "w4", "x")}
