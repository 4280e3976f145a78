import random
import re
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import DataFrameWriter

from evigraph.llm import jaccard as J
from evigraph.plans.scratch import BATCH_KEY, batch_rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(k)
    seen = set()
    for ks in lists.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a][1] & sets[b][1])
                    if 100 * common >= 75 * len(sets[a][1] | sets[b][1]):
                        parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if r not in least or i is not None and (least[r] is None or i < least[r]) else least[r]
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_prefix_length():
    for n in range(1, 500):
        assert J.prefix_length(n) == n - -(-75 * n // 100) + 1


def test_orders_never_drop_a_link():
    rng = np.random.default_rng(3)
    for _ in range(400):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = np.unique(base[: rng.integers(40, 61)]), np.unique(base[rng.integers(0, 20) :])
        common = len(np.intersect1d(a, b))
        assert J.linked(a, b) == (100 * common >= 75 * (len(a) + len(b) - common))
        if J.linked(a, b):
            assert all(len(np.intersect1d(J._prefix(a, s), J._prefix(b, s))) for s in range(20))


def test_counts_of_tokens_cover_all_sets(spark, monkeypatch):
    monkeypatch.setattr(J, "PART_TOKENS", 50)
    monkeypatch.setattr(J, "FLUSH", 40)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(1, 40))) for _ in range(80)]
    sets = J.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))
    kept = {r.key: frozenset(np.frombuffer(bytes(r.tokens), np.uint64).tolist()) for r in sets.collect()}
    n = Counter(t for s in kept.values() for t in s)
    parts, names, counts = J.frequent(sets.dropDuplicates(["key"]).coalesce(3), sum(n.values()))
    assert parts > 10
    tokens = np.array(sorted(n), np.uint64)
    own = J._names(tokens, parts)
    assert dict(zip(names.tolist(), counts.tolist())) == {int(a): n[int(t)] for a, t in zip(own, tokens) if n[int(t)] > 2}
    monkeypatch.setattr(J, "MAX_FREQUENT", 5)
    assert len(J.frequent(sets, sum(n.values()))[1]) <= 5


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(J.components(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_hot_groups(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(60)] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join([*[word() for _ in range(rng.randrange(5, 60))], *passage])) for i in range(150)]
    rows += [(2000 + i, " ".join(base).upper()) for i in range(60)]
    # a chain: neighbours are alike, the ends are not
    chain = [word() for _ in range(120)]
    rows += [(3000 + i, " ".join(chain[i * 4 : i * 4 + 60])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(J.components(docs)) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE two"), (3, "one two three"), (2, "x " * 30000), (1, "X " * 40), (1, "X " * 40), (4, "lone text of six words here")]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, n int, key string")
    assert got(J.components(docs)) == brute(rows)
    assert J.components(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in J.components(alone).collect()), key=str) == [(4, 4), (None, 4), (None, None)]


def test_rows_without_id_are_linked_and_carry_chains(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, text(0, 60)), (None, text(4, 64)), (2, text(8, 68)), (None, text(300, 340)), (None, text(301, 341)), (None, None), (9, text(400, 402))]
    assert got(J.components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    named = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in rows], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in J.components(named).collect()} == {("d1", "d1"), (None, "d1"), ("d2", "d1"), (None, None), ("d9", "d9")}


def test_groups_that_are_alike_but_not_enough(spark):
    """Copies with 0 to 7 altered words: many share prefix tokens and few are linked; a common passage links nothing."""
    rng = random.Random(8)
    base, passage = [f"b{i}" for i in range(90)], [f"p{i}" for i in range(25)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(90)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join([*[f"o{i}x{j}" for j in range(rng.randrange(3, 50))], *passage])) for i in range(120)]
    assert got(J.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def near_threshold(n, seed=4):
    """Documents that keep 19 of 24 common blocks of 12 words: similarities around 0.65, few links."""
    rng = random.Random(seed)
    blocks = [" ".join(f"k{b}x{j}" for j in range(12)) for b in range(24)]
    return [(i, " ".join(blocks[b] if b in keep else f"u{i}x{b}" for b in range(24))) for i in range(n) for keep in [set(rng.sample(range(24), 19))]]


def brute_counted(rows):
    """As :func:`brute`, from a product of the matrix of documents and the shingles that several of them hold."""
    sets = [shingles(t) for _, t in rows]
    n = Counter(x for s in sets for x in s)
    place = {x: i for i, x in enumerate(x for x, k in n.items() if k > 1)}
    m = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s if x in place]] = 1
    size, common = np.array([len(s) for s in sets]), m @ m.T
    near = 100 * common >= 75 * (size[:, None] + size - common)
    least = np.arange(len(rows))
    while (new := np.where(near, least, len(rows)).min(1)).tolist() != least.tolist():
        least = new
    return sorted(((rows[i][0], int(size[i]), rows[least[i]][0]) for i in range(len(rows))), key=str)


def test_pairs_of_a_group_near_the_threshold_end_in_the_join(spark, monkeypatch):
    made, links = [], J.links
    monkeypatch.setattr(J, "links", lambda pairs, chosen: made.append(pairs.count()) or links(pairs, chosen))
    rows = near_threshold(600)
    assert got(J.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute_counted(rows)
    assert sum(made) < 600 * 599 / 2 / 20


def test_parity_never_drops_a_link():
    rng = np.random.default_rng(5)
    for size in (3, 40, 300, 4000):
        for _ in range(40):
            base = rng.integers(0, 2**63, size).astype(np.uint64)
            a, b = np.unique(base[rng.random(size) < 0.9]), np.unique(base[rng.random(size) < 0.9])
            differ = sum(int(x).bit_count() for x in (J.parity(a) ^ J.parity(b)).view(np.uint64))
            assert differ <= len(np.setxor1d(a, b))


def test_batches_for_python_follow_the_size_of_the_sets(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(54 + i % 2))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(J, "BATCH_TOKENS", 500)
    most, was, write = {}, spark.conf.get(BATCH_KEY), DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: most.update({path.split("/")[-1].split("-")[0]: int(spark.conf.get(BATCH_KEY))}) or write(self, path))
    assert got(J.components(docs)) == brute(rows)
    assert most["sets"] == J.BATCH_TEXTS and most["frequent"] == most["postings"] == most["chosen"] == 9 and most["links"] == 4
    assert most["degrees"] == most["components"] == int(was) and spark.conf.get(BATCH_KEY) == was


def test_a_session_with_smaller_batches_keeps_them(spark):
    was = spark.conf.get(BATCH_KEY)
    try:
        spark.conf.set(BATCH_KEY, 7)
        for most, expected in ((9, "7"), (7, "7"), (3, "3"), (None, "7")):
            with batch_rows(spark, most):
                assert spark.conf.get(BATCH_KEY) == expected
        spark.conf.set(BATCH_KEY, 0)  # no limit
        with batch_rows(spark, 9):
            assert spark.conf.get(BATCH_KEY) == "9"
        assert spark.conf.get(BATCH_KEY) == "0"
    finally:
        spark.conf.set(BATCH_KEY, was)


def test_counting_holds_few_copies_of_the_tokens():
    names = J._names(np.arange(1 << 18, dtype=np.uint64), 10)
    held = [names[: 1 << 17].copy(), names[1 << 17 :].copy(), names[:5].copy()]
    tracemalloc.start()
    counted = J._counted(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == [] and peak < 4.5 * names.nbytes
    assert sum(len(b) for b in counted.column("once").to_pylist()) == 4 * (len(names) - 5) and sum(len(b) for b in counted.column("twice").to_pylist()) == 8 * 5
