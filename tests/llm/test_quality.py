import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evigraph.llm import quality as Q

ROOM = "[^\\x20\\x09-\\x0D]"


def brute(text):
    text = text or ""
    ws = re.findall(ROOM + "+", text)
    lines = [x for x in text.split("\n") if re.search(ROOM, x)]
    runs = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def counted(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.counts(df).collect()}


def test_counts_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert counted(docs) == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_counts_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a a a a", "a b c a b c a b", "x\n x\nx\n\nx\r", "漢é#|\x0b<>\x1c", "one", "w " * 30000] + ["".join(rng.choices("ab \n\r#", k=rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    assert counted(docs) == {i: brute(t) for i, t in enumerate(texts)}


def test_chi_square():
    assert abs(Q.chi_square_cdf(11.0705, 5) - 0.95) < 1e-5
    assert abs(Q.chi_square_quantile(0.99, 7) - 18.4753) < 1e-3


def test_estimate_and_distance_are_the_matrix_forms(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, Q.D)) @ rng.normal(size=(Q.D, Q.D)) * 1000).astype(int)
    rows = spark.createDataFrame([(1, *map(int, r)) for r in x], "g long, " + ", ".join(f"x{i} long" for i in range(Q.D)))
    est = Q._estimate(Q._moments(rows, "g"), "g")
    cov = np.cov(x.T / 1000, bias=True) + np.diag([v * v for v in Q.STATISTICS.values()])
    assert abs(est.first().logdet - np.linalg.slogdet(cov)[1]) < 1e-6
    d = x / 1000 - x.mean(0) / 1000
    expected = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    got = [r.d2 for r in Q._distance(rows.join(est, "g")).collect()]
    assert np.allclose(sorted(got), sorted(expected))


def concentrated(x, start, size):
    """One group's steps, by sorting whole bins."""
    center, low = start
    for _ in range(Q.STEPS):
        y = np.linalg.solve(low, (x / 1000 - center).T).T
        bins = np.floor(np.log((y * y).sum(1) + 1e-6) * 64)
        order = np.argsort(bins, kind="stable")
        edge = bins[order][math.ceil(size * Q.CORE) - 1]
        core = x[bins <= edge] / 1000
        center = core.mean(0)
        low = np.linalg.cholesky(np.cov(core.T, bias=True) + np.diag([v * v for v in Q.STATISTICS.values()]))
    return center, low, 2 * np.log(np.diag(low)).sum()


def test_estimates_equal_a_brute_force(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(size=(200, Q.D)) @ rng.normal(size=(Q.D, Q.D))
    x = np.round(np.concatenate([clean, rng.normal(12, 1, (40, Q.D))]) * 1000).astype(int)
    rows = spark.createDataFrame([(1, *map(int, r)) for r in x] + [(2, *[0] * Q.D)], "g long, " + ", ".join(f"x{i} long" for i in range(Q.D)))
    got = Q.estimates(rows).collect()
    assert [r.g for r in got] == [1]
    floors = np.array(list(Q.STATISTICS.values()))
    q = np.percentile(x, [25, 50, 75], axis=0)
    starts = [(q[1] / 1000, np.diag(np.sqrt(((q[2] - q[0]) / 1.349 / 1000) ** 2 + floors**2))), (np.round(x.mean(0)) / 1000, np.diag(np.sqrt(np.round(x.var(0)) / 1e6 + floors**2)))]
    best = min((concentrated(x, s, len(x)) for s in starts), key=lambda e: e[2])
    assert np.allclose([getattr(got[0], f"m{i}") for i in range(Q.D)], best[0], atol=1e-6)
    assert abs(got[0].logdet - best[2]) < 1e-6


def test_junk_goes_and_clean_texts_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.choice((2, 3, 5, 8))))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60, 900))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + rng.choice(("###", "$$$", "%%%")) for _ in range(200)), "en", "s") for i in range(20)]
    rows += [(2000, None, None, None), (2001, "", "en", "s"), (2002, "a b c " * 90, "en", "s"), (2003, " ".join(word() for _ in range(90)), None, "s"), (2003, " ".join(word() for _ in range(90)), None, "s")]
    out = Q.judge(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert sum(not got[i].kept for i in range(300)) <= 1 and not any(got[1000 + i].kept for i in range(20))
    assert [got[i].base_failed for i in (2000, 2001, 2002, 2003)] == [True, True, True, False] and got[2003].kept
    assert Q.judge(out.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_duplicate_lines_or_repeats_alone_reject(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.choice((3, 5, 8)))) for _ in range(n))
    rows = [(i, "\n".join(words(10) for _ in range(rng.randrange(8, 40))), "en", "s") for i in range(150)]
    run = words(15)
    rows += [(1000, "\n".join(f"{words(9)}\nnext\nnext" for _ in range(20)), "en", "s"), (1001, " ".join([run, *[words(9) + " " + run for _ in range(5)], words(45)]), "en", "s"), (1002, words(20) + " a b c " + words(50) + " a b c", "en", "s")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000].n_dup_lines == 39 and got[1000].n_repeat_words == 0 and got[1001].n_dup_lines == 0 and got[1001].n_repeat_words == 90
    assert not any(got[i].base_failed or got[i].kept for i in (1000, 1001))
    assert got[1002].kept and sum(not got[i].kept for i in range(150)) <= 1


def test_small_groups_are_judged_by_their_language_or_all_texts(spark):
    rng = random.Random(9)
    words = lambda n, mark="": " ".join("".join(rng.choices("abcdefghij", k=rng.choice((3, 5, 8)))) + mark for _ in range(n))
    rows = [(i, words(rng.randrange(60, 900)), "en", f"s{i % 5}") for i in range(150)] + [(200 + i, words(200), "de", "large") for i in range(70)]
    rows += [(1000, words(200, "###"), "en", "s1"), (1001, words(200, "###"), "xx", None), (1002, words(200), "xx", None), (1003, words(200, "$$"), None, "s")]
    schema = "doc_id long, text string, lang string, source string"
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, schema)).collect()}
    assert all(r.distance is not None and not r.base_failed for r in got.values()) and len(got) == len(rows)
    assert not any(got[i].kept for i in (1000, 1001, 1003)) and got[1002].kept
    assert sum(not got[r[0]].kept for r in rows[:220]) <= 1
    alone = Q.judge(spark.createDataFrame(rows[:1], schema)).first()
    assert alone.kept and alone.distance == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = Q.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
