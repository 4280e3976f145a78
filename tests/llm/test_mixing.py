import hashlib
import math
import re

from pyspark.sql import functions as F

from evigraph.llm import mixing as M


def fill(sizes):
    """By rounds: give shares by weight, fix what is above its cap, share the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, fixed = {}, {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        target = fixed | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        fixed |= {s: 3 * sizes[s] for s in over}


def brute(rows, seed=M.SEED):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = fill(sizes)
    out, at = [], dict.fromkeys(sizes, 0)
    for d, t, s in sorted(rows, key=lambda r: (hashlib.md5(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), size(r[1]))):
        n, stop = size(t), math.floor(target[s] + 1e-9)
        taken = sum(max(0, min(at[s] + e * sizes[s] + n, stop) - (at[s] + e * sizes[s])) for e in range(3))
        at[s] += n
        out.append((d, s, n, sizes[s], round(target[s], 4), taken))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:4], round(r.target, 4), r.taken) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = M.mix(docs)
    assert got(out) == brute(list(map(tuple, docs.collect())))
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect():
        assert abs(r.t - r.target) <= 1
    assert out.where("taken > 3 * size").count() == 0


def test_pieces_follow_the_schedule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = M.pieces(docs, block=32).where("slot IS NOT NULL").groupBy("slot").agg(F.countDistinct("sid").alias("sources"), F.sum(F.col("last") - F.col("first")).alias("words"), F.min("sid").alias("sid"), F.min("target").alias("target")).orderBy("slot").collect()
    assert all(r.sources == 1 and r.words <= 32 for r in rows)
    assert sum(r.words < 32 for r in rows) <= len({r.sid for r in rows})
    total = sum({r.sid: r.target for r in rows}.values())
    half = rows[: len(rows) // 2]
    for sid, target in {r.sid: r.target for r in rows}.items():
        assert abs(sum(r.sid == sid for r in half) - len(half) * target / total) <= 6


def test_caps_nulls_and_ties(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(40)] + [(100, "x " * 2, None), (100, "x " * 2, None), (None, "y", "b"), (None, None, "a"), (7, "", "zero"), (8, "q " * 50000, "long"), (1, "w", "a")]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, size int, taken int")
    assert got(M.mix(docs, block=8)) == brute(rows)
    assert got(M.mix(docs.repartition(5), block=8)) == got(M.mix(docs, block=8))
    assert M.mix(docs.limit(0)).count() == 0
    blank = M.mix(docs.where("source = 'zero'")).collect()
    assert [(r.doc_id, r.target, r.taken) for r in blank] == [(7, 0.0, 0)]
