"""Manifests against a tree built level by level in plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evigraph.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H([field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(r["n_chars"]), field(text)])


def tree(leaves):
    """The root, and for each leaf its siblings (before, after) by level."""
    nodes, under, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        above, below = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in under[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(H(run))
            below.append(sum(under[at : at + 3], []))
        nodes, under = above, below
    return nodes[0], paths


def expected(rows, change):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        made[s] = own, *tree([leaf(r, r["text"]) for r in own])
    root, upper = tree([made[s][1] for s in order])
    out = []
    for s, up in zip(order, upper):
        own, subroot, paths = made[s]
        for r, path in zip(own, paths):
            folded = leaf(r, change(r))
            for before, after in path + up:
                folded = H([before, folded, after])
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, H([x for p in path + up for x in p]), folded, folded == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def cases():
    rows = [{"doc_id": i, "text": f"row {i}\nof é\n" * (i % 4), "lang": "en", "source": ("b", "a", None, "ä")[min(i % 7, 3)], "n_chars": i} for i in range(200)]
    rows += [{"doc_id": None, "text": t, "lang": None, "source": "a", "n_chars": None} for t in (None, "", "x\ny", "x\ny")]
    rows += [{"doc_id": 7, "text": "again", "lang": "de", "source": "a", "n_chars": 5}] * 2
    rows += [{"doc_id": 900, "text": "long \n" * 40_000, "lang": "en", "source": "lone", "n_chars": 0}, {"doc_id": 901, "text": "x", "lang": "", "source": "", "n_chars": 0}]
    return rows


@pytest.mark.parametrize("fan,partitions", [(64, 4), (2, 13), (3, 29)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, fan, partitions):
    monkeypatch.setattr(merkle, "FAN", fan)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = cases()
        df = table(spark, rows).withColumn("leaf", F.lit(1)).withColumn("part", F.lit("x")).withColumn("digest", F.lit(None).cast("string"))
        bad = F.col("doc_id") % 2 == 0
        got = merkle.manifest(df, received=F.when(bad, F.translate("text", "\n", "")).otherwise(F.col("text")))
        change = lambda r: r["text"].replace("\n", "") if r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["text"] is not None else r["text"]
        assert sorted_rows(got.collect()) == sorted_rows(expected(rows, change))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_proof_steps_fold_to_the_root(spark):
    rows = [{"doc_id": i, "text": str(i), "lang": "en", "source": "ab"[i % 2], "n_chars": i} for i in range(31)]
    for r in merkle.manifest(table(spark, rows), keep_steps=True).collect():
        steps = [(s.before, s.after) for s in r.steps]
        assert merkle.fold(r.leaf, steps) == r.root and r.verified
        assert merkle.joined([x for s in steps for x in s]) == r.proof_sha256


def test_one_row_is_its_own_root_and_an_empty_table_has_no_rows(spark):
    one = merkle.manifest(table(spark, [{"doc_id": 1, "text": None, "lang": None, "source": None, "n_chars": None}])).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in one] == [(one[0].leaf,) * 3 + (H([]), True)]
    assert merkle.manifest(table(spark, [])).collect() == []


def test_ids_may_be_text(spark):
    df = spark.createDataFrame([("b", "x", None, "s", 1), ("a", "y", None, "s", 1)], SCHEMA.replace("doc_id long", "doc_id string"))
    rows = {r.doc_id: r for r in merkle.manifest(df).collect()}
    assert rows["a"].root == H([rows["a"].leaf, rows["b"].leaf])
    assert all(r.verified for r in rows.values())
