import re

from pyspark.sql import SparkSession

import corpus_pipeline as P
from evigraph.llm import langid, secrets
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_mixing import brute as mix
from tests.llm.test_mixing import got as mixed


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(P.STAGES)
    columns = docs.columns

    def stage(name, df, k):
        out = steps[name](spark, df, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    one = stage("language", docs, 0)
    assert one.columns == columns
    assert set(rows(docs)) - set(rows(one)) == {(d, t) for d, t in rows(docs) if not re.search(r"[^\W\d_]", t or "")}
    two = stage("near copies", one, 1)
    assert two.columns == columns and sorted(r[0] for r in rows(two)) == sorted({d for d, _, c in groups(rows(one)) if d == c})
    three = stage("benchmark", two, 2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert three.columns == columns and {r[0] for r in rows(three)} == {r[0] for r in rows(two)} - {r[0] for r in leaks(rows(two), items)}
    four = stage("secrets", three, 3)
    assert four.columns == columns and four.count() == three.count()
    after = dict(rows(four))
    for d, t in rows(three):
        if "token = " in t:
            assert not re.search(r'token = "[0-9a-f]{40}"', after[d])
        elif not re.search(r"[0-9A-Za-z+/_-]{16,}", t):
            assert after[d] == t
    assert mixed(P.mix_sources(spark, four, sf_dir)) == mix([(r.doc_id, r.text, r.source) for r in four.collect()])
    assert mixed(P.run(spark, sf_dir)) == mixed(P.mix_sources(spark, four, sf_dir))


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, "the house of the lord is near to us", "en", "a", 3), (1, "the house of the lord is near to us", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "der mann und die frau gehen nach haus", "de", None, 1), (4, "12 34", "de", "b", 5)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, f in P.STAGES[:-1]:
            docs = f(spark, docs, sf_dir)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() == (2 if data else 0)
        assert P.mix_sources(spark, docs, sf_dir).count() == (2 if data else 0)


def test_near_copies_go_row_by_row(spark, sf_dir):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    data = [(5, text(0)), (None, text(0) + " end"), (None, text(1)), (None, text(1) + " end"), (None, text(2)), (7, text(3)), (7, text(0) + " more"), (8, text(3)), (9, text(4)), (9, text(5)), (9, text(5))]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(rows(P.keep_one_of_each_group(spark, docs, sf_dir)), key=str)
    null = [t for d, t in got if d is None]
    assert len(null) == 2 and text(2) in null and {text(1), text(1) + " end"} & set(null)
    assert [r for r in got if r[0] is not None] == [(5, text(0)), (7, text(3)), (9, text(4)), (9, text(5))]


def test_models_are_fitted_without_python_rdds(spark, monkeypatch):
    """A list becomes a Python RDD, whose workers stay on the executors beside those of the stages."""
    made, create = [], SparkSession.createDataFrame
    docs = spark.createDataFrame([(i, f"text {i} of some words", "en" if i % 3 else "de") for i in range(60)], "doc_id long, text string, lang string")
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, *a, **b: made.append(df := create(self, *a, **b)) or df)
    langid.fit(docs, max_train=20, landmarks=8)
    secrets.fit(spark, secrets.example_findings([], 200), trees=3)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    assert len(plans) >= 2 and all("LocalTableScan" in p for p in plans)
