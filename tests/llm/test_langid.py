import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evigraph.llm import langid
from evigraph.llm import words as W
from evigraph.llm.queries import op8_language_id


def grams(text):
    b = bytes(W.LOWER[np.frombuffer(text.encode(), np.uint8)])
    return {b[i : i + k] for k in range(1, langid.MAX_N + 1) for i in range(len(b) - k + 1)}


def test_presence_counts_match_sets():
    texts = ["abcabc", "", "é漢 zzzzz", "Ab" * 50]
    rows = np.zeros((4, langid.BUCKETS), np.float32)
    langid.presence(*W.string_bytes(pa.array(texts)), rows)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert rows[i] @ rows[j] == len(grams(a) & grams(b))


def test_scores_equal_the_kernel_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, max_train=80, landmarks=40)
    row = np.zeros((1, langid.BUCKETS), np.float32)
    text = docs.first().text
    langid.presence(*W.string_bytes(pa.array([text])), row)
    expected = (row @ model.weights)[0] / np.sqrt(len(grams(text))) + model.bias
    got = langid.predict(docs.limit(1), model).first()
    assert got.lang_pred == model.langs[int(expected.argmax())]
    assert abs(got.score - float(np.clip(expected.max(), 0, 1))) < 1e-4


def test_held_out_accuracy(spark, sf_dir):
    rows = op8_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95


def test_edge_rows(spark):
    train = [(i, t, k, "x") for i in range(20) for t, k in ((f"the house of the {i}", "en"), (f"der mann und die {i}", "de"))]
    odd = [(None, None, None, "y"), (1, "", "en", "y"), (2, "12 34 !!", "de", "y"), (3, "der mann " * 20000, None, "y"), (3, "der mann und", None, "y"), (3, "der mann und", None, "y")]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, score string")
    out = langid.identify(docs, F.lit(False))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == len(train) + len(odd)
    assert [r.lang_pred for r in rows if r.text in (None, "", "12 34 !!")] == ["und"] * 3
    assert {r.lang_pred for r in rows if r.text and r.text.startswith("der")} == {"de"}
    empty = docs.limit(0)
    assert langid.identify(empty, F.lit(False)).count() == 0
    nothing_learned = langid.identify(docs.where("score = 'y'"), F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in nothing_learned} == {("und", 0.0)}


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñ"
    name = lambda k: f"l{k:02}"
    rows = [(100 * k + i, f"{letters[k] * (3 + i)} {letters[k]}", name(k)) for k in range(34) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_train=40, landmarks=10)
    assert model.langs == [name(k) for k in range(34)]
    assert all(r.lang == r.lang_pred for r in langid.predict(docs, model).collect())
