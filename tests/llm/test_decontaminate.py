import random
import re

from pyspark.sql import functions as F

from evigraph.llm import decontaminate as D


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, items):
    out = []
    for i, item in set(items):
        n, _ = shingles(item)
        if n:
            own = shingles(item, min(5, n))[1]
            for d, text in docs:
                common = len(own & shingles(text, min(5, n))[1])
                if common >= 0.75 * len(own):
                    out.append((d, i, common, len(own)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bands_keep_the_recall():
    j = 0.75 / 4.25
    assert 1 - (1 - j) ** D.bands() >= 0.9999 > 1 - (1 - j) ** (D.bands() - 1)


def test_whole_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(D.find(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_edited_passages_in_long_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_ITEMS", 7)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 3, 5, 9, 20, 33, 70, 200))))) for i in range(30)]
    docs = []
    for d in range(60):
        own = items[rng.randrange(30)][1].split()
        if d % 3 == 0 and len(own) > 20:
            own[len(own) // 2] = word()
        if d % 3 == 1:
            own = own[: len(own) // 2]
        own = [w.upper() for w in own]
        before = [word() for _ in range(rng.choice((0, 10, 3000)))]
        docs.append((d, "  \n".join([*before, *own, *[word() for _ in range(rng.choice((0, 40, 900)))]])))
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.find(ddf, idf)) == brute(docs, items)
    assert D.remove(ddf, idf).count() == 60 - len({r[0] for r in brute(docs, items)})


def test_edge_rows(spark):
    items = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, " "), (None, "alpha beta"), (4, "x y")]
    docs = [(1, None), (2, ""), (3, "zero one two three four five six"), (3, "alpha beta"), (None, "x Y z"), (7, "one two"), (3, "alpha beta")]
    ddf = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    idf = spark.createDataFrame(items, "item_id long, text string")
    assert got(D.find(ddf, idf)) == brute(docs, items)
    assert got(D.remove(ddf, idf).select("doc_id")) == got(spark.createDataFrame([(1,), (2,), (7,)], "a long"))
    assert D.find(ddf.limit(0), idf).count() == 0 and D.find(ddf, idf.limit(0)).count() == 0


def test_rows_are_removed_each_for_itself(spark):
    leak, clean = "one two three four five six seven eight nine ten", "eleven twelve thirteen fourteen fifteen sixteen seventeen"
    docs = spark.createDataFrame([(None, leak), (None, clean), (1, leak), (1, clean), (2, leak), (2, leak), (3, None)], "doc_id long, text string")
    for kind in ("smallint", "string", "decimal(10,0)", "binary"):
        items = spark.createDataFrame([("7", leak)], "item_id string, text string").select(F.col("item_id").cast(kind if kind != "binary" else "string").cast(kind).alias("item_id"), "text")
        assert sorted(map(tuple, D.remove(docs, items).collect()), key=str) == sorted([(None, clean), (1, clean), (3, None)], key=str)
