import re

from evigraph.llm import licenses as L


def shingles(text, width):
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs):
    out = []
    for a, b, text in L.TEMPLATES:
        width = min(5, shingles(text, 1)[0])
        own = shingles(text, width)[1]
        for d, t in docs:
            common = len(own & shingles(t, width)[1])
            if common >= 0.75 * len(own):
                out.append((d, a, f"{a}/{b}", common, len(own)))
    return sorted(out, key=str)


def test_table_and_edited_notices(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    notice = next(t for a, b, t in L.TEMPLATES if (a, b) == ("Apache-2.0", "notice"))
    lines = "\n".join(" * " + x for x in re.findall(r".{1,60}(?:\s|$)", notice))
    docs += [(100000, "w x y z " * 9000 + lines + " end"), (100001, notice.replace("compliance", "accordance").upper()), (100002, notice[: len(notice) // 2]), (100003, None), (100008, ""), (100004, "All  rights\n# RESERVED!"), (100005, "all rights, reserved all rights"), (100006, "rights reserved all"), (100007, "x " * 300 + L.MIT_TEXT.replace("\n", "\n// ")), (None, L.TEMPLATES[4][2]), (100001, notice)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = sorted(map(tuple, L.scan(df, L.templates(spark)).collect()), key=str)
    assert got == brute(docs) and {100000, 100001, 100004, 100005, 100007, None} <= {r[0] for r in got} and any(r[0] and r[0] < 1000 for r in got)
    assert L.scan(df.limit(0), L.templates(spark)).count() == 0 and L.scan(df, L.templates(spark).limit(0)).count() == 0
