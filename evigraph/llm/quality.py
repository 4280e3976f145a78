"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Counts of each whole text are taken in one projection. Of texts that pass the base rules a vector of transformed statistics is
compared with its language and source: a minimum-covariance-determinant estimate (concentration steps from two starts, the smaller
determinant wins) gives centre and scatter of the closest three quarters, and a vector whose squared Mahalanobis distance is beyond
the chi-square cut is rejected. Scatter has a floor for each statistic, about the noise of one event in a short text, so that where a
statistic is constant a single symbol or repetition rejects nothing, but each statistic can cross the cut by itself. Groups of fewer
than ``LEAST_GROUP`` texts are compared with their language over all sources, or with all texts if the language has fewer too.

A concentration step is one grouped aggregate: moments by group and bin of the distance. The least bins that hold three quarters of
the group give the next estimate, so no group is sorted or gathered, however large. Statistics are whole thousandths, whose sums are
exact, so that results do not depend on the order of rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.plans.scratch import drop, materialize, small_side

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Names of the statistics with the least standard deviation that they are given. Where all others are average and a group is constant,
#: two equal lines of three and one repeated run in fifty words are within the cut; 40 % equal lines or 25 % repeated words are not.
STATISTICS = {"word_length": 0.08, "symbols": 0.35, "dup_lines": 0.4, "repeats": 0.09, "length": 0.5}
SCALE = 1000
CORE = 0.75
CUT = 0.999
STEPS = 5
LEAST_GROUP = 60
MAX_GROUPS = 100_000
D = len(STATISTICS)


def chi_square_cdf(x: float, d: int) -> float:
    """Of d degrees of freedom, by the series of the lower incomplete gamma function."""
    a, z = d / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, d) < p else (low, mid)
    return high


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text and more) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines; without the text.

    A null text counts as empty. Columns of these names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    own = [c for c in docs.columns if c not in ("text", *names)]
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(F.translate(text, WHITE[1:], " " * 5), " ", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    first = docs.select(*own, text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    w = F.col("_words")
    runs = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    length = F.length("_text")
    second = first.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        runs.alias("_runs"),
    )
    # of runs that are found twice the places, sorted; each covers its three words up to where the next begins
    placed = F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.withColumn("_placed", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), placed))
    p = F.col("_placed")
    again = F.filter("_placed", lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)))
    fourth = third.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return fourth.select(*own, *[c for c in names if c not in ("n_repeat_words",)], F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics in thousandths, of a text with a word."""
    n = F.greatest("n_words", F.lit(1))
    values = [F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(20 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n), F.log(n)]
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _group() -> Column:
    return F.xxhash64(F.col("lang").isNull(), "lang", F.col("source").isNull(), "source")


def _compared(base: DataFrame) -> DataFrame:
    """(g, c, parts) of each group of ``base`` (g, gl): the group c that its texts are compared with, and all groups they count in.

    c is the first of the group, its language and the whole table that has LEAST_GROUP rows; the whole table if none has.
    """
    groups = materialize(base.groupBy("g", "gl").agg(F.count("*").alias("n")), "groups")
    langs = groups.groupBy("gl").agg(F.sum("n").alias("nl"), F.min("n").alias("least"))
    few = langs.agg(F.min(F.when(F.col("least") < LEAST_GROUP, F.col("nl"))).alias("fewest"))
    own, lang, every = F.col("n") >= LEAST_GROUP, F.col("nl") >= LEAST_GROUP, F.xxhash64(F.lit("every"))
    parts = F.array(F.when(own, F.col("g")), F.when(lang & (F.col("least") < LEAST_GROUP), F.col("gl")), F.when(F.col("fewest") < LEAST_GROUP, every))
    out = groups.join(langs, "gl").crossJoin(F.broadcast(few))
    return materialize(out.select("g", F.when(own, F.col("g")).when(lang, F.col("gl")).otherwise(every).alias("c"), F.filter(parts, lambda x: x.isNotNull()).alias("parts")), "compared")


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count("*").alias("m"), *sums)


def _estimate(moments: DataFrame, *keep: str) -> DataFrame:
    """Centre m*, Cholesky factor l** of the scatter, and the log determinant, from moments; in units of the statistics."""
    floors = [v * v for v in STATISTICS.values()]
    m = F.col("m").cast("double")
    out = moments.select(*keep, *[(F.col(f"s{i}") / m / SCALE).alias(f"m{i}") for i in range(D)], *[(F.col(f"q{i}{j}") / m / SCALE**2 - F.col(f"s{i}") / m * F.col(f"s{j}") / m / SCALE**2).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)])
    for i in range(D):
        out = out.withColumn(f"c{i}{i}", F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) + floors[i])
    for i in range(D):
        for j in range(i + 1):
            inner = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
            left = reduce(lambda a, b: a - b, inner, F.col(f"c{i}{j}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}{j}"))
    return out.select(*keep, *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)], (2 * reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(D)])).alias("logdet"))


def _distance(rows: DataFrame) -> DataFrame:
    """Rows with x* and an estimate's columns, with d2."""
    for i in range(D):
        inner = [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)]
        left = reduce(lambda a, b: a - b, inner, F.col(f"x{i}") / SCALE - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", left / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(D)]))


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts of each group: medians with the quartiles' spread, and means with variances; both without correlations."""
    q = rows.groupBy("g").agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(D)], *[F.avg(f"x{i}").alias(f"a{i}") for i in range(D)], *[F.var_pop(f"x{i}").alias(f"v{i}") for i in range(D)])
    floors = list(STATISTICS.values())

    def start(s: int, centre, spread) -> DataFrame:
        off = [F.lit(0.0).alias(f"l{i}{j}") for i in range(D) for j in range(i)]
        on = [F.sqrt(spread(i) * spread(i) + floors[i] ** 2).alias(f"l{i}{i}") for i in range(D)]
        return q.select("g", F.lit(s).alias("s"), *[(centre(i) / SCALE).alias(f"m{i}") for i in range(D)], *off, *on, F.lit(0.0).alias("logdet"))

    one = start(0, lambda i: F.col(f"p{i}")[1], lambda i: (F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349 / SCALE)
    two = start(1, lambda i: F.round(f"a{i}"), lambda i: F.sqrt(F.round(f"v{i}")) / SCALE)
    return one.unionByName(two)


def estimates(rows: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """(g, m*, l**, logdet) of each group of ``rows`` (g, x*) with ``least`` rows at least."""
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") >= least), "sizes")
    large = rows.join(small_side(sizes, MAX_GROUPS), "g")
    now = materialize(_starts(large), "starts")
    for _ in range(STEPS):
        at = _distance(rows.select("g", *[f"x{i}" for i in range(D)]).join(small_side(now, MAX_GROUPS), "g")).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 64))
        bins = _moments(at, "g", "s", "bin").join(small_side(sizes, MAX_GROUPS), "g")
        before = F.coalesce(F.sum("m").over(Window.partitionBy("g", "s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        core = bins.withColumn("before", before).where(F.col("before") < F.ceil(F.col("size") * CORE))
        total = core.groupBy("g", "s").agg(*[F.sum(c).alias(c) for c in bins.columns if c[0] in "mq" or c[0] == "s" and c not in ("s", "size")])
        following = materialize(_estimate(total, "g", "s"), "estimates")
        drop(now)
        now = following
    best = now.groupBy("g").agg(F.min(F.struct(F.round("logdet", 9), "s")).alias("b"))
    return materialize(now.join(best.select("g", F.col("b.s").alias("s")), ["g", "s"]).drop("s"), "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """Counts of each row of ``docs`` (doc_id, text, lang, source) with base_failed, kept and distance (squared; null if not taken).

    Null languages and sources are groups of their own. A row is kept if the base rules pass and its distance is within the cut;
    every row that passes the base rules has one. Rows are judged each for itself, repeated ones alike; extra columns are not carried.
    """
    rows = counts(docs.select("doc_id", "lang", "source", "text")).withColumn("base_failed", base_failed())
    rows = materialize(rows.select("*", _group().alias("g"), F.xxhash64(F.lit("lang"), F.col("lang").isNull(), "lang").alias("gl"), *statistics()), "counts")
    base = rows.where(~F.col("base_failed"))
    compared = small_side(_compared(base), MAX_GROUPS)
    found = estimates(base.join(compared, "g").select(F.explode("parts").alias("g"), *[f"x{i}" for i in range(D)]), 1)
    shrink = chi_square_cdf(chi_square_quantile(CORE, D), D + 2) / CORE
    cut = chi_square_quantile(CUT, D) / shrink
    measures = materialize(compared.select(F.col("g").alias("group"), F.col("c").alias("g")).join(found, "g").drop("g").withColumnRenamed("group", "g"), "measures")
    judged = _distance(rows.join(small_side(measures, MAX_GROUPS), "g", "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2") * shrink)
    kept = ~F.col("base_failed") & (F.col("d2") <= cut)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"))
