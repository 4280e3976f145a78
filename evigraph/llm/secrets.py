"""Secret scanning: pattern candidates, then a random forest that removes false positives.

Candidates are the maximal runs of ``[A-Za-z0-9+/_-]`` of 16 characters or more with up to two ``=`` behind, values of any length that
are assigned to a secret-like name, bodies of private keys, signed tokens of base64 parts joined by points, and passwords within URLs;
those that overlap are one. An assigned value in quotes ends at the closing quote of its line, any other at a blank, quote or one of
``<>&|,;``. A key's body ends at the end line of the same label, whatever stands in between, PGP blocks too. A URL's password ends at the
last ``@`` before a blank, ``"``, ``<``, ``>`` or the next ``://``. Of each the forest sees length, character classes and their changes, the mean log probability of its
character transitions, its entropy, how much of it dictionary words cover, and what stands beside it: paths, quotes, an assignment,
secret-like and harmless words. Transition probabilities and the dictionary come from the labelled findings' own texts.

Candidates and features are made in the tasks that read the texts; the forest is Spark ML's and runs in the JVM. Only candidates are
carried on, never texts.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import words as W
from evigraph.plans.scratch import materialize, small_side

SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "client_secret")
HARMLESS_NAMES = ("commit", "sha", "digest", "checksum", "md5", "uuid", "etag", "hash", "image", "example", "version", "isbn", "card", "order", "revision", "font")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ASSIGNED = re.compile(
    r"(?:%s)[\"']?\s*+[:=]\s*+(?:\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|[\"']?([^\s\"'<>&|,;]++))" % "|".join(map(re.escape, SECRET_NAMES)),
    re.I,
)
KEY_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]+){1,2}")
URL_PASSWORD = re.compile(r"://[^\s/:@]*+:((?:(?!://)[^\s\"<>])+)@")
#: Characters of the text on either side that a finding carries.
SIDE = 40
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/=_-. "
PLACE = {c: i for i, c in enumerate(SYMBOLS)}
MAX_SPANS = 200_000


@dataclass(frozen=True)
class Language:
    """What candidates are compared with."""

    transitions: np.ndarray
    dictionary: frozenset[str]


def learn_language(texts: list[str], most_words: int = 4000) -> Language:
    counts = np.ones((len(SYMBOLS), len(SYMBOLS)))
    words: Counter[str] = Counter()
    for text in texts:
        low = text.lower()
        at = [PLACE.get(c, len(SYMBOLS) - 1) for c in low]
        np.add.at(counts, (at[:-1], at[1:]), 1)
        words.update(w for w in re.findall(r"[^\W\d_]{3,12}", low))
    often = sorted((w for w, n in words.items() if n > 1), key=lambda w: (-words[w], w))[:most_words]
    return Language(np.log2(counts / counts.sum(1, keepdims=True)), frozenset(often))


def key_bodies(text: str) -> list[tuple[int, int]]:
    """What stands between each key's begin line and the next end line of the same label; a key without one is none."""
    out, opened = [], {}
    for m in KEY_LINE.finditer(text):
        if m[1] == "BEGIN":
            opened.setdefault(m[2], m.end())
        elif (begin := opened.pop(m[2], None)) is not None and begin < m.start():
            out.append((begin, m.start()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Begin and end of each candidate, none within another, in order."""
    spans = {m.span() for p in (RUN, SIGNED) for m in p.finditer(text)} | {m.span(1) for m in URL_PASSWORD.finditer(text)}
    spans |= {m.span(m.lastindex) for m in ASSIGNED.finditer(text)} | set(key_bodies(text))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(found: str, left: str, right: str, language: Language) -> list[float]:
    n, low = len(found), found.lower()
    kinds = [_kind(c) for c in found]
    at = [PLACE.get(c, len(SYMBOLS) - 1) for c in low]
    transition = float(language.transitions[at[:-1], at[1:]].mean()) if n > 1 else 0.0
    share = [c / n for c in Counter(found).values()]
    covered, k = 0, 0
    while k < n:
        size = next((s for s in range(min(12, n - k), 2, -1) if low[k : k + s] in language.dictionary), 0)
        covered += size
        k += size or 1
    before, around = left.lower(), (left[-SIDE:] + " " + right[:SIDE]).lower()
    return [
        float(min(n, 256)), sum(k == 0 for k in kinds) / n, sum(k == 1 for k in kinds) / n, sum(k == 2 for k in kinds) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, transition, -sum(p * math.log2(p) for p in share), covered / n,
        float(found.count("/") + found.count("\\")), float(bool(re.search(r"[/\\.]$|https?:|www\.", left[-SIDE:]))), float(bool(re.search(r"^\.[a-z]{2,4}\b|^/", right))),
        float(bool(re.search(r"[:=]\s*[\"']?$", left))), float(left[-1:] in ("'", '"') and right[:1] == left[-1:]),
        float(any(w in before[-SIDE:] for w in SECRET_NAMES)), float(any(w in around for w in HARMLESS_NAMES)),
        float(all(c in "0123456789abcdefABCDEF" for c in found)),
    ]


def example_findings(texts: list[str], n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(found, left, right, label) made by rule from prose, for tables that come without labelled findings.

    Half are secrets: random hex, base64 and keys with public prefixes, four fifths of them assigned to a secret-like name, one in
    eight a private key's body (some encrypted, some PGP blocks), a signed token or a password in a URL, and one in eight a password
    that is assigned. The others are words, phrases in quotes, long words and joined words of the prose, paths, addresses, ports,
    numbers, identifiers, and digests that are named as such.
    """
    rng = random.Random(seed)
    prose = [t.split() for t in texts if t and len(t.split()) > 20] or [["word"] * 30]
    hexed, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    some = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))

    def beside() -> str:
        own = rng.choice(prose)
        at = rng.randrange(len(own) - 8)
        return " ".join(own[at : at + 8])

    def joined(sep: str) -> str:
        words = re.findall(r"\w+", " ".join(beside() for _ in range(3)))
        return sep.join(words)[: rng.randrange(18, 60)].strip(sep) or "word" * 5

    out = []
    for i in range(n):
        left, right = beside() + " ", " " + beside()
        if i % 2:
            if i % 16 == 1:
                case = rng.randrange(3)
                if case == 0:
                    kind = rng.choice(("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK"))
                    head = rng.choice(("", "", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{some(hexed.upper(), 32)}\n\n", "Version: 2\n\n"))
                    left, right = f"{left}-----BEGIN {kind}-----", f"-----END {kind}-----{right}"
                    found = "\n" + head + "\n".join(some(b64, 64) for _ in range(rng.randrange(2, 26))) + "\n"
                elif case == 1:
                    found = ".".join(("eyJ" + some(b64[:62], rng.randrange(17, 40)), "eyJ" + some(b64[:62], rng.randrange(30, 120)), some(b64[:62] + "-_", 43)))
                    left += rng.choice(("", "Authorization: Bearer ", "jwt="))
                else:
                    scheme = rng.choice(("postgres", "mysql", "redis", "amqp", "https"))
                    left, right = f"{left}{scheme}://{rng.choice(('app', 'root', 'svc', ''))}:", f"@{rng.choice(('db', 'cache', '10.0.0.7'))}:5432/x{right}"
                    found = some(b64[:62] + "!#$%@/", rng.randrange(6, 24))
                out.append((found, left, right, 1))
                continue
            if i % 16 == 3:
                quote = rng.choice(('"', "'"))
                found = some(b64[:62], rng.randrange(2, 16)) + some("0123456789$*#%!.^", rng.randrange(2, 6)) + some(b64[:52], rng.randrange(1, 5))
                if rng.random() < 0.3:
                    found = re.sub(r"\W", "", joined(""))[: rng.randrange(4, 9)] + some("$*#%!&;,", 2) + some(b64[52:62], rng.randrange(2, 6))
                out.append((found, left + rng.choice(SECRET_NAMES) + rng.choice((" = ", "=", ": ", ":", "      = ")) + quote, quote + right, 1))
                continue
            found = rng.choice((some(hexed, rng.choice((32, 40, 64))), some(b64, rng.randrange(20, 64)), "AKIA" + some(b64[:26] + "234567", 16), rng.choice(("ghp_", "sk-", "xoxb-")) + some(b64[:62], 36), some(b64[:62] + "-_", rng.randrange(20, 48))))
            if rng.random() < 0.8:
                quote = rng.choice(('"', "'", ""))
                left += rng.choice(SECRET_NAMES) + rng.choice((" = ", "=", ": ", ":")) + quote
                right = quote + right
            out.append((found, left, right, 1))
            continue
        case = rng.randrange(10)
        if case == 7:
            quote = rng.choice(('"', "'", ""))
            found, left, right = rng.choice(beside().split()), left + rng.choice(SECRET_NAMES) + rng.choice((": ", " = ", "=", ":")) + quote, quote + right
        elif case == 8:
            quote = rng.choice(('"', "'"))
            found, left, right = " ".join(beside().split()[: rng.randrange(2, 9)]), left + rng.choice(SECRET_NAMES) + rng.choice((": ", " = ")) + quote, quote + right
        elif case == 9:
            found = f"{rng.randrange(80, 65536)}/{joined(rng.choice('-/_'))}"
            left, right = f"{left}{rng.choice(('http', 'https', 'ftp'))}://{joined('.')}:", rng.choice(("@", "@v")) + str(rng.randrange(9)) + right
        elif case == 0:
            found = joined("")
        elif case == 1:
            found = joined(rng.choice("-_/"))
        elif case == 2:
            found, left = some("0123456789", rng.randrange(16, 24)), left + rng.choice(("", "order ", "card ", "isbn "))
        elif case == 3:
            found, left = joined("/"), left + rng.choice(("/usr/", "https://www.", "./"))
        elif case == 4:
            found, left = some(hexed, rng.choice((32, 40, 64))), left + rng.choice(HARMLESS_NAMES[:8]) + rng.choice((" ", ": "))
        elif case == 5:
            found, left = joined(rng.choice(("", "_"))), left + rng.choice(SECRET_NAMES) + rng.choice((": ", " = "))
        else:
            found = rng.choice(("-", "=", "_", "/")) * rng.randrange(16, 60)
        out.append((found, left, right, 0))
    return out


@dataclass(frozen=True)
class SecretModel:
    language: Language
    forest: RandomForestClassificationModel


def fit(spark: SparkSession, findings: list[tuple[str, str, str, int]], trees: int = 40, depth: int = 8) -> SecretModel:
    """A forest from labelled findings (found, left, right, label 0 or 1); they are a bounded list and must hold both labels."""
    language = learn_language([f"{left} {found} {right}" if not label else f"{left} {right}" for found, left, right, label in findings])
    usable = [x for x in findings if x[0]]
    # an Arrow table becomes local rows of the plan; a list would start a second set of Python workers on the executors
    rows = pa.table({"f": pa.array([features(*x[:3], language) for x in usable], pa.list_(pa.float64())), "label": pa.array([float(x[3]) for x in usable], pa.float64())})
    train = spark.createDataFrame(rows).coalesce(1).select(array_to_vector("f").alias("features"), "label")
    # the copy has no summary of its training, which would send the session along to the tasks
    return SecretModel(language, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(train).copy())


def labelled_findings(table: DataFrame, most: int = 20_000) -> list[tuple[str, str, str, int]]:
    """Rows for :func:`fit` of a table of labelled findings (found, left, right, label): of each label ``most`` by a hash, the same in
    every run. Null sides are empty; rows without ``found`` or with a label other than 0 and 1 are left out. Extra columns are not read.
    """
    own = table.select("found", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"), F.col("label").cast("int").alias("label"))
    own = own.withColumn("h", F.xxhash64("found", "left", "right")).where(F.length("found") > 0)
    rows = [r for label in (0, 1) for r in own.where(F.col("label") == label).orderBy("h", "found", "left", "right").limit(most).collect()]
    return [(r.found, r.left, r.right, r.label) for r in rows]


def sample_texts(docs: DataFrame, most: int = 400) -> list[str]:
    """About ``most`` texts, the same in every run, chosen by a hash of doc_id and text; 4000 characters of each, for :func:`example_findings` only."""
    known, unit = docs.where("text IS NOT NULL").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"), "text"), 1 << 30
    n = known.count()
    rows = known.where(F.col("h") < min(unit, unit * most // max(n, 1))).select("h", F.substring("text", 1, 4000).alias("text")).orderBy("h", "text").limit(2 * most).collect()
    return [r.text for r in rows]


def scan(docs: DataFrame, model: SecretModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, begin, end, found, score, row_hash) for each secret of each row of ``docs`` (doc_id, text).

    Positions count characters from 0, end exclusive. Null and empty texts hold nothing; whole texts are scanned; repeated rows give
    repeated findings. row_hash names the row's (doc_id, text). Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.language)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = shared.value
        for batch in batches:
            for chunk in W.chunks(batch):
                rows, out = [], []
                for i, text in enumerate(chunk.column(2).to_pylist()):
                    for a, b in candidates(text or ""):
                        found = text[a:b]
                        rows.append(i)
                        out.append((a, b, found, features(found, text[max(0, a - SIDE) : a], text[b : b + SIDE], language)))
                if rows:
                    a, b, found, f = zip(*out)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([chunk.column(0).take(at), chunk.column(1).take(at), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.string()), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "row_hash", "begin", "end", "found", "f"])

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    found = keyed.mapInArrow(W.returning(run), f"doc_id {id_type}, row_hash long, begin long, end long, found string, f array<double>")
    scored = model.forest.transform(found.withColumn("features", array_to_vector("f")))
    return scored.select("doc_id", "begin", "end", "found", vector_to_array("probability")[1].alias("score"), "row_hash").where(F.col("score") >= threshold)


def redact(docs: DataFrame, model: SecretModel, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; n_chars, if there is one, is set anew where a text changed."""
    spans = scan(docs, model).groupBy("row_hash").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    spans = small_side(materialize(spans, "spans"), MAX_SPANS)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("upto"))

    def step(acc, s):
        between = F.substring(F.col("text"), (acc["upto"] + 1).cast("int"), (s["begin"] - acc["upto"]).cast("int"))
        return F.struct(F.concat(acc["done"], between, F.lit(mark)).alias("done"), s["end"].alias("upto"))

    def end(acc):
        return F.concat(acc["done"], F.substring(F.col("text"), (acc["upto"] + 1).cast("int"), F.length("text")))

    key = F.xxhash64("doc_id", "text")
    joined = docs.withColumn("row_hash", key).join(spans, "row_hash", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step, end))
    out = joined.withColumn("new_text", text)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("new_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("new_text").cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            columns.append(F.col(c))
    return out.select(columns)
