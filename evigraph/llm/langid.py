"""Language identification with a blended-spectrum presence kernel.

Two texts are as alike as the sets of their byte n-grams (n from 1 to ``MAX_N``, A-Z as a-z) overlap:
``k(x, y) = |x & y| / sqrt(|x| |y|)``, with n-grams hashed into ``BUCKETS`` places. Nyström landmarks turn the kernel into a
finite map and one-versus-rest kernel ridge regression fits a column of weights for each language. A batch of texts is scored by
one matrix product of its presence rows with ``landmarks.T @ weights``, which is the product with the kernel block taken in the
other order.

Memory of a task: a block of ``BLOCK`` presence rows and the weights, ``BUCKETS`` floats for each row or language. The fit sees about
``max_train`` labelled texts, or ``LEAST_TEXTS`` of each language where those are more; all languages are learned, and all documents are
scored over their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import words as W

MAX_N = 4
BUCKETS = 1 << 16
BLOCK = 64
LEAST_TEXTS = 4
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    #: BUCKETS x len(langs): the landmarks' presence by their regression weights.
    weights: np.ndarray
    bias: np.ndarray


def presence(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Set out[i, bucket] to 1 for each n-gram of text i."""
    n = len(data)
    code = np.zeros(n, np.uint32)
    data = W.LOWER[data].astype(np.uint32) + np.uint32(1)
    for k in range(1, MAX_N + 1):
        if n < k:
            break
        code = code[: n - k + 1] * np.uint32(0x01000193) + data[k - 1 :]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
        for i in range(len(offsets) - 1):
            if offsets[i + 1] - k + 1 > offsets[i]:
                out[i, bucket[offsets[i] : offsets[i + 1] - k + 1]] = 1


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    space = np.zeros((BLOCK, BUCKETS), np.float32)
    for chunk in W.chunks(batch):
        for at in range(0, chunk.num_rows, BLOCK):
            part = chunk.slice(at, BLOCK)
            rows = space[: part.num_rows]
            rows[:] = 0
            presence(*W.string_bytes(part.column(part.schema.get_field_index("text"))), rows)
            yield part, rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, rows in _blocks(batch):
            bits = [r.tobytes() for r in np.packbits(rows.astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary())], ["lang", "h", "bits"])


def fit(docs: DataFrame, max_train: int = 2400, landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    """A model from the rows of ``docs`` (text, lang, doc_id) whose text and lang are not null.

    About ``max_train`` rows are used, or ``LEAST_TEXTS`` times the number of languages if that is more: about equally many of each
    language as far as it has them, chosen by a hash of doc_id and lang, and one at least. ``landmarks`` of them, or one of each
    language if that is more, are the Nyström landmarks. No usable row gives a model without languages.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("doc_id", "lang").alias("h"), "text")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    langs, each = sorted(counts), max(LEAST_TEXTS, max_train // len(counts))
    # Arrow tables become local rows of the plan; lists would start a second set of Python workers on the executors
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "share": pa.array([min(1.0, each / counts[k]) for k in langs], pa.float64())}))
    chosen = known.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "h", "text")
    packed = lambda df: list(map(tuple, df.mapInArrow(W.returning(_packed), "lang string, h long, bits binary").collect()))
    rows = packed(chosen)
    missed = sorted(set(langs) - {r[0] for r in rows})
    if missed:
        left = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(missed, pa.string())}))
        rows += packed(known.join(F.broadcast(left), "lang").groupBy("lang").agg(F.min(F.struct("h", "text")).alias("m")).select("lang", "m.h", "m.text"))
    rows.sort(key=lambda r: (r[1], r[0], bytes(r[2])))
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    turn: dict[str, int] = {}
    places = []
    for i, r in enumerate(rows):
        turn[r[0]] = turn.get(r[0], 0) + 1
        places.append((turn[r[0]], i))
    marked = [i for _, i in sorted(places)[: max(landmarks, len(langs))]]
    # presence stays packed: shared n-grams are counted on bits, and no dense row is made but of a few landmarks at a time
    bits = np.frombuffer(b"".join(r[2] for r in rows), W.U).reshape(len(rows), -1)
    named = [r[0] for r in rows]
    del rows
    marks = bits[marked]
    size = np.sqrt(np.maximum(np.bitwise_count(bits).sum(1, dtype=np.int64), 1))
    kernel = np.stack([np.bitwise_count(b & marks).sum(1, dtype=np.int64) for b in bits]) / size[:, None] / size[marked]
    values, vectors = np.linalg.eigh(kernel[marked])
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    inputs = kernel @ whiten
    targets = np.array([[n == k for k in langs] for n in named], float)
    mean, bias = inputs.mean(0), targets.mean(0)
    inputs = inputs - mean
    solved = np.linalg.solve(inputs.T @ inputs + ridge * len(named) / max(1, keep.sum()) * np.eye(keep.sum()), inputs.T @ (targets - bias))
    by_mark = (whiten @ solved) / size[marked][:, None]
    weights = np.zeros((BUCKETS, len(langs)))
    for at in range(0, len(marked), 16):
        dense = np.unpackbits(marks[at : at + 16].view(np.uint8), axis=1)
        weights += dense.T @ by_mark[at : at + 16]
    return LanguageModel(langs, weights.astype(np.float32), bias - mean @ solved)


def predict(docs: DataFrame, model: LanguageModel, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with two more columns (replacing ones of these names): the language of each whole text and a score from 0 to 1.

    ``und`` with score 0: the text is null, empty or without a letter, or the model has no language. Equal scores go to the
    language that sorts first. Extra columns pass through; rows are independent, so repeated rows are repeated in the result.
    """
    docs = docs.drop(lang_col, score_col)
    spark, schema = docs.sparkSession, docs.schema
    weights = np.concatenate([model.weights, np.ones((BUCKETS, 1), np.float32)], axis=1)
    shared = spark.sparkContext.broadcast((model.langs, weights, model.bias))
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, bias = shared.value
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
            for part, rows in _blocks(named):
                product = rows @ weights
                fits = product[:, :-1] / np.sqrt(np.maximum(product[:, -1:], 1)) + bias
                letters = np.array([any(map(str.isalpha, t)) if t else False for t in part.column(at).to_pylist()]) & bool(langs)
                best = fits.argmax(1) if langs else np.zeros(len(rows), int)
                score = np.where(letters, np.clip(fits.max(1), 0, 1), 0.0) if langs else np.zeros(len(rows))
                names = [langs[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score.astype(float))], [*schema.fieldNames(), lang_col, score_col])

    out = docs.select("*", F.lit("").alias(lang_col), F.lit(0.0).alias(score_col)).schema
    return docs.mapInArrow(W.returning(run), out)


def part(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def identify(docs: DataFrame, held_out: Column, **fitted) -> DataFrame:
    """Language of every row of ``docs``, learned from those that are not held out."""
    model = fit(docs.where(~held_out), **fitted)
    return predict(docs, model)
