"""A pipeline over ``documents``: each stage takes what its predecessor kept, and its decisions take effect in what it returns.

All stages but the last return the columns of ``documents``. Every stage judges its own input only and keeps clean documents:

* language: texts without a letter, and texts that fit no learned language (score under ``LEAST_SCORE``), go; ``lang`` is as predicted.
* near copies: of each group of linked rows one with the smallest doc_id stays; rows of one doc_id and text are one.
* benchmark: documents that hold three quarters of an item's shingles go.
* secrets: every found secret is replaced in the text; all documents stay.
* mix: how many words of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, jaccard, langid, mixing, secrets
from evigraph.plans.scratch import materialize, small_side

LEAST_SCORE = 0.2


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = langid.identify(docs, F.lit(False)).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return judged.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are linked each for itself, so those without doc_id and repeated ones are too; rows without doc_id come last in their group.

    Of a group's rows with the smallest doc_id the one of least key stays. The key is a hash of (doc_id, text): equal rows are one.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    groups = jaccard.components(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    names = docs.select(key.alias("row_key"), "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    first = materialize(groups.join(names, "row_key").groupBy("component_id").agg(least.alias("m")).select(F.col("m.row_key").alias("kept_key")), "kept")
    kept = docs.join(small_side(first, jaccard.MAX_BROADCAST_IDS), key == F.col("kept_key"), "left_semi")
    # texts are shuffled to find equal rows only if some doc_id comes twice
    twice = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return kept.dropDuplicates(["doc_id", "text"]) if twice else kept


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secrets.fit(spark, secrets.example_findings(secrets.sample_texts(docs)))
    return secrets.redact(docs, model)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language", identify_languages),
    ("near copies", keep_one_of_each_group),
    ("benchmark", remove_benchmark),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: The language model and the forest cannot be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
