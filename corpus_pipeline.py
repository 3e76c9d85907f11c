"""A training corpus from raw documents: five stages, each written and read again.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
stage's documents, the last one the packed pieces. ``run(spark, sf_dir)`` applies them to
``documents``. Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefeed.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from rolefeed.session import shared_dir


# Executors run several Python workers beside a full heap, so what is sent to one at a time is small.
BATCH_BYTES = "8m"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _measured(changed: DataFrame, columns: list[str]) -> DataFrame:
    """``changed`` with ``n_chars`` of its new texts, if there is such a column."""
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(changed.schema["n_chars"].dataType))
    return changed.select(*columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; others go. It learns from ``labels``."""
    _small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate on their source."""
    return _measured(line_dedup.drop_boilerplate(docs), docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    _small_batches(spark)
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of test items."""
    _small_batches(spark)
    cut = decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _measured(cut, docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

# A classifier's floats and a tokenizer's ids have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for place, (_, stage) in enumerate(STAGES):
        path = f"{base}/stage{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
