"""A corpus pipeline of five stages, each one of the training-data operators at work on all that came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm import exact_dedup, minhash_dedup
from matchflow.llm.common import stored
from matchflow.llm.language_id import keep_identified, train
from matchflow.llm.packing import pack_documents
from matchflow.llm.secret_scan import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter or without a clear language go."""
    return keep_identified(docs, train(docs))


def exactly_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_one_of_each(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest id."""
    return minhash_dedup.keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a training sequence."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("exact_dedup", exactly_once),
    ("near_dedup", no_near_copies),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Naive Bayes, sketches and packing are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder and read back before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
