"""From documents to sampled pieces: language, near-duplicates, personal data, source mix, segmentation.

Every stage but the last takes and returns rows with the columns of documents. Rows with null or empty texts, or texts
without a letter, have no language and go in the first stage. Other columns, repeated rows and empty tables are allowed.
Ties: of languages alike the one with more training texts, of near-duplicates the least doc_id, of overlapping spans the base
one; rows that repeat a doc_id and text are one row after the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import language_bitmask, minmax_dedup, piece_sampling, source_mix, span_crf
from shelfmark.llm.common import table, written


def small_batches(spark: SparkSession) -> None:
    """From now on Spark sends 1,024 rows to a Python worker at once: texts are long, and a batch of them is held by both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that the labelled ones teach."""
    small_batches(spark)
    return language_bitmask.with_language(docs, language_bitmask.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    small_batches(spark)
    return minmax_dedup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind in brackets."""
    small_batches(spark)
    return span_crf.redacted(docs, span_crf.fit(docs))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    small_batches(spark)
    return source_mix.mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, pieces, decoded_sha256, lossless) of every document."""
    small_batches(spark)
    return piece_sampling.encode(docs, check=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mixture", source_mixture), ("pieces", pieces)]

#: Trained filters, signatures and sampling aren't SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
