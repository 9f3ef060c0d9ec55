"""The corpus pipeline: language, fuzzy lines, near-duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. Each
works on all rows its predecessor kept, and models are fitted on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import language_id, line_dedup, near_dedup, packing, secret_scan
from leafwright.llm.common import forget, scope, written


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go: null texts, those without a letter, and all if nothing was learned. Rows may repeat, ids be null; an empty table gives none."""
    return language_id.accepted(docs, language_id.train(docs.where(~language_id.held_out())))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one nearly or exactly. A text can become empty; an empty table gives no rows."""
    return _counted(line_dedup.deduplicated(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id (null ids last); all empty texts are one class. An empty table gives no rows."""
    return near_dedup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in the place of each secret. Null texts stay null; an empty table gives no rows."""
    return _counted(secret_scan.redact(docs, secret_scan.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows. Null texts count as empty and pack as their closing token; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL can't express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all windows, from ``documents``; the result of each stage is written and read again, and goes when the one after it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope() as keep:  # with the stage's own tables
            last, docs = docs, keep(written(stage(spark, docs, sf_dir), name))
        if hasattr(last, "_written_path"):
            forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
