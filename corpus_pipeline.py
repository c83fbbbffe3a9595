"""The corpus pipeline: quality, line dedup, near-duplicates, repeated passages, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. A
document's id may be missing; rows that repeat an id are kept or dropped together by the two stages that judge ids.
A missing or empty text that the first stage keeps stays, since nothing is removed from it, and takes one token in the last; a text
of which a stage removes all words goes. An empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, line_dedup, near_dedup, packing, quality_classifier, substring_dedup

#: Words of a passage that is removed where it repeats.
PASSAGE_WORDS = 50
#: Rows of later stages can't be expressed in SQL: the first stage samples with a fitted model, the last solves a program.
ORACLE_SQL = None


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose ids `kept` holds."""
    ids = kept.filter("kept").select(common.key_of("doc_id").alias("_kept_key")).distinct()
    return docs.join(ids, common.key_of(docs["doc_id"]) == F.col("_kept_key"), "left_semi")


def _with_text(docs: DataFrame, changed: DataFrame, removed: str) -> DataFrame:
    """`changed` with the columns of `docs`: documents of which nothing is left go, n_chars follows the text."""
    left = changed.filter((F.col(removed) == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labelled text keeps."""
    return _only(docs, quality_classifier.resample(docs, common.table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long lines and of runs of two or more lines are cut out; a document of which nothing is left goes."""
    return _with_text(docs, line_dedup.dedup_lines(docs), "n_removed_lines")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return _only(docs, near_dedup.near_duplicates(docs))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words and more that a document of a smaller id has are cut out."""
    return _with_text(docs, substring_dedup.remove_repeats(docs, PASSAGE_WORDS), "n_removed")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 4,096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", passage_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet and read again as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), name)
        common.release(spark)
    return docs
