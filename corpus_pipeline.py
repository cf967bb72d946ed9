"""From raw documents to packed batches: quality rules, near-duplicate removal, substring dedup, PII, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import _common, minhash_join, packing, pii, quality_rules, substring_dedup

TEXT, ID = "text", "doc_id"


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows a text that has changed."""
    return docs.select(*[F.length(TEXT).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do frequent lines of the others. A null or empty text is
    rejected; a null id or source is treated like any other value (null sources are one host); each row is judged by
    its own text, so repeated rows go or stay together. Further columns stay as they are; no rows give no rows."""
    cut = quality_rules.without_frequent_lines(docs).drop(TEXT, "removed_lines").withColumnRenamed("kept_text", TEXT)
    return _recounted(cut, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near duplicates stays; of rows that share id and text one.
    Rows without an id and null or empty texts stay. Rows that share an id only go or stay by their own text."""
    return minhash_join.without_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that stand earlier go; the text's own white space stays. Every row stays, a null text as an
    empty one; a row without an id loses nothing and takes nothing from others; rows that share an id are one
    document."""
    cut = substring_dedup.substring_dedup(docs, keep_white_space=True).drop(TEXT).withColumnRenamed("kept_text", TEXT)
    return _recounted(cut, docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets, overlapping ones one bracket. Every row stays; null and
    empty texts stay as they are, repeated rows get equal texts."""
    return _recounted(pii.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row: bucket, batch and slot. A null or empty text has a length of 0, a text longer than the
    budget a batch of its own; repeated rows and rows without an id each get a slot; ties go by length, then id."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("pii", personal_data),
    ("packing", packed),
]

#: Packing chooses its buckets by dynamic programming, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    _common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = _common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
