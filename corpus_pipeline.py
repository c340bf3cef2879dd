"""A corpus pipeline over ``documents``: each stage applies one operator to all rows its predecessor kept.

Every stage is written as Parquet in the shared folder and read again, so a lost executor costs at most one stage.

Defined cases: null text and empty text have no words and fail the quality rules; null language and null source are values
of their own; repeated rows are separate rows until the join stage, which keeps one of them; ties go as the operators state;
an empty table gives an empty result; all stages but the last return the columns they were given, whatever their names, with
their values (the line stage changes ``text``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, jaccard_join, line_dedup, mixing, quality_rules
from tidemark.llm.common import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rules and by cutoffs certified on the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept_rows(docs, labels)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines found on many sites, whatever their length; a document left without a word by that goes."""
    return line_dedup.cleaned_rows(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text again."""
    ranks, pattern = byte_bpe.local_vocabulary()
    coded = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "source", "text"), ranks, pattern), ranks, pattern)
    same = F.col("raw") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", join_stage),
    ("source_mixing", mix_stage),
    ("byte_bpe", token_stage),
]

#: Components of a similarity join, a random-key mix and token ids have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    folder = f"{scratch(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
