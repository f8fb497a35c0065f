"""The corpus pipeline: documents that are not toxic, without repeated lines and near duplicates, mixed to target weights and packed.

Every stage but the last returns the columns of its input, whatever their names, and an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import mixing, toxicity
from edgeloom.llm.common import table, written
from edgeloom.llm.jaccard_join import jaccard_components
from edgeloom.llm.line_dedup import dedup_lines
from edgeloom.llm.packing import pack


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half. A null or empty text scores the share of toxic labels, so it stays unless most labels are toxic; rows alike stand or fall together."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller doc_id holds; n_chars follows; a document that loses all its words with them goes.

    A document that loses no line stays as it is, also a null or blank one; rows of one doc_id count as one document, rows without a doc_id lose nothing.
    """
    kept = dedup_lines(docs)
    left = kept.filter(r"n_dropped = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that five-word shingles link at a similarity of 0.8.

    Rows of one doc_id are one document and stand or fall together; rows without words or without a doc_id stay.
    """
    groups = jaccard_components(docs, k=5, num=80, den=100).select(F.col("doc_id").alias("__id"), "component_id").distinct()
    others = groups.filter("__id <> component_id").select("__id")
    return docs.join(others, docs["doc_id"].cast("long") == others["__id"], "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole; rows without words are never taken, rows alike share their copies evenly, a null source is a source of its own."""
    return mixing.repeated(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null text is an empty one and yields its end token, rows alike are packed one by one."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training, dual steps and tokens are beyond SQL; tests/llm/test_stages.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
