"""The text pipeline: rules, classifier, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from placelab.llm import packing, quality, rules, simhash, suffixes
from placelab.llm.common import documents, held_out, public_pattern, public_path
from placelab.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score low go; the classifier learns from the labelled rows of the whole table."""
    model = quality.learn(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id.

    Near-duplicates differ in at most two bits, or share 0.8 of their runs of five words.
    """
    return simhash.keep_first(docs, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur twice or more go; ``n_chars`` follows."""
    return suffixes.remove(docs, size="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), public_pattern())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pack", pack),
]

#: The classifier, the suffix sort and the tokenizer have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/corpus-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}_{name}")
        docs = spark.read.parquet(path)
    return docs
