"""A training-data pipeline over ``documents``: quality rules, exact dedup, near dedup, source mixing, tokens.

Each stage works on all rows that its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, exact_dedup, mixing, quality_rules, simhash_dedup
from panelspark.llm.common import shared_folder
from panelspark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the limits of their language and source."""
    return quality_rules.quality(docs).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text up to white space, the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more), the one with the smallest id."""
    return simhash_dedup.drop_near_copies(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, every one at least once, block after block."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every taken document with its token ids, and whether they decode to the text again."""
    encoded = bpe.round_trip(docs.withColumn("text", F.coalesce("text", F.lit(""))), tokenizer(), "doc_id", "source", "text")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("BPE tokens", tokens)]

#: SimHash fingerprints (XXH64) and BPE have no counterpart in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    Null and empty texts fail the quality rules. A null id counts as the largest, so a copy with an id stays instead; of
    rows that repeat an id and a text one stays. Null languages and sources are groups of their own. Texts of any length
    are worked on as a whole; columns that are not those of documents are left out. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
