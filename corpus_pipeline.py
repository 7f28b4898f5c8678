"""The corpus pipeline: from documents to packed training windows.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pastframe.llm import line_dedup, packing, quality, simhash_dedup
from pastframe.llm.common import shared_folder, table
from pastframe.llm.tokens import vocabulary_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are kept, as no labeller speaks of them; an empty table stays empty."""
    return quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without repeats of lines that many sources carry. Null texts stay null; of repeated rows each is cleaned."""
    return line_dedup.dedup_lines(docs).select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash and exact similarity: the smallest doc_id. Texts without words are one group; rows without a doc_id stay."""
    return simhash_dedup.drop_simhash_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in context windows. A null or empty text is its end id alone; a long one is cut into several pieces."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("quality", good), ("line_dedup", lines), ("near_dedup", distinct), ("packing", packed)]

# Training, similarity joins and a tokenizer aren't SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns goes through Parquet in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
