"""Documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, is written as Parquet and read again.

Null and empty texts fail the first stage's base rules, so later stages have none from it; each
handles them all the same, as its operator says. Rows without an id, repeated rows and
further columns, whatever their names, pass through the first four stages like any other.
Empty tables give empty ones.

Near-duplicates are removed at the similarity of 0.85 that ``op1`` is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import pii
from lamella.llm.catalog import table
from lamella.llm.decontamination import without_overlaps
from lamella.llm.near_duplicates import without_near_duplicates
from lamella.llm.packing import pack_documents
from lamella.llm.quality import kept_documents, learn
from lamella.llm.queries import byte_pairs
from lamella.llm.rows import hold


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the base rules nor the learned decision list reject."""
    return kept_documents(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows of one id are one document, null ids are copies of any equal text."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly passages removed. Null texts stay."""
    return without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; all rows stay."""
    return pii.redact(docs, pii.learn(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their sequence and offset; every row is a document of its own."""
    return pack_documents(docs, byte_pairs())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None  # learned rules, similarity components and tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = hold(stage(spark, docs, sf_dir), name)
    return docs
