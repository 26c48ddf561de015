"""A corpus from raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.common import documents, labels, scratch, staged
from tablewright.llm.line_dedup import dedup_lines
from tablewright.llm.mixing import mix_documents
from tablewright.llm.near_dup import near_dedup
from tablewright.llm.packing import pack
from tablewright.llm.quality_rules import quality_filter
from tablewright.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules reject go."""
    return quality_filter(docs, labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line comes close to go; a document keeps its row."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources below their weight are repeated; none goes."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return pack(docs, vocabulary(), end_id=1)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenisation and the certified cutoffs have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next. A stage's own tables go when its result is written.

    Nulls, empty and very long texts, ties, repeated rows, several texts under one id, empty tables and further columns are each stage's operator's to define; a document
    with a null id passes the second and third stage. All stages but the last return the columns of ``documents``.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
