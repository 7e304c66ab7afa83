"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import crc_mod, materialize, table
from bramble.llm.decontamination import decontaminate
from bramble.llm.jaccard_join import keep_first
from bramble.llm.language_id import fit, keep_identified
from bramble.llm.line_dedup import drop_lines
from bramble.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the rows that have one; others, and those without letters, go."""
    return keep_identified(docs, fit(docs.where(crc_mod("doc_id", 3) != 1)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, short ones if they are the same, longer ones also if one word differs; so do documents of which nothing but white space is left."""
    found = drop_lines(docs)
    removed = found.columns[-1]
    return found.where((F.col(removed) == 0) | F.col("text").rlike(r"\S")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and documents that are more than half passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids, with the ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL can't express language ID and packing: the stages are tested against plain Python on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
