"""Corpus pipeline: language ID, exact dedup, near-dedup, substring dedup, packing, each stage a table for the next.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. `run` writes each stage's rows to the shared folder and reads them back as the next one's docs.
Null texts and texts without a letter have no language and go in the first stage; so does what is too uncertain
to tell. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftscope.llm import common, exact_dedup, language_id, packing, simhash, substring_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return language_id.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, placed in token-budget batches of length buckets."""
    return packing.pack(docs, docs.columns)


STAGES = [("language", language), ("exact", exact), ("near", near), ("substring", substring), ("pack", pack)]

#: The stages learn, link and name; SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
