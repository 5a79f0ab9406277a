"""Corpus preparation in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents (and any further ones,
whatever their names); the last returns the pieces of the packed training sequences. What a stage has
written for itself is deleted once its result is written.

Edge cases, in every stage: a null text counts as empty and fails the quality rules; a null id, language or
source is a value like any other (near-duplicates: it links with nothing and stays). Texts of any length
are taken whole. Rows that repeat are copies. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import documents, settle
from lodestrata.llm.exact_dedup import exact_dedup
from lodestrata.llm.mixing import mix
from lodestrata.llm.near_dup import near_dedup
from lodestrata.llm.packing import pack
from lodestrata.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good is at least one half and that pass the base test;
    equal texts get the same verdict."""
    return quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id, then the first row."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the smallest id; rows that
    share it stay or go together."""
    return near_dedup(docs, threshold=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; equal keys follow the id."""
    return mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 2048 tokens; equal lengths follow the row order."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: The quality model, MinHash and the tokenizer are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
