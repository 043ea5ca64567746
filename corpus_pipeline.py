"""A training corpus in five stages: language, near-duplicates, personal data, mixture, packing.

Each stage takes the documents that the one before kept, as Parquet in the shared folder.

Defined cases, for every stage: an empty table gives an empty one; a missing column of documents is null, and columns that
documents don't have are dropped. Language: null text and text without a letter go, the others stay with the language found.
Near-duplicates: a text without words is no one's copy and stays; equal rows are one; ids may be null or repeated. Personal
data: null and empty texts stay as they are. Mixture: null source and language are values of their own; repeated rows are
drawn alike. Packing: texts without words have no place; texts beyond the largest sequence are cut, none is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchlens.llm.common import settled, table
from patchlens.llm.langid import known_language
from patchlens.llm.mixing import mix
from patchlens.llm.near_dup import one_of_each
from patchlens.llm.packing import pack
from patchlens.llm.pii import pseudonymised


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the others carry the one predicted."""
    return known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms."""
    return pseudonymised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the target marginals."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go in the training sequences."""
    return pack(docs)


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("PII", pii), ("mixing", mixture), ("packing", packing)]

#: Language models and near-duplicate components are not expressible in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
