"""A training-data pipeline over `documents`: language, lines, near duplicates, packing.

Each stage reads all rows the one before has written as Parquet. All but the last return the columns of `documents`.
SQL can express none of the models and alignments, so there is no SQL for the result; tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import stored, table
from edgeloom.llm.language_id import accepted, fit_on_documents
from edgeloom.llm.line_dedup import remove_common_lines
from edgeloom.llm.minhash_dedup import MinHashSettings, one_of_each_group
from edgeloom.llm.packing import pack_documents


NEAR = MinHashSettings(percent=80, matches=14)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go, and those in which no language has a mean of 0.3."""
    return accepted(docs, fit_on_documents(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines they share with earlier ones; those with nothing left of their text go."""
    cut = remove_common_lines(docs, count="removed_lines")
    left = cut.filter((F.col("removed_lines") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of similarity 0.8 or more; a pair at 0.8 is missed about once in 840,000."""
    return one_of_each_group(docs, NEAR)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row_id")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
