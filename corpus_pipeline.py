"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet to the shared folder and read again. Every stage takes nulls in any column, texts of any
length, repeated rows, further columns of any name (which it carries along unread) and empty tables; what becomes of them says its
docstring, and more fully that of the operator it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.decontamination import clean
from leafmill.llm.langid import with_language
from leafmill.llm.mixing import mixed
from leafmill.llm.neardup import without_duplicates
from leafmill.llm.scratch import saved
from leafmill.llm.tokenstore import store_and_index


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: not null, blank or without a letter. Repeated rows fare alike."""
    return with_language(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each doc_id; rows without doc_id all stay."""
    return without_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Repeated rows fare alike."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard; those without a word never. A null source is one of its own."""
    return mixed(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's index of every document of the mix, a row for each time that it is taken; a null text is the end id alone."""
    return store_and_index(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("token_output", tokens)]

#: Neither trained models nor tokenizers can be written as SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
