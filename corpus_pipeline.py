"""A corpus from raw documents: five stages, each on all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm.exact_dedup import keep_first
from orefield.llm.mixing import mixed_documents
from orefield.llm.ngram_join import keep_one_of_each
from orefield.llm.packing import pack_pieces, token_pieces
from orefield.llm.quality import keep_good
from orefield.llm.queries import tokenizer_files
from orefield.llm.shared import cut, drop_scratch, scratch


#: A stage's result is written before the next begins, so what a stage has written on its way goes when the next begins.
SCOPE = "corpus-pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    with scratch(spark, SCOPE):
        return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal ones stays."""
    with scratch(spark, SCOPE):
        return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram links hold together stays."""
    with scratch(spark, SCOPE):
        return keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: blocks of words are left out or repeated."""
    with scratch(spark, SCOPE):
        return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 1024."""
    drop_scratch(spark, SCOPE)
    return pack_pieces(token_pieces(docs, *tokenizer_files()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing),
]

#: A trained classifier, a pseudorandom mix and a tokenizer are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
