"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import exact, mixing, packing, simhash, toxicity
from shelfwise.llm.common import stage, table
from shelfwise.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, learnt from the labelled documents, rejects."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that with the largest id."""
    return exact.without_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near fingerprints, that with the smallest id."""
    return simhash.one_of_each_group(docs, shingle=4, bits=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share; a document is there as often as the mix takes it."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.0, cap=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, length=1024, **tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("simhash", dissimilar),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
