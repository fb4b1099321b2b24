"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes the documents its predecessor kept and returns documents, all but the last, which
returns the placed pieces of the packed sequences. Between stages documents are written as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from checks.session import with_folder
from histloom.llm import decontaminate, packing, privacy, quality, simhash
from histloom.llm.common import stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are masked; every document stays."""
    return privacy.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces with their places in sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one),
    ("benchmark decontamination", remove_benchmark),
    ("personal data", mask_personal),
    ("packing", pack),
]

# Scores of a fitted model and byte-pair ids cannot be expressed in SQL; the tests compare every
# stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(with_folder(spark), docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
