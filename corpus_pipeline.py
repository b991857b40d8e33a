"""The corpus pipeline: quality rules, near-duplicates, repeated strings, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet in the shared folder and
read again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedwright.llm.common import table
from feedwright.llm.decontaminate import decontaminate
from feedwright.llm.packing import pack_documents, public_tokenizer
from feedwright.llm.quality_rules import keep_good
from feedwright.llm.simhash import drop_near_duplicates
from feedwright.llm.suffix_dedup import remove_repeats
from feedwright.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every cutoff certified on the labels; rejected ones go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id."""
    return drop_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; every document stays, n_chars counts anew."""
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a noteworthy share of benchmark passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack_documents(docs, public_tokenizer()).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Fingerprints, byte runs and token ids are not expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
