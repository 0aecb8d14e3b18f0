"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import materialize, table
from textloom.llm.decontaminate import remove_contamination
from textloom.llm.packing import pack_documents
from textloom.llm.pseudonyms import session_settings, without_personal_data
from textloom.llm.quality_rules import keep_good
from textloom.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms."""
    return without_personal_data(docs, session_settings(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pseudonymise_pii", pseudonymise_pii),
    ("pack", pack),
]

#: SQL can't express fingerprints, pseudonyms and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
