"""A maintained table of where terms occur, kept up by what changed on either side.

Texts and terms are known by hashes of what they say, so a text that many segments share is walked once, a moved
segment or a renumbered term costs nothing, and an edited one counts as one gone and one new. New texts meet all
terms; texts known before meet new terms only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.glossary import find_terms
from textloom.sources import committed

TABLES = ("texts", "terms", "found")


def _key(text: Column) -> Column:
    """128 bits of a digest, so that no two texts share it."""
    return F.substring(F.sha2(text, 256), 1, 32)


def _texts(segments: DataFrame) -> DataFrame:
    own = segments.filter("text IS NOT NULL AND text <> ''").select("text")
    return own.select(_key(F.col("text")).alias("text_key"), "text").dropDuplicates(["text_key"])


def _terms(terms: DataFrame) -> DataFrame:
    own = terms.filter("source_term IS NOT NULL").select("source_term")
    return own.select(_key(F.col("source_term")).alias("term_key"), "source_term").dropDuplicates(["term_key"])


def _found(texts: DataFrame, terms: DataFrame, case_sensitive: bool) -> DataFrame:
    """(text_key, term_key, start, end): find_terms with the keys as ids."""
    spans = find_terms(texts.select(F.col("text_key").alias("seg_id"), "text"), terms.select(F.col("term_key").alias("term_id"), "source_term"), case_sensitive)
    return spans.select(F.col("seg_id").alias("text_key"), F.col("term_id").alias("term_key"), "start", "end")


def refresh(spark: SparkSession, path: str, segments: DataFrame, terms: DataFrame, case_sensitive: bool = False) -> dict[str, int]:
    """Bring the table under ``path`` up to ``segments`` (seg_id, text) and ``terms`` (term_id, source_term) and return how
    many texts and terms came and went; where nothing did, nothing is written.

    A version is committed as a whole (``sources.committed``): a refresh that dies leaves the one before.
    """
    now = committed.current(spark, path)
    texts, given = _texts(segments), _terms(terms)
    if now is None:
        empty = spark.createDataFrame([], "text_key string, term_key string, start long, `end` long")
        old_texts, old_terms, old_found = texts.limit(0), given.limit(0), empty
    else:
        old_texts, old_terms, old_found = (spark.read.parquet(f"{now[1]}/{t}") for t in TABLES)
    key_of_texts, key_of_terms = texts.select("text_key"), given.select("term_key")
    new_texts, new_terms = texts.join(old_texts.select("text_key"), "text_key", "left_anti"), given.join(old_terms.select("term_key"), "term_key", "left_anti")
    gone_texts, gone_terms = old_texts.select("text_key").join(key_of_texts, "text_key", "left_anti"), old_terms.select("term_key").join(key_of_terms, "term_key", "left_anti")
    changes = {"new_texts": new_texts.count(), "gone_texts": gone_texts.count(), "new_terms": new_terms.count(), "gone_terms": gone_terms.count()}
    if now is not None and not any(changes.values()):
        return changes
    kept = old_found
    if changes["gone_texts"]:
        kept = kept.join(gone_texts, "text_key", "left_anti")
    if changes["gone_terms"]:
        kept = kept.join(gone_terms, "term_key", "left_anti")
    found = kept
    if changes["new_texts"]:
        found = found.unionByName(_found(new_texts, given, case_sensitive))
    if changes["new_terms"] and now is not None:
        known = old_texts.join(gone_texts, "text_key", "left_anti") if changes["gone_texts"] else old_texts
        found = found.unionByName(_found(known, new_terms, case_sensitive))
    committed.commit(spark, path, {"texts": texts, "terms": given, "found": found}, after=now[0] if now else 0)
    return changes


def occurrences(spark: SparkSession, path: str, segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(seg_id, term_id, start, end) of the committed table: what find_terms gives for ``segments`` and ``terms``."""
    found = committed.read_committed(spark, path, "found")
    by_text = segments.filter("text IS NOT NULL AND text <> ''").select("seg_id", _key(F.col("text")).alias("text_key"))
    by_term = terms.filter("source_term IS NOT NULL").select("term_id", _key(F.col("source_term")).alias("term_key")).distinct()
    return found.join(by_text, "text_key").join(by_term, "term_key").select("seg_id", "term_id", "start", "end")
