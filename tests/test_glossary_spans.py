"""Spans of benchmark lines beside those of the patterns (p03, p04), on literal texts."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as e


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """How rows of documents and lines of benchmark items become tables."""

    def write(documents, items):
        d = str(tmp_path_factory.mktemp("tables"))
        rows = [(i, t, "en", "src0", len(t)) for i, t in documents]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
        return d

    return write


def rows(spark, name, d):
    return Counter(tuple(r) for r in e.queries()[name](spark, d).select("seg_id", "kind", "start", "end").collect())


def of_sql(name, d):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return Counter(c.execute(e.oracle_sql()[name]).fetchall())


def test_each_term_at_a_place_is_a_span(spark, tables):
    """Two items with the same line are two terms: both stand in the merged spans, one is left when they are resolved."""
    d = tables([(1, "one two. NATO"), (2, "two.")], ["two.", "one\ntwo."])
    merged = rows(spark, "p03_merged_spans", d)
    assert merged == of_sql("p03_merged_spans", d)
    assert merged == {(100001, "TERM", 0, 3): 1, (100001, "TERM", 4, 8): 2, (100001, "ACRONYM", 9, 13): 1, (200001, "TERM", 0, 4): 2}
    assert rows(spark, "p04_resolved_spans", d) == {k: 1 for k in merged}


def test_every_place_of_a_term_and_the_longest_of_overlapping_spans(spark, tables):
    d = tables([(1, "The. A The. b The.c"), (2, "THED.IGNL or the big. dog")], ["The.", "big.", "the big. dog"])
    found = {(100001, "TERM", 0, 4), (100001, "TERM", 7, 11)}
    dotted, inside = (200001, "CODE", 0, 9), {(200001, "ACRONYM", 0, 4), (200001, "ACRONYM", 5, 9), (200001, "TERM", 17, 21)}
    code = (100001, "CODE", 14, 19)
    assert rows(spark, "p03_merged_spans", d) == {k: 1 for k in found | inside | {code, dotted, (200001, "TERM", 13, 25)}}
    assert rows(spark, "p04_resolved_spans", d) == {k: 1 for k in found | {code, dotted, (200001, "TERM", 13, 25)}}


def test_rows_that_share_a_document_number_keep_their_own_spans(spark, tables):
    """Each row has the terms of its own text, also where doc_id is repeated or null."""
    d = tables([(1, "red one"), (1, "no more red"), (1, "red one"), (None, "red")], ["red"])
    want = {(100001, "TERM", 0, 3): 2, (100001, "TERM", 8, 11): 1, (None, "TERM", 0, 3): 1}
    for name in ("p03_merged_spans", "p04_resolved_spans"):
        assert rows(spark, name, d) == want == of_sql(name, d)
