"""Candidates for terms, counted by windows of words (t18, t19): against candidates in rows, and what is shuffled."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from textloom.operators import glossary as g
from textloom.operators import phrases
from textloom.operators.text import term_key

COLUMNS = ["term", "kind", "variant", "n", "confidence"]


def by_rows(s):
    kinds = {"TECHNICAL_IDENTIFIER": g.technical_candidates(s), "NAMED_ENTITY": g.entity_candidates(s), "REPEATED_PHRASE": g.phrase_candidates(s)}
    return sorted(map(tuple, g.rank_candidates(kinds).select(COLUMNS).collect()))


@pytest.mark.parametrize("many", (False, True))
def test_ranks_by_windows_are_those_of_rows(spark, monkeypatch, many):
    """Spellings, gaps and letters of all sorts; texts handed on by small blocks, and first words that are too many for a part."""
    if many:
        monkeypatch.setattr(phrases, "SEEN_OF", 1)
        monkeypatch.setattr(phrases, "SEEN", 1)
        monkeypatch.setattr(phrases, "HELD", 50)
    r = random.Random(7)
    words = ["red", "Red", "RED", "the", "The", "of", "Blue", "House", "straße", "strasse", "STRASSE", "ΟΔΟΣ", "οδος", "İstanbul", "don't", "L'Olympia", "x_y", "fooBar", "a.b()", "HTTP", "𝒳", "7", "é", "é"]
    gaps = [" "] * 8 + ["  ", "-", " - ", "\t", ", ", ". ", "'", " ", "_"]
    texts = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.choice((0, 1, 2, 3, 5, 40)))) for _ in range(120)]
    s = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "red car " * 300)], "seg_id long, text string")
    if many:
        assert len(phrases._planned(s, 2, 4, frozenset(g.COMMON_WORDS))[1]) > 0
    assert sorted(map(tuple, g.rank_mined(s).select(COLUMNS).collect())) == by_rows(s)
    none = spark.createDataFrame([(1, None), (2, ""), (3, "the of")], "seg_id long, text string")
    assert g.rank_mined(none).collect() == []


def test_letters_of_one_key_have_one_fold(spark):
    """Words are dealt by a fold of their letters, so it must not tell apart what Spark's lower case makes equal."""
    letters = [chr(i) for i in range(0x21, 0x110000) if not 0xD800 <= i < 0xE000 and chr(i) != "\u0307" and chr(i) not in phrases.BETWEEN]
    s = spark.createDataFrame([(x,) for x in letters], "x string")
    rows = s.select("x", term_key(F.col("x")).alias("key"), term_key(F.concat(F.lit("a"), "x")).alias("last")).filter("key <> x OR last <> 'a' || x").collect()
    fold = lambda xs: phrases._folded(pa.array(xs, pa.large_string())).to_pylist()
    assert len(rows) > 1400 and fold([r.x for r in rows]) == fold([r.key for r in rows]) and fold(["a" + r.x for r in rows]) == fold([r.last for r in rows])
    words = pa.array(["Straße", "STRASSE", "The", "thé", "ΟΔΟΣ", " the", "-of"], pa.large_string())
    assert phrases._common(words, frozenset(("straße", "the", "of", "οδος"))).tolist() == [True, False, True, False, True, True, True]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A folder with documents of words that rarely meet twice, and the letters of their texts."""
    r, d = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(2000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(150)]
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d, sum(map(len, texts))


@pytest.mark.parametrize("name", ("t18_ranked_candidates", "t19_top_candidates"))
def test_shuffled_bytes_are_a_small_multiple_of_the_texts(spark, documents, name):
    """A window of words is handed on once, not each phrase in it with its key (over 20 bytes a letter)."""
    d, letters = documents
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = e.queries()[name](spark, d)
        rows = found.collect()
        node = found._jdf.queryExecution().executedPlan()
        sizes = []
        while node.children().size():
            if "Exchange" in node.nodeName():
                sizes.append(node.metrics().apply("dataSize").value())
            node = node.children().apply(0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert rows and 0 < sum(sizes) < 6 * letters
