"""Checks of target texts against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.spans import let
from textloom.operators import text as t
from textloom.operators.protect import MARK, NEEDS, PATTERNS, TOKEN, may_match

# Words that mark a language, and words of negation.
MARKERS = {
    "en": ("and", "are", "as", "by", "for", "from", "in", "is", "not", "of", "on", "that", "the", "this", "to", "was", "were", "with"),
    "id": ("adalah", "akan", "atau", "dalam", "dan", "dari", "dengan", "di", "ini", "itu", "oleh", "pada", "sebagai", "telah", "tidak", "untuk", "yang"),
}
NEGATIONS = ("no", "not", "never", "neither", "without", "belum", "bukan", "jangan", "tak", "tanpa", "tidak")

# The order in which kinds of numbers are taken.
VERSION = r"(?iU)(?<![\w])v?\d+(?:\.\d+){2,}(?![\w])"
DATE = r"(?U)(?<![\w])\d{1,4}[-/]\d{1,2}[-/]\d{1,4}(?![\w])"
DECADE = r"(?iU)(?<!\w)(\d{3}0)(?:['’]?s|-?an)(?!\w)"
NUMBER = r"(?iU)(?<![\w])(?:(?:USD|IDR|EUR|GBP|JPY|Rp|[$€£¥])\s*)?[+-]?(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d+)?(?:\s*%)?(?![\w])"
_MONEY = r"(?i)^(?:USD|IDR|EUR|GBP|JPY|Rp|[$€£¥])"
LABELLED = r"(?i)\b(?:fig(?:ure)?|table|eq(?:uation)?)\.?\s+\d+(?:\.\d+)*\b"

#: Patterns, each with what a text must hold for a match.
_NEEDED = tuple((k, x, n) for (k, x), n in zip(PATTERNS, NEEDS, strict=True))
URL, URL_NEEDS = next((x, n) for k, x, n in _NEEDED if k == "URL")
CITATIONS = (*[(x, n) for k, x, n in _NEEDED if k == "CITATION"], (LABELLED, "[0-9]"))
CODE = tuple((x, n) for k, x, n in _NEEDED if k in ("CODE", "ENDPOINT", "FILE_PATH"))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _any_of(text: Column, patterns: tuple) -> Column:
    """All matches of all patterns (pattern, needs), sorted; a pattern that can't match isn't tried."""
    none = F.array().cast("array<string>")
    # the text is computed once and not for each pattern
    return let(text, lambda x: F.array_sort(F.concat(*[F.when(may_match(x, needs), _all(x, p)).otherwise(none) for p, needs in patterns])))


def without_placeholders(text: Column) -> Column:
    return F.when(text.contains(f"__{MARK}"), t.mask_placeholders(text)).otherwise(text)


def number_inventory(text: Column) -> Column:
    """All versions, dates, decades and numbers of ``text``, canonical and sorted: equal arrays are equal multisets."""
    return _numbers(t.mask_placeholders(text))


def _numbers(m: Column) -> Column:
    versions, dates = _all(m, VERSION), _all(m, DATE)
    left = F.regexp_replace(F.regexp_replace(m, VERSION, " "), DATE, " ")
    decades = F.transform(F.regexp_extract_all(left, F.lit(DECADE), F.lit(1)), lambda x: F.concat(F.lit("NUMBER::"), x, F.lit(":")))
    left = F.regexp_replace(left, DECADE, " ")

    def one(x: Column) -> Column:
        money = F.regexp_extract(x, _MONEY, 0)
        number = F.trim(F.regexp_replace(F.substring(x, F.length(money) + 1, F.length(x)), r"\s*%$", ""))
        return F.concat(F.lit("NUMBER:"), F.lower(money), F.lit(":"), t.canonical_number(number), F.lit(":"), F.regexp_extract(x, "%$", 0))

    tag = lambda k, a: F.transform(a, lambda x: F.concat(F.lit(k), F.lower(x)))
    found = F.array_sort(F.concat(tag("VERSION:", versions), tag("DATE:", dates), decades, F.transform(_all(left, NUMBER), one)))
    return F.when(m.rlike(r"(?U)\d"), found).otherwise(F.array().cast("array<string>"))


def url_inventory(text: Column) -> Column:
    return _urls(t.mask_placeholders(text))


def _urls(m: Column) -> Column:
    return F.array_sort(F.transform(_any_of(m, ((URL, URL_NEEDS),)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def citation_inventory(text: Column) -> Column:
    return _citations(t.mask_placeholders(text))


def _citations(m: Column) -> Column:
    return _any_of(m, CITATIONS)


def code_inventory(text: Column) -> Column:
    """Code, endpoints and paths of ``text`` besides what is part of an address."""
    return _codes(t.mask_placeholders(text))


def _codes(m: Column) -> Column:
    return let(m, lambda x: _any_of(F.when(may_match(x, URL_NEEDS), F.regexp_replace(x, URL, " ")).otherwise(x), CODE))


def marker_score(words: Column, language: str) -> Column:
    return F.size(F.array_intersect(words, F.array(*map(F.lit, MARKERS[language]))))


def wrong_language(target: Column, expected: str, other: str) -> Column:
    return _wrong_words(t.words(target), expected, other)


def _wrong_words(words: Column, expected: str, other: str) -> Column:
    good, bad = marker_score(words, expected), marker_score(words, other)
    return (bad >= 2) & (bad >= good + 2)


def untranslated(source: Column, target: Column, source_language: str) -> Column:
    return marker_score(F.array_intersect(t.words(source), t.words(target)), source_language) > 0


def length_ratio(source: Column, target: Column) -> Column:
    n = t.content_length(source)
    return F.when(n > 0, t.content_length(target) / n)


def suspicious_length(source: Column, target: Column, low: float = 0.5, high: float = 2.0) -> Column:
    return F.coalesce(~length_ratio(source, target).between(low, high), F.lit(False))


def negated(text: Column) -> Column:
    return _negated_words(t.words(text))


def _negated_words(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS)))


def issues(pairs: DataFrame, expected: str = "id", other: str = "en") -> DataFrame:
    """(pair_id, code, severity): all checks of ``pairs`` (pair_id, source, target) in one scan; null texts are empty.

    Each text's words are taken once. A target equal to its source has all that the source has, so of such a pair only
    what looks at the target's words is checked.
    """
    d = pairs.select("pair_id", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("target", F.lit("")).alias("g"))
    d = d.withColumns({"same": F.col("s") == F.col("g"), "sw": t.words(F.col("s"))})
    d = d.withColumn("gw", F.when(F.col("same"), F.col("sw")).otherwise(t.words(F.col("g"))))
    # placeholders are taken out once, for all inventories
    d = d.withColumns({"sm": without_placeholders(F.col("s")), "gm": without_placeholders(F.col("g"))})
    s, g, sw, gw, sm, gm = (F.col(c) for c in ("s", "g", "sw", "gw", "sm", "gm"))
    tokens = lambda c: _all(c, TOKEN)
    differ = lambda inventory: F.when(F.col("same"), F.lit(False)).otherwise(inventory(sm) != inventory(gm))
    checks = (
        ("PLACEHOLDER_MISMATCH", "CRITICAL", F.when(F.col("same"), F.lit(False)).otherwise(tokens(s) != tokens(g))), ("NUMBER_MISMATCH", "CRITICAL", differ(_numbers)), ("URL_MISMATCH", "CRITICAL", differ(_urls)),
        ("CODE_MISMATCH", "CRITICAL", differ(_codes)), ("CITATION_MISMATCH", "CRITICAL", differ(_citations)), ("EMPTY_TRANSLATION", "CRITICAL", ~g.rlike(r"\S")),
        ("TARGET_LANGUAGE_MISMATCH", "WARNING", _wrong_words(gw, expected, other)), ("UNTRANSLATED_SOURCE_FRAGMENT", "WARNING", marker_score(F.array_intersect(sw, gw), other) > 0),
        ("SUSPICIOUS_LENGTH", "WARNING", F.when(F.col("same"), F.lit(False)).otherwise(suspicious_length(s, g))), ("NEGATION_MISMATCH", "WARNING", _negated_words(sw) != _negated_words(gw)),
    )
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in checks]))
    return d.select("pair_id", F.inline(found))
