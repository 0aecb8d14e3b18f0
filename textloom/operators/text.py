"""Text columns: normalisation, keys, ids, token estimates, numbers, JSON fields, links and rectangles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.spans import find_spans

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: What begins a list item.
LIST_MARK = r"(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][.)]\s+)"
PLACEHOLDER = r"__[A-Z]+_[A-Z_]+_\d{4,}_[0-9A-F]{2}__"


def normalize_lines(text: Column) -> Column:
    """Ligatures spelled out, soft hyphens out, broken words joined, lines joined but before list items, one space."""
    for one, many in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(many))
    text = F.replace(text, F.lit("­"), F.lit(""))
    text = F.regexp_replace(text, r"(\p{L})-[ \t]*\n\s*(?=\p{Ll})", "$1")
    text = F.regexp_replace(text, rf"\s*\n(?={LIST_MARK})", "\u0001")
    return F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("\u0001"), F.lit("\n"))


#: A word broken at a line's end; a mark of a list item, as it is seen from the break before it.
_BROKEN = r"(?<=\p{L})-[ \t]*\n(?=[ \t\r\f]*\p{Ll})"
_ITEM = r"(?:[-*•]|\d+[.)]|[A-Za-z][.)])(?:[ \t\n\r\f]|\z)"


def normalization_ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end): one row for each change that normalisation makes, by place in the source. A line break is
    of one kind: inside a broken word, else before a list item, else any other."""
    kinds = {
        "LIGATURE": "[ﬀ-ﬆ]", "SOFT_HYPHEN": "­", "WHITESPACE": r"[ \t\r\f]{2,}|[\t\r\f]", "HYPHENATED_LINE_BREAK": _BROKEN,
        "PRESERVED_LINE_BREAK": rf"{_BROKEN}|\n(?={_ITEM})", "VISUAL_LINE_BREAK": rf"{_BROKEN}|\n(?!{_ITEM})",
    }

    def of(kind: str, pattern: str) -> Column:
        spans = find_spans(F.col("text"), pattern)
        if kind in ("PRESERVED_LINE_BREAK", "VISUAL_LINE_BREAK"):
            # what else their patterns take is the break of a word
            spans = F.filter(spans, lambda s: s["value"] == "\n")
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    found = F.concat(*[of(k, p) for k, p in kinds.items()])
    return docs.select("doc_id", F.inline(found))


def clean_lines(text: Column) -> Column:
    """Each line's white space made one space, blank lines out, words broken at a line end joined."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, "\n"), r"(\p{L})-\n(?=\p{Ll})", "$1")


def term_key(text: Column) -> Column:
    """White space made one space and case folded, for text in composed form; ``exact_term_key`` is for any text."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def exact_term_key(text: pd.Series) -> pd.Series:
    """Compatibility form, one space, full case folding: what Spark has no function for."""
    import unicodedata

    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The version-5 UUID of ``name`` in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the columns' text, null as empty, joined by a control character."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; 0 for null and empty texts."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")


def mask_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, " ")


def content_length(text: Column) -> Column:
    """Code points besides white space and placeholders."""
    return F.length(F.regexp_replace(mask_placeholders(text), r"\s+", "")).cast("long")


def words(text: Column) -> Column:
    """Distinct lower-case words; ``n't`` counts as ``not``."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.lower(mask_placeholders(text)), F.lit("n't"), F.lit(" not")), F.lit(r"\p{L}+"), F.lit(0)))


def canonical_number(number: Column) -> Column:
    """A number without group separators and trailing zeros of its fraction, its sign kept."""
    sign, body = F.regexp_extract(number, r"^[+-]?", 0), F.regexp_replace(number, r"^[+-]", "")
    both = F.regexp_like(body, F.lit(r"\.")) & body.contains(",")
    whole, fraction = F.regexp_replace(F.regexp_extract(body, r"^(.*)[.,][^.,]*$", 1), "[.,]", ""), F.regexp_extract(body, r"[.,]([^.,]*)$", 1)
    short = F.regexp_replace(fraction, "0+$", "")
    point = lambda w, f: F.when(f == "", w).otherwise(F.concat(w, F.lit("."), f))
    return F.concat(sign, F.when(both, point(whole, short)).when(body.rlike(r"^[^.,]*(?:[.,]\d{3})+$"), F.regexp_replace(body, "[.,]", "")).when(body.rlike(r"^\d+[.,]\d*$"), point(whole, short)).otherwise(body))


NUMBER = r"(?<![\p{L}\p{N}_])[+-]?(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d+)?(?![\p{L}\p{N}_])"


def numeric_signature(text: Column) -> Column:
    """All numbers of a table cell in order, canonical, with a trailing percent sign kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{NUMBER}\s*%?"), F.lit(0)), lambda m: F.concat(canonical_number(F.regexp_replace(m, r"\s*%$", "")), F.regexp_extract(m, "%$", 0)))


def link_state(url: Column) -> Column:
    """struct(state, code): PRESERVED, DISABLED or BROKEN, by characters, scheme, host and mail address."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    code = (
        F.when(url.isNull() | (F.trim(url) == ""), "EMPTY").when(url.rlike(r"[\x00-\x20\x7f]"), "UNSAFE_CHARACTER").when(scheme == "", "NO_SCHEME")
        .when(~scheme.isin("http", "https", "mailto"), "SCHEME").when((scheme == "mailto") & ~url.contains("@"), "NO_ADDRESS")
        .when((scheme != "mailto") & (host == ""), "NO_HOST").otherwise("OK")
    )
    state = F.when(code == "OK", "PRESERVED").when(code == "SCHEME", "DISABLED").otherwise("BROKEN")
    return F.struct(state.alias("state"), code.alias("code"))


def enforced_text(rule_type: Column, source: Column, target: Column) -> Column:
    """How a rule wants its term written."""
    return (
        F.when(rule_type == "KEEP_SOURCE", source).when(rule_type == "PREFERRED", target).when(rule_type == "SOURCE_WITH_TARGET", F.concat(source, F.lit(" ("), target, F.lit(")")))
        .when(rule_type == "TARGET_WITH_SOURCE", F.concat(target, F.lit(" ("), source, F.lit(")")))
    )


def overlap_1d(a: Column, a_len: Column, b: Column, b_len: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a + a_len, b + b_len) - F.greatest(a, b))


def intersection_area(p: str, q: str) -> Column:
    """Area that boxes ``p`` and ``q`` (aliases with x, y, w, h) share."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return overlap_1d(c(p, "x"), c(p, "w"), c(q, "x"), c(q, "w")) * overlap_1d(c(p, "y"), c(p, "h"), c(q, "y"), c(q, "h"))


def percent(part: Column, whole: Column) -> Column:
    """A share bounded to 0 to 1, as text with one decimal; a share of nothing is 0."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)))
    return F.format_string("%.1f%%", share * 100)
