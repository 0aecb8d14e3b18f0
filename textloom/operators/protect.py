"""Protected spans and placeholders: inventory, masking, audit and restoring."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.spans import find_spans, greedy_disjoint, let, replace_spans

# The patterns and the precedence of the kinds.
PATTERNS = (
    ("CODE", r"```[\s\S]*?```"),
    ("CODE", r"`[^`\r\n]+`"),
    ("URL", r"(?i)(?:https?://|www\.)[^\s<>\"']+"),
    ("EMAIL", r"(?iU)(?<![\w.!#$%&'*+/=?^`{|}~-])[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?![\w-])"),
    ("ENDPOINT", r"(?i)(?<![A-Z])(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[A-Za-z0-9._~{}:/-]+"),
    ("ENDPOINT", r"(?iU)(?<![\w/])/(?:api|v[0-9]+)(?:/[A-Za-z0-9._~{}:-]+)+"),
    ("FILE_PATH", r"(?U)(?<![\w])(?:[A-Za-z]:\\|\\\\[A-Za-z0-9._$-]+\\)(?:[^\\\s<>:\"|?*]+\\)*[^\\\s<>:\"|?*,;!]+"),
    ("FILE_PATH", r"(?U)(?<![\w])/(?:[A-Za-z0-9._~-]+/)+[A-Za-z0-9._~-]*[A-Za-z0-9_~)-]"),
    ("FILE_PATH", r"(?U)(?<![\w])(?:[A-Za-z0-9._~-]+[\\/])+[A-Za-z0-9._~-]*[A-Za-z0-9_~)-](?![\w])"),
    ("CITATION", r"\[(?:\d{1,4})(?:\s*[-,;]\s*\d{1,4})*\]"),
    ("CITATION", r"(?U)\([A-Z][\w'-]+(?:\s+et\s+al\.)?(?:\s*&\s*[A-Z][\w'-]+)?,\s*(?:19|20)\d{2}[a-z]?\)"),
    ("CODE", r"(?U)(?<![\w])(?:[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)(?:\(\))?(?![\w])"),
    ("ACRONYM", r"(?U)(?<![\w])(?:[A-Z]{2,}[0-9]*|[A-Z][0-9][A-Z0-9]*)(?![\w])"),
)
#: What a text must hold for each of PATTERNS to match: any of these strings, or a match of this plain pattern. Most
#: texts hold little of it, and a look for a string costs far less than a pattern that looks around itself.
NEEDS: tuple[tuple[str, ...] | str, ...] = (
    ("```",), ("`",), ("://", "www.", "WWW.", "Www.", "wWw.", "wwW.", "WWw.", "WwW.", "wWW."), ("@",), ("/",), ("/",), ("\\",), ("/",), ("/", "\\"), ("[",), ("(",),
    r"[A-Za-z0-9]_[A-Za-z0-9_]|[a-z][A-Z]|[A-Za-z0-9_]\.[A-Za-z_]", r"[A-Z][A-Z0-9]",
)
KINDS = ("CODE", "URL", "EMAIL", "ENDPOINT", "FILE_PATH", "CITATION", "TERM", "ACRONYM")
SPAN = "array<struct<n:int,start:int,rank:int,end:int,kind:string,value:string>>"
MARK = "TLM"
TOKEN = rf"__{MARK}_(?:{'|'.join(KINDS)})_[0-9]{{4,}}_[0-9A-F]{{2}}__"
#: What looks like a token, whole or not.
_LIKE = rf"__{MARK}[A-Za-z0-9_]*"


def may_match(text: Column, needs: tuple[str, ...] | str) -> Column:
    """Whether ``text`` has what one of NEEDS asks for."""
    return text.rlike(needs) if isinstance(needs, str) else reduce(or_, [text.contains(n) for n in needs])


def trim_end(kind: Column, value: Column) -> Column:
    """``value`` without sentence punctuation at its end; of a URL also without closing brackets that nothing opens."""
    cut = F.regexp_replace(value, r"[.,;:!?]+$", "")

    def unbalanced(v: Column, i: Column) -> Column:
        out = v
        for a, z in ("()", "[]", "{}"):
            count = lambda c: F.length(v) - F.length(F.replace(v, F.lit(c), F.lit("")))
            out = F.when(v.endswith(z) & (count(z) > count(a)), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(out)
        return out

    tail = F.length(F.regexp_extract(cut, r"[)\]}]+$", 0))
    url = F.aggregate(F.sequence(F.lit(0), tail), cut, unbalanced)
    return F.when(kind == "URL", url).when(kind.isin("ENDPOINT", "FILE_PATH"), cut).otherwise(value)


def protected_spans(text: Column, extra: Column | None = None) -> Column:
    """All pattern matches of ``text`` and ``extra`` spans of the same form, overlaps not yet resolved."""

    def of(kind: str, pattern: str, needs: tuple[str, ...] | str) -> Column:
        def span(s: Column) -> Column:
            value = trim_end(F.lit(kind), s["value"])
            n = F.length(value)
            return F.struct((-n).alias("n"), s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (s["start"] + n).alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

        return F.when(may_match(text, needs), F.transform(find_spans(text, pattern), span).cast(SPAN)).otherwise(F.array().cast(SPAN))

    spans = [of(k, p, n) for (k, p), n in zip(PATTERNS, NEEDS, strict=True)] + ([extra] if extra is not None else [])
    return F.filter(F.concat(*spans), lambda s: s["end"] > s["start"])


def resolved_spans(spans: Column) -> Column:
    """The longest spans first, then the earliest, then by kind; none overlaps another; by place."""
    chosen = F.transform(greedy_disjoint(F.array_distinct(spans), SPAN), lambda s: F.struct(s["start"].alias("at"), s.alias("s")))
    return F.transform(F.array_sort(chosen), lambda x: x["s"])


def inventory(docs: DataFrame, *keep: str, extra: Column | None = None) -> DataFrame:
    """(``keep``, kind, start, end, value) of each protected item of ``docs`` (text, and the columns ``keep``)."""
    return docs.select(*keep, F.inline(resolved_spans(protected_spans(F.col("text"), extra)))).select(*keep, "kind", "start", "end", "value")


def _checksum(kind: Column, number: Column, value: Column) -> Column:
    """The first byte of a digest of kind, number and value."""
    zero = F.unhex(F.lit("00"))
    raw = F.concat(F.encode(kind, "UTF-8"), zero, F.encode(number.cast("string"), "UTF-8"), zero, F.encode(value, "UTF-8"))
    return F.conv(F.substring(F.sha2(raw, 256), 1, 2), 16, 10).cast("int")


def _token(kind: Column, number: Column, checksum: Column) -> Column:
    return F.concat(F.lit(f"__{MARK}_"), kind, F.lit("_"), F.format_string("%04d", number), F.lit("_"), F.format_string("%02X", checksum), F.lit("__"))


def placeholder(kind: Column, number: Column, value: Column) -> Column:
    """A token with the item's kind, its number in four digits or more, and a two-digit checksum of both and the value."""
    return _token(kind, number, _checksum(kind, number, value))


def numbered_placeholders(spans: Column, text: Column) -> Column:
    """A token for each of ``spans``, numbered from 1. Tokens that ``text`` has by nature are passed over: by the next
    free checksum, and where a number has none by the next number."""

    def passing_over(taken: Column) -> Column:
        def first_free(s: Column, number: Column) -> Column:
            seed = _checksum(s["kind"], number, s["value"])
            tries = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: _token(s["kind"], number, (seed + k) % 256))
            return F.get(F.filter(tries, lambda t: ~F.array_contains(taken, t)), F.lit(0))

        def step(acc: Column, s: Column) -> Column:
            numbers = F.sequence(acc["next"], acc["next"] + F.floor(F.size(taken) / 256).cast("int"))
            free = F.filter(F.transform(numbers, lambda n: F.struct(n.alias("n"), first_free(s, n).alias("token"))), lambda x: x["token"].isNotNull())
            return let(F.get(free, F.lit(0)), lambda x: F.struct((x["n"] + 1).alias("next"), F.concat(acc["out"], F.array(x["token"])).alias("out")))

        return F.aggregate(spans, F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out")), step)["out"]

    plain = F.transform(spans, lambda s, i: placeholder(s["kind"], i + 1, s["value"]))
    taken = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    return F.when(text.contains(f"__{MARK}_"), let(taken, passing_over)).otherwise(plain)


def mask(docs: DataFrame, extra: Column | None = None) -> DataFrame:
    """``docs`` (with text) with ``masked`` and ``items`` (placeholder, value): items are numbered from 1 by place."""
    d = docs.withColumn("spans", resolved_spans(protected_spans(F.col("text"), extra)))
    tokens = numbered_placeholders(F.col("spans"), F.coalesce("text", F.lit("")))
    d = d.withColumn("items", F.zip_with(tokens, "spans", lambda t, s: F.struct(t.alias("placeholder"), s["value"].alias("value"))))
    return d.withColumn("masked", replace_spans(F.col("text"), F.col("spans"), lambda s, i: F.get("items", i)["placeholder"])).drop("spans")


def placeholders_left(text: Column) -> Column:
    """The placeholders that ``text`` holds once it is masked, by place, those that it has by nature included."""

    def held(spans: Column) -> Column:
        def found(tokens: Column) -> Column:
            masked = replace_spans(text, spans, lambda s, i: F.get(tokens, i))
            return F.when(text.contains(f"__{MARK}_"), F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0))).otherwise(tokens)

        return let(numbered_placeholders(spans, text), found)

    return let(resolved_spans(protected_spans(text)), held)


def restore(masked: Column, items: Column) -> Column:
    """``masked`` with each placeholder replaced by its value; other tokens stay."""

    def put(found: Column) -> Column:
        in_order = found == F.transform(items, lambda x: x["placeholder"])
        one = lambda p: F.coalesce(F.get(F.filter(items, lambda x: x["placeholder"] == p), F.lit(0))["value"], p)
        values = F.when(in_order, F.transform(items, lambda x: x["value"])).otherwise(F.transform(found, one))
        return F.array_join(F.zip_with(F.split(masked, TOKEN, -1), F.concat(values, F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")

    return let(F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0)), put)


def audit(text: Column, items: Column, natural: Column | None = None) -> Column:
    """Codes of what is wrong with the placeholders of ``text``, sorted: MISSING, DUPLICATED, ALTERED (a number of the
    items with another kind or checksum), UNKNOWN, MALFORMED, REORDERED. Tokens in the array ``natural`` aren't judged."""
    number = lambda p: F.regexp_extract(p, rf"__{MARK}_[A-Z_]+_0*([0-9]+)_", 1)

    def codes(seen: Column, expected: Column) -> Column:
        count = lambda p: F.size(F.filter(seen, lambda s: s == p))
        numbers = F.transform(expected, number)
        strange = F.filter(seen, lambda s: ~F.array_contains(expected, s))
        cut = F.filter(F.regexp_extract_all(text, F.lit(_LIKE), F.lit(0)), lambda x: ~x.rlike(rf"^{TOKEN}"))
        known = F.filter(seen, lambda s: F.array_contains(expected, s))
        meant = lambda x: F.array_contains(numbers, number(x))
        found = F.array(
            F.when(F.exists(expected, lambda p: count(p) == 0), F.lit("MISSING")), F.when(F.exists(expected, lambda p: count(p) > 1), F.lit("DUPLICATED")),
            F.when(F.exists(strange, meant) | F.exists(cut, lambda x: (number(x) != "") & meant(x)), F.lit("ALTERED")),
            F.when(F.exists(strange, lambda s: ~meant(s)), F.lit("UNKNOWN")), F.when(F.size(cut) > 0, F.lit("MALFORMED")),
            F.when((F.size(known) == F.size(expected)) & (F.array_sort(known) == F.array_sort(expected)) & (known != expected), F.lit("REORDERED")),
        )
        clean = (seen == expected) & ~F.regexp_replace(text, TOKEN, "").contains(f"__{MARK}")
        return F.when(clean, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(found)))

    seen = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    if natural is not None:
        seen = F.filter(seen, lambda s: ~F.array_contains(natural, s))
    return let(seen, lambda s: let(F.transform(items, lambda x: x["placeholder"]), lambda e: codes(s, e)))


def protected_only(text: Column) -> Column:
    """True if nothing but placeholders, marks and spaces is left."""
    return ~F.regexp_replace(text, TOKEN, "").rlike(r"[\p{L}\p{N}]")
