"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Card and social-security numbers, phone numbers, IPv4 addresses and dates that pass their checks are permuted within
their own format: the free digits form two halves, each round adds a keyed hash of one half to the other, modulo that
half's size, and check digits are computed anew. Equal values get equal pseudonyms in all documents, and different
values of one format get different ones. E-mail addresses and secret tokens have no number format; their characters
come from a keyed hash of the value. All of it is DataFrame expressions; the key is a parameter without default.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table


@dataclass(frozen=True)
class PseudonymSettings:
    key: str
    rounds: int = 8


#: The session setting with the key; its name makes Spark hide it in listings.
KEY_SETTING = "spark.textloom.pseudonyms.secret"


def session_settings(spark: SparkSession) -> PseudonymSettings:
    """Settings with the session's key. Where none is set a random one is, so that pseudonyms agree within the session
    and can't be undone by whoever reads this code; set one to link values across sessions."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return PseudonymSettings(key)


KINDS = ("email", "secret", "ip", "date", "ssn", "phone", "card")

_PATTERNS = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,128}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)(?!\p{L})",
    r"(?<![\p{L}\p{N}/.-])\d{4}-\d{1,2}-\d{1,2}(?:(?![\p{L}\p{N}/-])|(?=[Tt]\d{2}))",
    r"(?<![\p{L}\p{N}/.-])(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\p{L}\p{N}/-])",
    r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}-])",
)
# numbers in a row that hold 13 digits or more, up to the next match of another kind; ``_pieces`` finds the cards in them
_NUMBER = r"\d++(?![\p{L}\p{N}])"
_RUN = rf"(?<![\p{{L}}\p{{N}}.-])(?=\d(?:[ -]?\d){{12}}){_NUMBER}(?:(?:-| (?!{'|'.join(_PATTERNS)})){_NUMBER})*+"
_ANY = "|".join(f"(?:{p})" for p in (*_PATTERNS, _RUN))
# The usual groupings of card numbers.
_GROUPINGS = ((4, r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}$"), (3, r"^\d{4}([ -])\d{6}\1\d{4,5}$"), (5, r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}$"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of ``digits`` with the last digit counted once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


_DATE = r"^(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})$"


def _as_date(m: Column) -> Column:
    """The date, null if it isn't one; with slashes month first where that is possible."""
    return (
        F.when(m.contains("-"), F.try_to_timestamp(m, F.lit("yyyy-M-d")))
        .when(m.contains("."), F.try_to_timestamp(m, F.lit("d.M.yyyy")))
        .otherwise(F.coalesce(F.try_to_timestamp(m, F.lit("M/d/yyyy")), F.try_to_timestamp(m, F.lit("d/M/yyyy"))))
        .cast("date")
    )


# Country codes of telephone numbers; those of three digits are all others.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_FIRST_DAY = -62091  # 1800-01-01 in days since 1970; 400 years from there are 189 * 773 days


def kind_of(m: Column) -> Column:
    """The kind of a matched string; null if it fails the check of its format."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    days = F.unix_date(_as_date(m))
    ssn = ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-|-0000$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9A-Fa-f]{32,128}$"), "secret")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(octets, F.lit("ip")))
        .when(m.rlike(_DATE), F.when((days >= _FIRST_DAY) & (days < _FIRST_DAY + 146097), F.lit("date")))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(ssn, F.lit("ssn")))
        .when(m.rlike(r"^\+|\(|^\d{3}([.-])\d{3}\1\d{4}$"), F.when(F.length(_digits(m)).between(7, 15), F.lit("phone")))
        .when(F.length(_digits(m)).between(13, 19) & (_luhn_sum(_digits(m)) % 10 == 0), F.lit("card"))
    )


def _pieces(m: Column) -> Column:
    """The pieces, struct(m, kind), that make up the matched string: several only where numbers in a row hold cards.

    Unbroken numbers and the usual groupings go first; of what is left, the whole run, then from the left the longest
    groups of three digits or more each.
    """
    piece = lambda x, kind: F.struct(x.alias("m"), kind.alias("kind"))
    whole = F.array(piece(m, kind_of(m)))

    def cards(t: Column) -> Column:
        """Over the numbers of ``m`` (at even places) and the separators between them."""
        n = ((F.size(t) + 1) / 2).cast("int")
        part = lambda i, k: F.array_join(F.slice(t, 2 * i + 1, 2 * k - 1), "")
        valid = lambda x: F.length(_digits(x)).between(13, 19) & (_luhn_sum(_digits(x)) % 10 == 0)

        def usual(i: Column) -> Column:
            grouped = [((i + k <= n) & part(i, F.lit(k)).rlike(form) & valid(part(i, F.lit(k))), k) for k, form in _GROUPINGS]
            out = F.when(valid(part(i, F.lit(1))), 1)
            for test, k in grouped:
                out = out.when(test, k)
            return out.otherwise(0)

        def scan(first: Column) -> Column:
            def longest(i: Column) -> Column:
                """How many numbers from ``i`` on make a card of unusual grouping; null for none."""
                fits = lambda k: (
                    ~F.exists(F.slice(first, i + 1, k), lambda x: x > 0) & ((k == n) | ~part(i, k).rlike(r"(?<!\d)\d{1,2}(?!\d)")) & valid(part(i, k))
                )
                return F.get(F.filter(F.sequence(F.least(n - i, F.lit(19)), F.lit(1), F.lit(-1)), fits), F.lit(0))

            def step(state: Column, i: Column) -> Column:
                k = F.when(F.get(first, i) > 0, F.get(first, i)).otherwise(F.coalesce(longest(i), F.lit(0)))
                here = lambda k: F.struct(
                    (i + F.greatest(k, F.lit(1))).alias("next"),
                    F.concat(
                        state["out"],
                        F.when(i > 0, F.array(piece(F.get(t, 2 * i - 1), none))).otherwise(F.array().cast(kind)),
                        F.array(piece(part(i, F.greatest(k, F.lit(1))), F.when(k > 0, F.lit("card")))),
                    ).alias("out"),
                )
                return F.when(i < state["next"], state).otherwise(_let(k, here))

            start = F.struct(F.lit(0).alias("next"), F.array().cast(kind).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["out"]

        return _let(F.transform(F.sequence(F.lit(0), n - 1), usual), scan)

    none, kind = F.lit(None).cast("string"), "array<struct<m:string,kind:string>>"
    row = m.rlike(r"^\d[\d -]*$") & m.rlike("[ -]") & ~m.rlike(_DATE) & ~m.rlike(r"^\d{3}-(?:\d{2}|\d{3})-\d{4}$")
    return F.when(row, _let(F.regexp_extract_all(m, F.lit(r"\d+|[ -]"), F.lit(0)), cards)).otherwise(whole)


def _keyed_hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _feistel(kind: Column, left: Column, a: Column, right: Column, b: Column, s: PseudonymSettings) -> Column:
    """struct(l, r): a permutation of pairs 0 <= l < a, 0 <= r < b, one for each key, kind and (a, b)."""

    def turn(p: Column, i: Column) -> Column:
        half = F.when(i % 2 == 1, p["r"]).otherwise(p["l"])
        f = F.conv(F.substring(_keyed_hex(s.key, kind, a, b, i, half), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 1, (p["l"] + f) % a).otherwise(p["l"]).alias("l"),
            F.when(i % 2 == 1, p["r"]).otherwise((p["r"] + f) % b).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(s.rounds)), start, turn)


def _permuted(kind: str, digits: Column, s: PseudonymSettings) -> Column:
    """``digits`` (2 to 18 of them) permuted among strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n)
    p = _feistel(F.lit(kind), left, ten(half), right, ten(n - half), s)
    return _let(p, lambda x: F.concat(F.lpad(x["l"].cast("string"), half, F.lit("0")), F.lpad(x["r"].cast("string"), n - half, F.lit("0"))))


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits, in order, replaced by ``digits``."""

    def at(i: Column) -> Column:
        c = F.substring(form, i, F.lit(1))
        n = F.length(_digits(F.substring(form, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, n, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")


def pseudonym(m: Column, kind: Column, s: PseudonymSettings) -> Column:
    """The pseudonym of ``m``, of the given kind; ``m`` itself for a null kind."""
    digits = _digits(m)

    def card(d: Column) -> Column:
        body = _permuted("card", F.substring(d, F.lit(1), F.length(d) - 1), s)
        return _let(body, lambda x: F.concat(x, ((10 - _luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    def phone(d: Column) -> Column:  # a country code stays
        code = F.regexp_extract(F.regexp_replace(m, r"[^0-9+]", ""), _COUNTRY, 0)
        cut = F.greatest(F.length(code) - 1, F.lit(0))
        return F.concat(F.substring(d, F.lit(1), cut), _permuted("phone", F.substring(d, cut + 1, F.lit(15)), s))

    def ssn(d: Column) -> Column:
        # areas 001-899 without 666 (898), groups 01-99 and serials 0001-9999 (989901 pairs)
        area, rest = F.substring(d, 1, 3).cast("long"), (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
        p = _feistel(F.lit("ssn"), area - 1 - (area > 666).cast("long"), F.lit(898).cast("long"), rest, F.lit(99 * 9999).cast("long"), s)
        return _let(p, lambda x: F.concat(
            F.lpad((x["l"] + 1 + (x["l"] >= 665).cast("long")).cast("string"), 3, "0"),
            F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0"),
        ))

    octet = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("long")
    k16 = F.lit(65536).cast("long")
    ip = _let(
        _feistel(F.lit("ip"), octet(0) * 256 + octet(1), k16, octet(2) * 256 + octet(3), k16, s),
        lambda x: F.concat_ws(".", *[v.cast("long").cast("string") for h in ("l", "r") for v in (F.floor(x[h] / 256), x[h] % 256)]),
    )

    def date(day: Column) -> Column:
        halves = lambda n: (F.floor(n / 773).cast("long"), (n % 773).cast("long"))

        def other(n: Column) -> Column:
            p = _feistel(F.lit("date"), halves(n)[0], F.lit(189).cast("long"), halves(n)[1], F.lit(773).cast("long"), s)
            return _let(p, lambda x: x["l"] * 773 + x["r"])

        as_date = lambda n: F.date_from_unix_date((n + _FIRST_DAY).cast("int"))
        slashes, month_first = m.contains("/"), F.try_to_timestamp(m, F.lit("M/d/yyyy")).isNotNull()

        # with slashes, a day over 12 goes to a day over 12 if it comes first: the walk along the permutation to the next
        # such day is a permutation of those days, and three in five days are
        def walk(n: Column, _: Column) -> Column:
            open_ = slashes & ~month_first & (F.dayofmonth(as_date(n)) <= 12)
            return F.when(open_, other(n)).otherwise(n)

        padded = ~m.rlike(r"(?<!\d)\d(?!\d)")
        shown = lambda n, form: F.date_format(as_date(n), form)
        both = lambda n, form: F.when(padded, shown(n, form)).otherwise(shown(n, form.replace("MM", "M").replace("dd", "d")))
        new = F.aggregate(F.sequence(F.lit(1), F.lit(64)), other(day), walk)
        return _let(new, lambda n: F.when(m.contains("-"), both(n, "yyyy-MM-dd")).when(m.contains("."), both(n, "dd.MM.yyyy"))
                    .when(month_first, both(n, "MM/dd/yyyy")).otherwise(both(n, "dd/MM/yyyy")))

    letters = lambda x, n: F.translate(F.substring(x, 1, n), "0123456789", "ghijklmnop")
    low = F.lower(m)
    host = F.substring_index(low, "@", -1)
    email = F.concat(letters(_keyed_hex(s.key, F.lit("email"), low), 12), F.lit("@"), letters(_keyed_hex(s.key, F.lit("host"), host), 10), F.lit("."), F.substring_index(host, ".", -1))
    secret = F.substring(F.concat(_keyed_hex(s.key, F.lit("secret"), m), _keyed_hex(s.key, F.lit("secret2"), m)), F.lit(1), F.length(m))
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.when(m == F.upper(m), F.upper(secret)).otherwise(secret))
        .when(kind == "ip", ip)
        .when(kind == "date", date(F.unix_date(_as_date(m)).cast("long") - _FIRST_DAY))
        .when(kind == "ssn", _refill(m, ssn(digits)))
        .when(kind == "phone", _refill(m, phone(digits)))
        .when(kind == "card", _refill(m, card(digits)))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, settings: PseudonymSettings) -> DataFrame:
    """``docs`` with pseudonyms in text, and a column ``pii``: map of kind to how many were replaced.

    Null text stays null with an empty map, as does a text without matches; the rest of a text is untouched. A column
    ``pii`` of ``docs`` is replaced; repeated rows get the same result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    matches = F.when(text.rlike("[0-9@]|[A-Fa-f]{32}"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    d = docs.drop("pii").withColumn("__found", matches)
    d = d.withColumn("__found", F.transform("__found", _pieces))
    new = F.transform("__found", lambda p: F.array_join(F.transform(p, lambda x: pseudonym(x["m"], x["kind"], settings)), ""))
    d = d.withColumn("__all", F.flatten("__found"))
    d = d.withColumn("__new", F.when(F.exists("__all", lambda x: x["kind"].isNotNull()), new))
    gaps = F.split("text", _ANY, -1)
    put = F.array_join(F.zip_with(gaps, F.concat("__new", F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
    count = lambda k: F.size(F.filter("__all", lambda x: x["kind"] == k))
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(count, KINDS))), lambda _, n: n > 0)
    d = d.withColumns({"text": F.when(F.col("__new").isNotNull(), put).otherwise(F.col("text")), "pii": counts})
    return d.drop("__found", "__all", "__new")


def without_personal_data(docs: DataFrame, settings: PseudonymSettings) -> DataFrame:
    """``docs`` with pseudonyms in text; n_chars, if there, follows the text."""
    out = pseudonymise(docs, settings)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op2_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_settings(spark))
    return out.select("doc_id", "text", *[F.coalesce(F.try_element_at("pii", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])
