"""Fill-in-the-middle transformation: texts cut between units into prefix, middle and suffix, and put in another order.

One match of ``(unit)*`` over the whole text keeps the end of every repetition, so the list of ends is the number of
units and has both places to cut at. Only these three numbers leave Python; texts are cut, joined and put back by
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import table


@dataclass(frozen=True)
class FimSettings:
    #: Lines with their ends; what a pattern doesn't cover entirely stays plain.
    unit: str = r"[^\n]*\n|[^\n]+"
    seed: int = 7
    #: Texts of a hundred that are transformed, and of a hundred of these such with the suffix first.
    rate: int = 100
    suffix_first: int = 50
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def __post_init__(self) -> None:
        """Marks must be told apart wherever they stand: no end of one begins another, none holds another."""
        marks = (self.prefix_mark, self.suffix_mark, self.middle_mark)
        ends = {m[i:] for m in marks for i in range(1, len(m))}
        if len(set(marks)) < 3 or not all(marks) or any(n.startswith(e) for n in marks for e in ends) or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("marks must differ, and none may overlap or hold another")


def unit_ends(text: str, unit: str) -> list[int] | None:
    """Ends of the units of ``text``, one after another from its start; None where they don't cover it."""
    # atomic and possessive: units are taken left to right, and no state is kept to go back to
    found = regex.fullmatch(f"((?>{unit}))*+", text)
    return found.ends(1) if found else None


def _cutter(unit: str):
    @F.pandas_udf("n long, first long, second long")
    def cuts(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        """Units, and where prefix and middle end: after a and b modulo one more than the units, the smaller first."""
        rows = []
        for t, x, y in zip(text, a, b, strict=True):
            ends = unit_ends(t, unit)
            if ends is None:
                rows.append((0, None, None))
                continue
            n = len(ends)
            i, j = sorted((int(x) % (n + 1), int(y) % (n + 1)))
            rows.append((n, ends[i - 1] if i else 0, ends[j - 1] if j else 0))
        return pd.DataFrame(rows, columns=["n", "first", "second"]).astype("Int64")

    return cuts


def fill_in_middle(docs: DataFrame, settings: FimSettings | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n (units), form (plain, psm or spm), output, prefix_chars and middle_chars.

    Where to cut and which form follow from doc_id and the seed alone, so a text has the same result in every run and
    repeated rows agree; a null doc_id counts as the empty string. A null text is empty. Empty texts and those with a
    mark in them are plain: their output is the text, and prefix_chars and middle_chars are null. Columns of ``docs``
    with one of these names are replaced, all others kept. An empty table gives an empty result. A text is one value: it is
    never cut into rows, and the ends of its units (a number each) are all that Python holds besides it.
    """
    s = settings or FimSettings()
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = _cutter(s.unit)(text, number(0), number(1))
    marked = F.lit(False)
    for mark in (s.prefix_mark, s.suffix_mark, s.middle_mark):
        marked = marked | F.contains(text, F.lit(mark))
    own = ["n", "form", "output", "prefix_chars", "middle_chars"]
    kept = [c for c in docs.columns if c.lower() not in own]
    # the names with two underscores last for these two steps only
    known = docs.select(*kept, cut.alias("__cut"), number(2).alias("__rate"), number(3).alias("__order"))
    form = F.when((text == "") | marked | F.col("__cut.first").isNull() | (F.col("__rate") % 100 >= s.rate), "plain").when(F.col("__order") % 100 < s.suffix_first, "spm").otherwise("psm")
    known = known.select(*kept, F.col("__cut.n").alias("n"), form.alias("form"), F.col("__cut.first").alias("__first"), F.col("__cut.second").alias("__second"))
    first, second = F.col("__first").cast("int"), F.col("__second").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.lit(2**31 - 1))
    p, m, x = F.lit(s.prefix_mark), F.lit(s.middle_mark), F.lit(s.suffix_mark)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, x, suffix, m, middle)).when(F.col("form") == "spm", F.concat(x, suffix, p, prefix, m, middle)).otherwise(text)
    turned = F.col("form") != "plain"
    return known.select(*kept, "n", "form", output.alias("output"), F.when(turned, F.col("__first")).alias("prefix_chars"), F.when(turned, F.col("__second") - F.col("__first")).alias("middle_chars"))


def restored(output: Column, form: Column, settings: FimSettings | None = None) -> Column:
    """The text that an ``output`` of ``fill_in_middle`` was made of; its marks stand just once in it."""
    s = settings or FimSettings()
    p, x, m = s.prefix_mark, s.suffix_mark, s.middle_mark
    at = lambda mark: F.position(F.lit(mark), output)
    between = lambda a, b: F.substring(output, at(a) + len(a), (at(b) if b else F.lit(2**31 - 1)) - at(a) - len(a))
    return F.when(form == "psm", F.concat(between(p, x), between(m, None), between(x, m))).when(form == "spm", F.concat(between(p, m), between(m, None), between(x, p))).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_UNITS = r"string_split(text, chr(10))"
#: DuckDB: units are the parts between line ends, each with its line end, without an empty last one.
OP13_SQL = f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    u AS (SELECT doc_id, text, d, {_UNITS} AS s, CASE WHEN text = '' THEN 0 WHEN right(text, 1) = chr(10) THEN len({_UNITS}) - 1 ELSE len({_UNITS}) END AS n FROM h),
    k AS (SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS a, ('0x' || d[9:16])::BIGINT % (n + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || d[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    c AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j FROM k),
    e AS (SELECT *, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)), 0)::BIGINT AS e1, coalesce(list_sum(list_transform(s[1:j], lambda x: length(x) + 1)), 0)::BIGINT AS e2 FROM c),
    p AS (SELECT *, least(e1, length(text)) AS f, least(e2, length(text)) AS g FROM e),
    t AS (SELECT *, left(text, f) AS pre, substr(text, f + 1, g - f) AS mid, substr(text, g + 1) AS suf FROM p)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN f END AS prefix_chars, CASE WHEN form <> 'plain' THEN g - f END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM t"""
