"""Quality rules: fixed base rules and robust multivariate outliers by minimum covariance determinant.

Every document has a vector of transformed statistics. Per language and source, concentration steps look for the
subset of ``core`` of the documents whose covariance has the least determinant: from each of two starts, medians with
median absolute deviations and the mean and covariance of all rows, estimate mean and covariance on the rows of smallest
distance until the determinant falls no more; the start that ends at the lesser determinant is taken. A group's estimate is
shrunk to its language's, and a language's to that of all rows, by one rule for groups of any size. A document goes if its
Mahalanobis distance from its group's estimate is over the cutoff. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, row_keys, same_row, small, table

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualitySettings:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Share of a group's rows that its estimate is made on; junk of up to the other rows can't move it.
    core: float = 0.5
    #: A group's steps end when the logarithm of its determinant falls by no more than this; no group takes over ``max_steps``.
    settled: float = 1e-4
    max_steps: int = 100
    #: Every group has an estimate of its own, to which its language's adds as much as so many rows do, as all rows' adds to
    #: a language's.
    prior_rows: int = 20
    #: Chance that a clean document of a normal group goes.
    tail: float = 1e-9
    #: The least standard deviation of each statistic; differences below it are no sign of anything.
    floors: tuple[tuple[str, float], ...] = (
        ("length", 1.0), ("word_length", 0.15), ("symbols", 0.08), ("dup_lines", 0.15), ("repeats", 0.12), ("capitals", 0.08),
    )


def _chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma, by its series."""
    a, t = k / 2, x / 2
    if t <= 0:
        return 0.0
    term = total = 1 / a
    n = 1
    while term > total * 1e-15:
        term *= t / (a + n)
        total += term
        n += 1
    return min(1.0, total * math.exp(-t + a * math.log(t) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def with_statistics(docs: DataFrame, settings: QualitySettings = QualitySettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, base columns, statistics) and ``keep`` of each row of ``docs``; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ("doc_id", "lang", "source", *keep)
    d = docs.select(*own, text.alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", WORD_BREAK), lambda w: w != ""))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        *own, "hashes", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
    )
    n = F.size("hashes")
    window = lambda i: F.struct(F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)).alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("windows", F.array_sort(F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(none)))
    again = lambda x, k: (F.get("windows", k - 1)["h"] == x["h"]) | (F.get("windows", k + 1)["h"] == x["h"])
    d = d.withColumn("starts", F.sort_array(F.transform(F.filter("windows", lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x["i"])))
    # each window that is found again covers the words, at most three, that the one before left
    covered = F.aggregate(
        "starts", F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")),
    )["n"]
    d = d.select(
        *own, "n_words", "word_chars", "n_symbols", "n_capitals", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
    )
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    failed = (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words"))
    return d.select(
        *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.log1p(F.col("n_words").cast("double")).alias("length"),
        F.log((F.col("word_chars") + 1) / (w + 1)).alias("word_length"),
        F.sqrt(F.col("n_symbols") / w).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / w).alias("repeats"),
        F.sqrt(F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capitals"),
    )


_LEVELS = (("g_lang", "g_source"), ("g_lang",), ("g_all",))


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from mean ``m_*`` by the inverse Cholesky factor ``w_*`` of the covariance."""
    total = F.lit(0.0)
    for i, _ in enumerate(names):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}"))
        total = total + y * y
    return total


def _with_inverse(moments: DataFrame, names: list[str], factor: float, floors: dict[str, float]) -> DataFrame:
    """From means ``m_i`` and covariances ``c_i_j`` the inverse Cholesky factor, column by column."""
    p = len(names)
    d = moments
    for i in range(p):
        for j in range(i + 1):
            c = F.col(f"c_{i}_{j}") * F.lit(factor)
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + F.lit(floors[names[i]] ** 2)
            for k in range(j):
                c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            d = d.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l_{j}_{j}"))
    for i in range(p):
        for j in range(i + 1):
            v = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
            d = d.withColumn(f"w_{i}_{j}", v / F.col(f"l_{i}_{i}"))
    return d.select(*moments.columns, *[f"w_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _core_factor(s: QualitySettings) -> float:
    """Makes the covariance of a normal group's core that of the whole group."""
    p = len(s.floors)
    return s.core / _chi2_cdf(chi2_quantile(s.core, p), p + 2)


def _shrunk(estimates: DataFrame, s: QualitySettings) -> DataFrame:
    """(g_lang, g_source, m_*, w_*) of each language and source. An estimate of n rows and its parent's are mixed with
    weights n and ``prior_rows``: means are averaged, and the covariance is that of such a mixture, so a small group that
    lies apart from its language is given room and not rejected."""
    names, floors = [n for n, _ in s.floors], dict(s.floors)
    p = len(names)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    own = [f"m_{i}" for i in range(p)] + [f"c_{i}_{j}" for i, j in cells]
    level = lambda n: estimates.filter(F.col("level") == n)

    def mixed(child: DataFrame, parent: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
        up = parent.select(*by, *[F.col(c).alias(f"p_{c}") for c in own])
        d = child.join(up, by).withColumn("a", F.col("group_rows") / (F.col("group_rows") + s.prior_rows))
        a, off = F.col("a"), [F.col(f"m_{i}") - F.col(f"p_m_{i}") for i in range(p)]
        mean = [(F.col(f"p_m_{i}") + a * off[i]).alias(f"m_{i}") for i in range(p)]
        return d.select(*keys, "group_rows", *mean, *[(a * F.col(f"c_{i}_{j}") + (1 - a) * F.col(f"p_c_{i}_{j}") + a * (1 - a) * off[i] * off[j]).alias(f"c_{i}_{j}") for i, j in cells])

    factor = _core_factor(s)
    whole = lambda d: d.withColumns({f"c_{i}_{j}": factor * F.col(f"c_{i}_{j}") for i, j in cells})
    languages = mixed(whole(level(1)).withColumn("g_all", F.lit("all")), whole(level(2)).withColumn("g_all", F.lit("all")), ["g_all"], ["g_lang"])
    groups = mixed(whole(level(0)), languages, ["g_lang"], ["g_lang", "g_source"])
    return _with_inverse(groups, names, 1.0, floors).drop("group_rows", *[f"c_{i}_{j}" for i, j in cells])


def _estimate(rows: DataFrame, s: QualitySettings) -> DataFrame:
    """(level, g_lang, g_source, group_rows, m_*, c_*, w_*, log_det): the estimate of each group of all levels from its own
    rows; log_det is the logarithm of the least determinant found, c_* the core's covariance as it is."""
    names, floors = [n for n, _ in s.floors], dict(s.floors)
    p = len(names)
    keys = ["level", "g_lang", "g_source"]
    at = [F.struct(F.lit(n).alias("level"), *[(F.col(k) if k in level else F.lit("")).alias(k) for k in keys[1:]]) for n, level in enumerate(_LEVELS)]
    rows = rows.select(F.explode(F.array(*at)).alias("at"), *names).select("at.*", *names)

    def joined(params: DataFrame) -> DataFrame:
        # a row for each group: broadcast within the bound, so that the rows of a large group stay where they are
        return rows.join(small(params, 2 * groups), keys)

    medians = rows.groupBy(*keys).agg(F.count("*").alias("group_rows"), *[F.percentile_approx(n, 0.5, 2000).alias(f"m_{i}") for i, n in enumerate(names)])
    medians = materialize(medians)
    groups = medians.count()
    spread = joined(medians).groupBy(*keys).agg(
        F.first("group_rows").alias("group_rows"), *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{i}")), 0.5, 2000).alias(f"d_{i}") for i, n in enumerate(names)],
    )
    robust = spread.select(
        *keys, F.lit(0).alias("start"), "group_rows", *[f"m_{i}" for i in range(p)],
        *[F.lit(0.0).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)],
        *[(1 / F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(floors[names[i]])) if i == j else F.lit(0.0)).alias(f"w_{i}_{j}") for i in range(p) for j in range(i + 1)],
    )

    def moments_of(df: DataFrame, by: list[str], *more: Column) -> DataFrame:
        return df.groupBy(*by).agg(
            F.first("group_rows").alias("group_rows"), *more, *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)],
        )

    whole = _with_inverse(moments_of(joined(medians.select(*keys, "group_rows")), keys), names, 1.0, floors).withColumn("start", F.lit(1))
    # a start isn't the estimate of a core, so nothing is settled by the first step
    params = robust.unionByName(whole).withColumns({"log_det": F.lit(float("inf")), "done": F.lit(False)})
    started = [*keys, "start"]
    factor = _core_factor(s)
    params = materialize(params)
    for _ in range(s.max_steps):
        moving = params.filter(~F.col("done"))
        near = joined(moving.select([c for c in moving.columns if c != "done" and not c.startswith("c_")])).withColumn("d", _distance(names)).select(*started, "group_rows", "log_det", *names, "d")
        limit = near.groupBy(*started).agg(F.percentile_approx("d", s.core, 2000).alias("limit"))
        core = near.join(small(limit, 2 * groups), started).filter("d <= limit")
        moments = moments_of(core, started, F.first("log_det").alias("log_det_before"))
        log_det = -2 * sum((F.log(f"w_{i}_{i}") for i in range(p)), F.lit(0.0))
        stepped = _with_inverse(moments, names, factor, floors).withColumn("log_det", log_det)
        stepped = stepped.withColumn("done", F.col("log_det_before") - F.col("log_det") <= s.settled).drop("log_det_before")
        params = materialize(stepped.unionByName(params.filter("done")))
        if not params.filter(~F.col("done")).head(1):
            break
    own = [c for c in params.columns if c not in (*started, "done")]
    best = params.groupBy(*keys).agg(F.min_by(F.struct(*own), F.struct("log_det", "start")).alias("best"))
    return best.select(*keys, "best.*")


def judge_quality(docs: DataFrame, settings: QualitySettings = QualitySettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) and the columns
    ``keep`` of each row.

    Null language or source is a group of its own; null and blank texts have no words and fail the base rule. A group of
    any size, of one row too, has its own estimate, shrunk to its language's. Repeated rows are judged alike;
    other columns of ``docs`` aren't read; an empty table gives no rows.
    """
    s = settings
    names = [n for n, _ in s.floors]
    rows = with_statistics(docs, s, keep)
    rows = rows.withColumns({"g_lang": F.concat(F.lit("="), F.coalesce("lang", F.lit(""))), "g_source": F.concat(F.lit("="), F.coalesce("source", F.lit("")))})
    rows = rows.withColumns({"g_lang": F.when(F.col("lang").isNull(), "").otherwise(F.col("g_lang")), "g_source": F.when(F.col("source").isNull(), "").otherwise(F.col("g_source"))})
    rows = materialize(rows.drop("lang", "source"))
    cutoff = chi2_quantile(1 - s.tail, len(names))
    estimates = materialize(_shrunk(_estimate(rows, s), s))
    judged = rows.join(small(estimates, estimates.count()), ["g_lang", "g_source"])
    judged = judged.withColumn("distance", _distance(names))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= F.lit(cutoff))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"), *keep)


def keep_good(docs: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whatever their doc_id, null and repeated ones too."""
    keyed = docs.withColumns(dict(zip(same_row, row_keys("text", "lang", "source"), strict=True)))
    good = judge_quality(keyed, settings, tuple(same_row)).filter("kept").select(*same_row)
    return keyed.join(good, same_row, "left_semi").select(docs.columns)


def op8_mcd_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("distance")
