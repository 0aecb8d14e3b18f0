"""Record operators: state changes, latest versions, paging, audits, manifests and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each of ``keys`` by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int) -> DataFrame:
    """``size`` rows after the given key, by (column, descending) pairs: a lexicographic filter and a top-k."""
    if after is not None:
        rule, tied = F.lit(False), F.lit(True)
        for (c, down), value in zip(order, after, strict=True):
            rule = rule | (tied & (F.col(c) < F.lit(value) if down else F.col(c) > F.lit(value)))
            tied = tied & (F.col(c) == F.lit(value))
        df = df.filter(rule)
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(size)


def apply_requests(state: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of change requests (key, expected): NOT_FOUND, CONFLICT, LOCKED or APPLIED."""
    j = requests.join(state.select(key, "revision", "status", F.lit(True).alias("found")), key, "left")
    outcome = F.when(F.col("found").isNull(), "NOT_FOUND").when(F.col("revision") != F.col("expected"), "CONFLICT").when(F.col("status") == "LOCKED", "LOCKED").otherwise("APPLIED")
    return j.select(key, outcome.alias("outcome"))


def compare_catalogues(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, outcome) of two catalogues: SAME, CHANGED, MISSING (only in ``a``) or EXTRA (only in ``b``)."""
    x, y = a.select(key, F.col(value).alias("x"), F.lit(1).alias("in_a")), b.select(key, F.col(value).alias("y"), F.lit(1).alias("in_b"))
    outcome = F.when(F.col("in_b").isNull(), "MISSING").when(F.col("in_a").isNull(), "EXTRA").when(F.col("x").eqNullSafe(F.col("y")), "SAME").otherwise("CHANGED")
    return x.join(y, key, "full").select(key, outcome.alias("outcome"))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, h) of each table: its rows and the sum of their hashes, which no order or cut into files changes."""
    from functools import reduce

    one = lambda name, df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("h")).select(F.lit(name).alias("name"), "n", "h")
    return reduce(DataFrame.unionByName, [one(k, df) for k, df in tables.items()])


def missing_references(child: DataFrame, column: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, value, n): values of ``child`` that ``parent`` lacks."""
    lost = child.select(F.col(column).alias("value")).join(parent.select(F.col(parent_key).alias("value")), "value", "left_anti")
    return lost.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "value", "n")


def fold_changes(log: DataFrame, key: str, order: list[str], action: str) -> DataFrame:
    """(key, state, revision): the state after a log of edit, lock, unlock and approve; what isn't allowed is skipped."""
    g = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("action")))).alias("log"))

    def step(acc: Column, e: Column) -> Column:
        s, a = acc["state"], e["action"]
        to = F.when((s != "LOCKED") & (a == "edit"), "EDITED").when((s != "LOCKED") & (a == "approve"), "APPROVED").when(a == "lock", "LOCKED").when((s == "LOCKED") & (a == "unlock"), "EDITED").otherwise(s)
        return F.struct(to.alias("state"), (acc["revision"] + (to != s).cast("int")).alias("revision"))

    start = F.struct(F.lit("NEW").alias("state"), F.lit(0).alias("revision"))
    return g.select(key, F.aggregate("log", start, step).alias("s")).select(key, "s.state", F.col("s.revision").cast("long").alias("revision"))


def recommendation(success: Column, critical: Column) -> Column:
    return F.when((critical > 0) | (success < 0.5), "REJECTED").when(success >= 0.98, "DEFAULT").when(success >= 0.8, "EXPERIMENTAL").otherwise("FALLBACK_ONLY")
