"""Span functions on columns: all matches with their places, and greedy choice of disjoint spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_before(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """For an array of ints what ``join`` (associative, ``zero`` changing nothing) makes of ``zero`` and all those before each.

    Each pass joins every value with the one 1, 2, 4, ... places before it, so the time is the length times its logarithm.
    """

    moved = lambda v, n: F.slice(F.concat(F.array_repeat(F.lit(zero), n), v), F.lit(1), F.size(v))
    distances = F.array(*[F.lit(1 << k) for k in range(31)])

    def scan(v: Column) -> Column:
        return F.aggregate(F.filter(distances, lambda n: n < F.size(v)), v, lambda w, n: F.zip_with(moved(w, n), w, join))

    return let(let(values, scan), lambda v: moved(v, F.lit(1)))


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, offsets in code points from 0. Null text gives an empty array."""
    text = F.coalesce(text, F.lit(""))

    def placed(found: Column, gaps: Column) -> Column:
        before = running_before(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda a, n: a + n, 0)
        starts = F.zip_with(before, gaps, lambda at, g: at + F.length(g))
        return F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value")))

    def spans(whole: Column) -> Column:
        gaps = lambda found: F.slice(F.split(whole, pattern, -1), F.lit(1), F.size(found))
        return let(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda found: let(gaps(found), lambda g: placed(found, g)))

    return F.when(text.rlike(pattern), spans(text).cast(EMPTY)).otherwise(F.array().cast(EMPTY))


def overlap_groups(spans: Column) -> Column:
    """``spans`` (structs with int start and end) cut into groups, by place, such that none overlaps one of another group."""

    def cut(placed: Column) -> Column:
        reach = running_before(F.transform(placed, lambda y: y["end"]), lambda a, n: F.greatest(a, n), -1)
        apart = F.zip_with(placed, reach, lambda y, end: y["start"] >= end)
        firsts = F.filter(F.transform(apart, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(firsts, F.lit(2), F.greatest(F.size(firsts) - 1, F.lit(0))), F.array(F.size(placed)))
        return F.zip_with(firsts, ends, lambda i, j: F.transform(F.slice(placed, i + 1, j - i), lambda y: y["x"]))

    placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x.alias("x"))))
    return let(placed, lambda p: F.when(F.size(p) > 0, cut(p)).otherwise(F.array()))


def greedy_disjoint(spans: Column, kind: str) -> Column:
    """Of ``spans`` (of type ``kind``, with start and end), in the order of their structs, each that overlaps none taken before.

    A choice depends only on spans of its own group of overlaps, which is small in running text.
    """

    def step(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(x)))

    choose = lambda group: F.when(F.size(group) == 1, group).otherwise(F.aggregate(F.array_sort(group), F.array().cast(kind), step))
    return F.flatten(F.transform(overlap_groups(spans), choose)).cast(kind)


def replace_spans(text: Column, spans: Column, put) -> Column:
    """``text`` with each of ``spans`` (disjoint, by start) replaced by ``put(span, index)``."""
    n = F.size(spans)

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        end = F.when(i == n, F.length(text)).otherwise(F.get(spans, i)["start"])
        gap = F.substring(text, begin + 1, end - begin)
        return F.concat(gap, F.when(i < n, put(F.get(spans, i), i)).otherwise(F.lit("")))

    return F.when(n == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n), piece), ""))
