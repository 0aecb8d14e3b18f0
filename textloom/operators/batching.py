"""Selecting segments, their context, and greedy token-bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.text import estimate_tokens


@dataclass(frozen=True)
class BatchLimits:
    max_segments: int = 20
    max_tokens: int = 6000

    def smaller(self) -> BatchLimits:
        """The limits of a second try: half as many, rounded up."""
        return BatchLimits(-(-self.max_segments // 2), -(-self.max_tokens // 2))


def greedy_batches(segments: DataFrame, keys: list[str], order: list[str], limits: BatchLimits, tokens: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    """``segments`` (keys, order, text) with tokens and batch, numbered from 0 within each of ``keys``.

    A batch takes segments in order while both limits hold; one over the token limit stands alone. The walk is an
    aggregate over one key's ordered token counts, so a key's counts must fit a task: sections and documents do.
    """
    s = segments.withColumn("tokens", tokens(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct(*order, "tokens", *[c for c in s.columns if c not in (*keys, *order, "tokens")])))
    g = s.groupBy(*keys).agg(rows.alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        big = r["tokens"] > limits.max_tokens
        fresh = big | acc["alone"] | (acc["n"] >= limits.max_segments) | (acc["sum"] + r["tokens"] > limits.max_tokens)
        b = F.when(acc["n"] == 0, acc["b"]).when(fresh, acc["b"] + 1).otherwise(acc["b"])
        new = fresh | (acc["n"] == 0)
        return F.struct(
            b.alias("b"), F.when(new, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.when(new, r["tokens"]).otherwise(acc["sum"] + r["tokens"]).alias("sum"), big.alias("alone"),
            F.concat(acc["out"], F.array(b)).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(False).alias("alone"), F.array().cast("array<bigint>").alias("out"))
    g = g.withColumn("batch", F.aggregate("rows", start, step)["out"])
    return g.select(*keys, F.inline(F.arrays_zip("rows", "batch"))).select(*keys, "rows.*", "batch")


def context_window(segments: DataFrame, key: str, order: str, reach: int = 2, chars: int = 2000) -> DataFrame:
    """``segments`` with before and after: the texts of up to ``reach`` neighbours, cut at the far end."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(-reach, -1)), "\n")
    after = F.array_join(F.collect_list("text").over(w.rowsBetween(1, reach)), "\n")
    return segments.withColumns({"before": F.when(F.length(before) > chars, F.substring(before, -chars, chars)).otherwise(before), "after": F.substring(after, 1, chars)})


def run_model(requests: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(pair_id, target) of ``requests`` (pair_id, source): the model is loaded once a task and called on Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            yield pd.DataFrame({"pair_id": f["pair_id"], "target": model(f["source"].tolist())})

    return requests.select("pair_id", "source").mapInPandas(run, "pair_id long, target string")


@dataclass(frozen=True)
class Provider:
    """A model by name: whether it answers, and how a task loads it."""

    name: str
    healthy: Callable[[], bool]
    load: Callable[[], Callable[[list[str]], list[str]]]


def run_first_healthy(requests: DataFrame, providers: list[Provider]) -> DataFrame:
    """(pair_id, target, provider) by the first of ``providers`` that is healthy; an error if none is."""
    chosen = next((p for p in providers if p.healthy()), None)
    if chosen is None:
        raise RuntimeError("no provider is healthy: " + ", ".join(p.name for p in providers))
    return run_model(requests, chosen.load).withColumn("provider", F.lit(chosen.name))


def final_status(total: Column, good: Column, warned: Column) -> Column:
    return F.when(good == 0, "FAILED").when(good < total, "PARTIALLY_COMPLETED").when(warned > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")


RETRY_LEVELS = (("SAME", 2), ("SMALLER", 2), ("SINGLE", 1), ("REDUCED_CONTEXT", 1))


def retry_level(attempts: Column) -> Column:
    """The level of the next try after so many, MANUAL_REVIEW when all are used."""
    out, upto = None, 0
    for name, times in RETRY_LEVELS:
        upto += times
        out = F.when(attempts < upto, name) if out is None else out.when(attempts < upto, name)
    return out.otherwise("MANUAL_REVIEW")


_RESPONSE = "segments array<struct<id:bigint,text:string>>, _bad string"


def response_code(raw: Column, known: Column) -> Column:
    """OK, or what is wrong with a raw response {"segments": [{"id", "text"}, ...]} to a batch of ``known`` ids: a Markdown
    wrapper, no JSON, another shape, a repeated, unknown or missing id, or a blank text, in this order."""
    j = F.from_json(raw, _RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ids, tidy = F.transform(j["segments"], lambda x: x["id"]), F.trim(F.regexp_replace(raw, r"\A\s+|\s+\z", ""))
    shapeless = j["segments"].isNull() | F.exists(j["segments"], lambda x: x["id"].isNull() | x["text"].isNull())
    return (
        F.when(tidy.startswith("```") | tidy.endswith("```"), "MARKDOWN_WRAPPER").when(j["_bad"].isNotNull() | j.isNull(), "INVALID_JSON").when(shapeless, "SCHEMA_MISMATCH")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE_SEGMENT").when(F.size(F.array_except(ids, known)) > 0, "UNKNOWN_SEGMENT_ID")
        .when(F.size(F.array_except(known, ids)) > 0, "MISSING_SEGMENT").when(F.exists(j["segments"], lambda x: F.trim(x["text"]) == ""), "EMPTY_TRANSLATION").otherwise("OK")
    )
