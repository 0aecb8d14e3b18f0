"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts side by side.

Records are ordered by (hash of the text, hash of the record). A size-weighted sample of these keys gives the splitters
of many more ranges than shards; records are range-partitioned by them, the exact bytes of every range are summed, and a
range that is still overfull is subdivided at keys of its own sample. A group of equal texts that is a good part of a
shard has ranges of its own: it goes whole to the emptiest shard, and only one that has no room there is split. The
other ranges, in order, fill what room is left. The driver plans ranges and such groups, whose number follows from the
number of shards; whatever grows with the rows (cells of a range, running sums) stays on the executors.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small, table


@dataclass(frozen=True)
class ShardSettings:
    shards: int = 24
    #: Bytes counted for each record besides its text's.
    record_bytes: int = 8
    #: Ranges for each shard, and sampled keys for each range: what the driver plans with, whatever the number of rows.
    ranges_per_shard: int = 8
    samples_per_range: int = 40
    #: A range of more than so many times the mean bytes is subdivided.
    overfull: float = 2.0
    #: Rows of a cell, about: a range's running sum is taken cell by cell.
    rows_per_cell: int = 100_000
    #: A group of equal texts of more than this share of a shard's bytes is placed by the plan.
    planned_group: float = 0.01


Key = tuple[int, int]
_LOWEST = -(1 << 63)


def _weighted_sample(keyed: DataFrame, total: int, wanted: int) -> list[Key]:
    """Keys drawn with a chance in proportion to size, about ``wanted``; a record of many shares counts many times."""
    share = F.col("size") * F.lit(wanted / max(1, total))
    # a hash of the key stands for the draw, so that a repeated task draws the same
    draw = F.pmod(F.xxhash64("h", "d", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(share) + (draw < share - F.floor(share)).cast("int")).cast("int")
    drawn = keyed.select("h", "d", times.alias("n")).filter("n > 0")
    return sorted((r["h"], r["d"]) for r in drawn.collect() for _ in range(min(r["n"], wanted)))


def splitters(sample: list[Key], ranges: int, groups: set[int]) -> list[Key]:
    """Quantile keys. Within a hash of ``groups`` they are record keys, and it begins and ends at one; any other hash
    that is a quantile starts a range with its first record, so that its texts stay together."""
    at = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    own = {(h, d if h in groups else _LOWEST) for h, d in at}
    return sorted(own | {(h, _LOWEST) for h in groups} | {(h + 1, _LOWEST) for h in groups if h + 1 < 1 << 63})


def range_of(h: np.ndarray, d: np.ndarray, bounds: list[Key]) -> np.ndarray:
    """The number of the range of each key: how many of ``bounds`` aren't above it."""
    hs, ds = (np.array([b[i] for b in bounds], np.int64) for i in range(2))
    out = np.searchsorted(hs, h, side="right")
    first = np.searchsorted(hs, h, side="left")
    inside = np.flatnonzero(out - first > 1)  # hashes at which more than one range begins
    for x in np.unique(h[inside]):
        own = inside[h[inside] == x]
        a, z = int(first[own[0]]), int(out[own[0]])
        out[own] = a + np.searchsorted(ds[a:z], d[own], side="right")
    return out


def _range_column(bounds: list[Key]) -> Column:
    @F.pandas_udf("int")
    def find(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(range_of(h.to_numpy(), d.to_numpy(), bounds).astype("int32"))

    return find("h", "d")


Segment = tuple[int, float, float, int]  # range, first and last byte in it, shard


def _level(loads: list[float], more: float) -> float:
    """The height that shards reach if ``more`` bytes fill the emptiest ones up."""
    for n, load in enumerate(sorted(loads), 1):
        height = (more + sum(sorted(loads)[:n])) / n
        if n == len(loads) or height <= sorted(loads)[n]:
            return height
    return more


def plan_shards(sizes: list[int], records: list[int], group_of: list[int | None], shards: int) -> list[Segment]:
    """Which bytes of each range go to which shard, for ranges' ``sizes``, ``records`` and the group, if any, of each.

    Groups go whole to the emptiest shard, the largest first; one with no room there is cut over the emptiest shards,
    unless it is a single record. The other ranges fill the shards' room in order.
    """
    loads, left = [0.0] * shards, float(sum(sizes))
    out: list[Segment] = []

    def cut(ranges: list[int], order: list[int], room: list[float]) -> None:
        order = [s for s in order if room[s] > 0] or order[:1]
        for r in ranges:
            at = 0.0
            while len(order) > 1 and sizes[r] - at > room[order[0]]:
                s = order.pop(0)
                out.append((r, at, at + room[s], s))
                at, loads[s] = at + room[s], loads[s] + room[s]
            s = order[0]
            out.append((r, at, float("inf"), s))
            room[s] -= sizes[r] - at
            loads[s] += sizes[r] - at

    groups: dict[int, list[int]] = defaultdict(list)
    for r, g in enumerate(group_of):
        if g is not None:
            groups[g].append(r)
    for ranges in sorted(groups.values(), key=lambda x: (-sum(sizes[r] for r in x), x)):
        total, height = sum(sizes[r] for r in ranges), _level(loads, left)
        order = sorted(range(shards), key=lambda s: (loads[s], s))
        whole = loads[order[0]] + total <= height or sum(records[r] for r in ranges) == 1
        cut(ranges, order[:1] if whole else order, [height - x for x in loads])
        left -= total
    cut([r for r, g in enumerate(group_of) if g is None], list(range(shards)), [_level(loads, left) - x for x in loads])
    return out


def shard_by_bytes(docs: DataFrame, settings: ShardSettings = ShardSettings()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each record of ``docs`` (doc_id, text), as ``placed_records`` has them."""
    return placed_records(docs, settings).select("doc_id", "size", "text_crc32", "shard", "slot")


def placed_records(docs: DataFrame, settings: ShardSettings = ShardSettings()) -> DataFrame:
    """(doc_id, size, text_crc32, range, cell, unit, part, shard, slot, ...) of each record of ``docs`` (doc_id, text): no task
    numbers more than about ``rows_per_cell`` records, however many have one text.

    size is the text's UTF-8 bytes (null: none) plus ``record_bytes``. Shards' bytes differ by at most about one record
    or one small group of equal texts at each end. Equal texts, null as empty, are in one shard unless their group has
    room in none. slot counts a shard's records from 0. Rows with null or repeated doc_id are records like others;
    other columns aren't read; an empty table gives no rows.
    """
    spark, s = docs.sparkSession, settings
    text = F.coalesce("text", F.lit(""))
    keyed = materialize(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + s.record_bytes).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            # tells repeated rows apart, so that they too can be split
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("d"),
        )
    )
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # at most shards / planned_group rows, a number set by the plan
    large = keyed.groupBy("h").agg(F.sum("size").alias("size")).filter(F.col("size") > s.planned_group * total / s.shards)
    groups = {r["h"] for r in large.select("h").collect()}
    ranges = s.shards * s.ranges_per_shard
    bounds = splitters(_weighted_sample(keyed, total, ranges * s.samples_per_range), ranges, groups)

    def measured(bounds: list[Key]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        ranged = keyed.withColumn("range", _range_column(bounds))
        found = ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return ranged, {r["range"]: (r["size"], r["n"]) for r in found}

    ranged, sizes = measured(bounds)
    mean = total / ranges
    over = [r for r, (n, _) in sizes.items() if n > s.overfull * mean]
    if over:
        n = sum(sizes[r][0] for r in over)
        wanted = -(-2 * n // max(1, int(mean)))
        more = _weighted_sample(ranged.filter(F.col("range").isin(over)), n, wanted * s.samples_per_range)
        bounds = sorted({*bounds, *splitters(more, wanted, groups)})
        ranged, sizes = measured(bounds)

    group_of = [None, *[h if h in groups else None for h, _ in bounds]]
    n_bytes, n_rows = ([sizes.get(r, (0, 0))[i] for r in range(len(group_of))] for i in range(2))
    plan = plan_shards(n_bytes, n_rows, group_of, s.shards)
    edges = [(_LOWEST, _LOWEST), *bounds, ((1 << 63) - 1, _LOWEST)]
    cuts = []
    for r, g in enumerate(group_of):
        (h, d), (next_h, next_d) = edges[r], edges[r + 1]
        lo, hi = (h, next_h) if g is None else (d, next_d if next_h == h else (1 << 63) - 1)
        cuts.append((r, g is not None, float(lo), max(1.0, float(hi) - float(lo)), max(1, -(-n_rows[r] // s.rows_per_cell))))
    # as many rows as there are ranges, a number set by the plan
    cuts_df = F.broadcast(spark.createDataFrame(cuts, "range int, by_record boolean, lo double, width double, cells int"))
    plan_df = F.broadcast(spark.createDataFrame(plan, "at_range int, first double, last double, shard int"))

    place = F.when(F.col("by_record"), F.col("d")).otherwise(F.col("h")).cast("double") - F.col("lo")
    cell = F.greatest(F.lit(0), F.least(F.col("cells") - 1, F.floor(place / F.col("width") * F.col("cells")).cast("int")))
    # a record by itself where a group has to be split, else all equal texts: what is placed as one
    unit = F.when(F.col("by_record"), F.col("d")).otherwise(F.col("h"))
    celled = ranged.join(cuts_df, "range").withColumn("cell", cell).withColumn("unit", unit).drop("lo", "width", "cells")
    units = materialize(celled.groupBy("range", "cell", "unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    cells = materialize(units.groupBy("range", "cell").agg(F.sum("bytes").alias("bytes")))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("range", "cell", before.alias("cell_start"))
    in_cell = Window.partitionBy("range", "cell").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("cell_start") + F.sum("bytes").over(in_cell)
    summed = units.join(small(starts, cells.count()), ["range", "cell"]).withColumn("middle", upto - F.col("bytes") / 2)
    on = (F.col("range") == F.col("at_range")) & (F.col("middle") >= F.col("first")) & (F.col("middle") < F.col("last"))
    placed = materialize(summed.join(plan_df, on).select("range", "cell", "unit", "n", "shard"))
    counts = materialize(placed.groupBy("shard", "range", "cell").agg(F.sum("n").alias("n")))
    earlier = lambda by, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("shard", "range", "cell", earlier(["shard"], "range", "cell").alias("base"))
    first = earlier(["shard", "range", "cell"], "unit")
    placed = placed.withColumn("first", first).join(small(bases, counts.count()), ["shard", "range", "cell"])
    placed = materialize(placed.select("range", "cell", "unit", "n", "shard", (F.col("base") + F.col("first")).alias("base")))
    return _numbered(celled, placed, s)


_UNIT = ["range", "cell", "unit"]


def _numbered(rows: DataFrame, placed: DataFrame, s: ShardSettings) -> DataFrame:
    """``rows`` with shard, slot and part: a unit of more rows than a cell should have is dealt to parts by record hash, so
    that no task numbers all of it; parts follow one another by their counts."""
    parts = F.ceil(F.col("n") / s.rows_per_cell).cast("long")
    large = placed.filter(F.col("n") > s.rows_per_cell).select(*_UNIT, parts.alias("parts"))
    n_large = large.count()
    # within small()'s bound this is one row for every rows_per_cell records of large units
    parted = rows.join(small(large, n_large), _UNIT, "left").withColumn("part", F.coalesce(F.pmod(F.col("d"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    own = parted.filter("part IS NOT NULL")
    sizes = materialize(own.join(small(large.select(*_UNIT), n_large), _UNIT, "left_semi").groupBy(*_UNIT, "part").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy(*_UNIT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*_UNIT, "part", F.coalesce(before, F.lit(0)).alias("before"))
    # a row for each part of a unit, so that parts are keys of their own in the join
    places = placed.join(starts, _UNIT, "left").select(*_UNIT, F.coalesce("part", F.lit(0).cast("long")).alias("part"), "shard", (F.col("base") + F.coalesce("before", F.lit(0))).alias("base"))
    within = F.row_number().over(Window.partitionBy(*_UNIT, "part").orderBy("d")) - 1
    return own.join(places, [*_UNIT, "part"]).withColumn("slot", (F.col("base") + within).cast("long"))


def write_shards(docs: DataFrame, path: str, settings: ShardSettings = ShardSettings()) -> None:
    """Write ``docs`` (unique doc_id) under ``path``, a folder for each shard, rows in slot order within a file."""
    where = shard_by_bytes(docs, settings).select("doc_id", "shard", "slot")
    files = docs.join(where, "doc_id").repartition("shard", F.floor(F.col("slot") / settings.rows_per_cell))
    files.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sampled_splitter_shards(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
