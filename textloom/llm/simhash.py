"""SimHash near-duplicate detection by generalised pigeonhole search.

Fingerprints are 64-bit majority votes over hashed word shingles. Two fingerprints link at
``max_bits`` or fewer differing bits. Search follows the generalised pigeonhole principle: the 64
bits are split into parts, each part i gets its own radius t_i with sum(t_i) = max_bits - parts + 1
(-1 leaves a part out), and every linked pair agrees to within t_i bits in at least one part. Bits
that correlate go into the same part, and the radii come from dynamic programming over estimated
candidate counts. Every fingerprint is filed under its own value of each part and under all values
within the part's radius; rows that share a key are verified on all 64 bits. A key that very many fingerprints share is
searched the same way again on the bits that it leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, partitions_for, row_keys, same_row, small, table
from textloom.llm.components import connected_components


@dataclass(frozen=True)
class SimHashSettings:
    shingle_words: int = 4
    seed: int = 42
    max_bits: int = 4
    #: Fingerprints, at most, that the driver takes to plan parts and radii; the result doesn't depend on them.
    plan_sample: int = 4000
    #: A key with more fingerprints than this isn't searched in one task: they are filed anew by parts of the bits left
    #: open, so often, and what is still as dense then is searched by midpoints.
    hot_value: int = 2048
    refinements: int = 2
    #: Rows of a key table that one task holds at a time (16 bytes each).
    rows_per_task: int = 1_500_000


def fingerprint_text(text: str | None, k: int, seed: int) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, k = max(1, len(words) - k + 1), min(k, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64,
        n,
    )
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, settings: SimHashSettings, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``keep`` for each row of ``docs``; null and empty texts have fingerprint 0."""
    k, seed = settings.shingle_words, settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint_text(texts[i].as_py(), k, seed) for i in range(len(texts))]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind(id_col)}", "fp bigint", *[f"{c} {kind(c)}" for c in keep]])
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    radius: int
    masks: tuple[int, ...] = field(repr=False, default=())


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of even size; each group takes the bits that correlate most with those it has."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, 64).astype(float)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-9)
    left, groups = set(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        rest = sorted(left)
        first = max(rest, key=lambda b: (corr[b, rest].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _extract(fps: np.ndarray, bits: tuple[int, ...] | list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def ball(width: int, radius: int) -> tuple[int, ...]:
    """All xor masks of at most ``radius`` bits; none for radius -1."""
    return tuple(sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r))


def plan_parts(sample: np.ndarray, total: int, max_bits: int) -> list[Part]:
    """Parts and radii of least estimated cost for ``total`` fingerprints, of which ``sample`` is a sample.

    The cost of radius t in a part is the keys it files plus the candidate pairs it meets, scaled up from
    sampled pairs. For each number of parts, dynamic programming over (part, radii spent) finds the best split.
    """
    s = sample.astype(np.int64).view(np.uint64)
    scale = (total / max(1, len(s))) ** 2
    best: tuple[float, list[Part]] | None = None
    for m in range(2, max_bits + 2):
        groups = group_bits(sample, m)
        spend = max_bits - m + 1
        costs: list[dict[int, float]] = []
        for g in groups:
            values = _extract(s, g)
            near = np.zeros(spend + 1)
            for i in range(0, len(values), 512):
                d = np.bitwise_count(values[i : i + 512, None] ^ values[None, :])
                near += [(d <= t).sum() for t in range(spend + 1)]
            pairs = (near - len(values)) * scale
            keys = np.cumsum([comb(len(g), t) for t in range(spend + 1)])
            # filing and sorting a key costs about as much as some verified pairs
            costs.append({-1: 0.0} | {t: 8.0 * total * (keys[t] + 1) + max(0.0, pairs[t]) for t in range(spend + 1)})
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, radii) in table.items():
                for t, extra in cost.items():
                    key = spent + t
                    if key <= spend and (key not in nxt or c + extra < nxt[key][0]):
                        nxt[key] = (c + extra, [*radii, t])
            table = nxt
        if spend in table and (best is None or table[spend][0] < best[0]):
            radii = table[spend][1]
            best = (
                table[spend][0],
                [Part(tuple(g), t, ball(len(g), t)) for g, t in zip(groups, radii, strict=True) if t >= 0],
            )
    assert best is not None
    return best[1]


def _mixed(key: np.ndarray, part: int, value: np.ndarray) -> np.ndarray:
    """One number for a key so far, a part and its value; a chance collision only makes two groups one, which is verified."""
    x = (key ^ (value * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(part + 1) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


_KEYS = "key bigint, used bigint, fp bigint"


def _key_rows(key: np.ndarray, used: int, fp: np.ndarray) -> pa.RecordBatch:
    signed = used - (1 << 64) if used >> 63 else used
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(len(key), signed)), pa.array(fp.view(np.int64))], names=["key", "used", "fp"])


def _bit_mask(bits: tuple[int, ...] | list[int]) -> int:
    return sum(1 << b for b in bits)


def _keys(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """(key, used, fp): every fingerprint under all values within the radius of each part; used has the part's bits."""
    masks = [np.array(p.masks, np.uint64) for p in parts]
    bits = [p.bits for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            step = max(1, 200_000 // max(1, sum(map(len, masks))))
            for i in range(0, len(all_fps), step):
                u = all_fps[i : i + step]
                for n, (b, m) in enumerate(zip(bits, masks, strict=True)):
                    values = (_extract(u, b)[:, None] ^ m[None, :]).ravel()
                    yield _key_rows(_mixed(np.zeros(1, np.uint64), n, values), _bit_mask(b), np.repeat(u, len(m)))

    return fps.mapInArrow(run, _KEYS)


def _refiled(rows: DataFrame, order: list[int], max_bits: int) -> DataFrame:
    """Rows of shared keys filed anew: the bits that a key leaves open, in ``order``, are cut into one part more than
    bits may differ, so that every linked pair of a key agrees in a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, used, fp = (c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns)
            for mask in np.unique(used).tolist():
                own = np.flatnonzero(used == np.uint64(mask))
                left = [b for b in order if not mask >> b & 1]
                for n, bits in enumerate(np.array_split(left, max_bits + 1)):
                    yield _key_rows(_mixed(key[own], n, _extract(fp[own], bits.tolist())), mask | _bit_mask(bits.tolist()), fp[own])

    return rows.mapInArrow(run, _KEYS)


def link_group(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the distinct fingerprints ``fps`` (uint64) into their components: breadth first, one a member."""
    found, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                hit, left = left[near], left[~near]
                found += [(int(x), int(y)) for y in hit]
                queue.extend(hit)
    return found


def _links(keys: DataFrame, tasks: int, max_bits: int) -> DataFrame:
    """(a, b): links found among rows (key, fp) that share a key; at most about one a row of a large group."""

    def signed(x: np.ndarray) -> pa.Array:
        return pa.array(x.astype(np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not cols:
            return
        key, fp = (np.concatenate([c[i] for c in cols]) for i in range(2))
        cols.clear()
        fp = fp.astype(np.int64).view(np.uint64)
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(fp)))
        row_size = np.repeat(sizes, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        few = 6
        for d in range(1, few):
            ok = (group[d:] == group[:-d]) & (row_size[d:] <= few)
            a, b = fp[:-d][ok], fp[d:][ok]
            near = np.bitwise_count(a ^ b) <= max_bits
            if near.any():
                yield pa.record_batch([signed(a[near]), signed(b[near])], names=["a", "b"])
        for g in np.flatnonzero(sizes > few):
            links = link_group(fp[starts[g] : starts[g] + sizes[g]], max_bits)
            if links:
                pairs = np.array(links, np.uint64)
                yield pa.record_batch([signed(pairs[:, 0].copy()), signed(pairs[:, 1].copy())], names=["a", "b"])

    return keys.select("key", "fp").repartition(tasks, "key").mapInArrow(run, "a bigint, b bigint")


def _midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links that connect all of ``fps`` within ``max_bits`` of each other, in rows linear in their number.

    Two fingerprints differ in at most r1 + r2 bits exactly if some value lies within r1 of one and r2 of the
    other. Each is filed under every value within half of ``max_bits``; all that meet at a value link to the
    smallest there. (An odd ``max_bits`` files one more ring on one side, so meetings are checked again.)
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in ball(64, -(-max_bits // 2))]
    filed = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.bitwiseXOR(F.col("fp")))).alias("at"))
    first = filed.groupBy("at").agg(F.min("fp").alias("a"))
    links = filed.join(first, "at").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    if max_bits % 2:
        links = links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return links


def _all_links(fps: DataFrame, parts: list[Part], s: SimHashSettings) -> DataFrame:
    """(a, b): links that join all fingerprints ``fps`` within ``max_bits`` of each other."""
    spark, found = fps.sparkSession, []
    order = [b for p in parts for b in p.bits]
    order += [b for b in range(64) if b not in order]
    keys = _keys(fps, parts)
    for level in range(s.refinements + 1):
        keys = materialize(keys)
        counts = keys.groupBy("key").count()
        hot = materialize(counts.filter(F.col("count") > s.hot_value).select("key"))
        n_hot, n_keys = hot.count(), keys.count()
        single = keys.join(small(hot, n_hot), "key", "left_anti") if n_hot else keys
        found.append(_links(single, partitions_for(spark, n_keys, s.rows_per_task), s.max_bits))
        if not n_hot:
            break
        shared = keys.join(small(hot, n_hot), "key", "left_semi").select("key", "used", "fp")
        if level < s.refinements:
            keys = _refiled(shared, order, s.max_bits)
        else:
            found.append(_midpoint_links(shared.select("fp").distinct(), s.max_bits))
    return reduce(DataFrame.unionByName, found)


def _labelled(docs: DataFrame, id_col: str, text_col: str, s: SimHashSettings, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, label, component_id) and ``keep`` of each row; label is the smallest fingerprint of the component."""
    rows = materialize(with_fingerprints(docs, id_col, text_col, s, keep))
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    total = fps.count()
    fps = fps.withColumns({"label": F.col("fp"), "component_id": F.col("first_id")})
    if total > 1:
        share = min(1.0, 2 * s.plan_sample / total)
        sample = fps.select("fp").sample(share, seed=1).limit(s.plan_sample).toPandas()["fp"].to_numpy()
        parts = plan_parts(sample if len(sample) > 1 else np.array([0, 1]), total, s.max_bits)
        labels = connected_components(_all_links(fps.select("fp"), parts, s)).select(F.col("node").alias("fp"), F.col("label").alias("found"))
        fps = fps.select("fp", "first_id").join(labels, "fp", "left").select("fp", "first_id", F.coalesce("found", "fp").alias("label"))
        fps = materialize(fps)
        fps = fps.join(fps.groupBy("label").agg(F.min("first_id").alias("component_id")), "label")
    fps = materialize(fps.select("fp", "label", "component_id"))
    return rows.join(fps, "fp")


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: SimHashSettings = SimHashSettings()
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest id that links reach, the row's own included; null ids are passed over, and a component
    of nothing else has none. Null, empty and blank texts have fingerprint 0 and link like any other; repeated rows
    share a fingerprint; an empty table gives no rows. Columns of ``docs`` other than the two named aren't read.
    Fingerprints are taken once per distinct value from here on, so copies are never paired with each other.
    """
    return _labelled(docs, id_col, text_col, settings).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id, ids before null, and of
    several rows with that id the one whose text has the smallest hash; of repeated rows one stays."""
    keyed = docs.withColumns(dict(zip(same_row, row_keys("text"), strict=True)))
    rows = _labelled(keyed, "doc_id", "text", settings, tuple(same_row))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), *same_row)).alias("best"))
    # rows meet their verdict by a shuffle, and repeated ones are then side by side
    return keyed.join(best.select("best.*").select(*same_row), same_row, "left_semi").dropDuplicates(same_row).select(docs.columns)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

