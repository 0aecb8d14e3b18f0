"""Removal of word passages that an earlier document already has, found by fixed-block anchors.

A passage of ``window`` words holds a whole block of half as many words wherever it starts, if blocks are laid end to
end. So blocks of every text are indexed and every rolling window of block length is a probe. A probe that meets a
block of a smaller doc_id, and a block that is met by a larger one, are anchors; only windows around anchors are
compared in full, which extends the anchors to the maximal exact repeats. Anchors can be more than the true repeats
but never fewer, and whole-window keys of 128 bits decide.

Documents whose words are all those of a smaller document are settled first: they lose everything, and their first copy
stands for them everywhere else. Window keys travel as packed columns, one row for a task's batch and bucket, so that a
shuffled key takes a few bytes. What a batch can decide by itself it doesn't send: of equal keys in one batch only the
smallest indexed document and the largest one go on, however common the passage is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, partitions_for, small, table


@dataclass(frozen=True)
class RepeatSettings:
    #: Words in a window; a block has half as many.
    window: int = 50
    #: Keys that one bucket, and the task that decides it, holds, about.
    keys_per_bucket: int = 1_000_000
    #: Words that a task turns into keys at a time.
    words_per_batch: int = 1_000_000


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def rolling_keys(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A 64-bit key of every run of ``size`` word hashes (uint64, arithmetic modulo 2**64)."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.multiply(words, _powers(base, n), out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    keys = sums[size:] - sums[:-size]
    keys *= _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(keys))
    return _mix(keys)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word of ``texts`` (split at ASCII white space, null: none) and each text's first word."""
    cuts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = cuts.flatten(), cuts.offsets.to_numpy().astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(keep)))[offsets - offsets[0]]
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    digest = xxhash.xxh3_128_digest
    own = np.frombuffer(b"".join([digest(w) for w in coded.dictionary.to_pylist()]), "<u8").reshape(-1, 2)
    where = coded.indices.to_numpy()
    return own[where, 0], own[where, 1], starts


@dataclass
class Entries:
    """Keys with the document and word that each starts at; indexed ones are references for others.

    ``more`` holds another 64 bits of each key, or None where one hash tells keys apart well enough.
    """

    key: np.ndarray
    more: np.ndarray | None
    doc: np.ndarray
    pos: np.ndarray
    indexed: np.ndarray

    def take(self, which: np.ndarray) -> Entries:
        more = None if self.more is None else self.more[which]
        return Entries(self.key[which], more, self.doc[which], self.pos[which], self.indexed[which])


def decide(e: Entries, both_ways: bool) -> tuple[np.ndarray, np.ndarray]:
    """Masks over ``e``: entries whose key an indexed entry of a smaller document has (and, ``both_ways``, indexed
    entries whose key a larger document has); and entries that others elsewhere still need to see."""
    if not len(e.key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(e.key, kind="stable") if e.more is None else np.lexsort((e.more, e.key))
    new = np.ones(len(order), bool)
    for x in (e.key, e.more):
        if x is not None:
            own = x[order]
            new[1:] = own[1:] != own[:-1] if x is e.key else new[1:] | (own[1:] != own[:-1])
    doc, indexed = e.doc[order], e.indexed[order]
    starts = np.flatnonzero(new)
    group = np.cumsum(new, dtype=np.int32) - 1
    far = np.iinfo(np.int64).max
    lowest = np.minimum.reduceat(np.where(indexed, doc, far), starts)[group]
    highest = np.maximum.reduceat(doc, starts)[group]
    hit = lowest < doc
    if both_ways:
        hit |= indexed & (highest > doc)
        needed = ~hit | (indexed & (doc == lowest)) | (doc == highest)
    else:
        needed = indexed & (doc == lowest)
    out_hit, out_needed = np.empty(len(hit), bool), np.empty(len(hit), bool)
    out_hit[order], out_needed[order] = hit, needed
    return out_hit, out_needed


#: Columns of packed entries, each with the bytes it takes of a number; what is mostly zero has columns of its own, which
#: shuffles compress to almost nothing. ``docs`` and counts have an entry for each run of one document.
_WIDTHS = {"keys": 8, "more": 8, "docs": 8, "counts": 1, "counts_high": 3, "pos": 2, "pos_high": 2}
_PACKED = "bucket int, decided boolean, " + ", ".join(f"{c} binary" for c in _WIDTHS)
#: Bytes of a key where its bucket tells the others.
_SHORT = 5


def _binaries(x: np.ndarray | None, first: int, width: int, edges: np.ndarray) -> pa.Array:
    """Bytes ``first`` to ``first + width`` of each number, as one binary value for each span between ``edges``."""
    if x is None:
        return pa.array([b""] * (len(edges) - 1), pa.binary())
    cut = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, first : first + width])
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(cut)])


def _numbers(column: pa.Array, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a binary column, from their low bytes, and how many each value has."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // width
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(raw) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view(kind), sizes


def _pack(e: Entries, bucket: np.ndarray, decided: bool) -> pa.RecordBatch:
    """``e``, ordered by ``bucket``, as one row for each bucket."""
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    own = bucket[edges[:-1]]
    new_run = np.append(True, (e.doc[1:] != e.doc[:-1]) | (bucket[1:] != bucket[:-1]))
    runs = np.flatnonzero(new_run)
    counts = np.diff(np.append(runs, len(bucket))).astype("<u4")
    run_edges = np.searchsorted(runs, edges)
    pos, key = e.pos.astype("<u4"), None if decided else e.key
    width = _SHORT if e.more is None else 8
    columns = [
        pa.array(own.astype(np.int32)), pa.array(np.full(len(own), decided)), _binaries(key, 0, width, edges), _binaries(None if decided else e.more, 0, 8, edges),
        _binaries(e.doc[runs], 0, 8, run_edges), _binaries(counts, 0, 1, run_edges), _binaries(counts, 1, 3, run_edges), _binaries(pos, 0, 2, edges), _binaries(pos, 2, 2, edges),
    ]
    return pa.record_batch(columns, names=["bucket", "decided", *_WIDTHS])


def _unpack(batch: pa.RecordBatch, short: bool, block: int) -> Entries:
    """The entries of rows that are alike in ``decided``; without keys where that is true."""
    column = {n: batch.column(n) for n in _WIDTHS}
    low, n_keys = _numbers(column["pos"], 2, "<u4")
    high, _ = _numbers(column["pos_high"], 2, "<u4")
    counts, _ = _numbers(column["counts"], 1, "<u4")
    more_counts, _ = _numbers(column["counts_high"], 3, "<u4")
    docs, _ = _numbers(column["docs"], 8, "<i8")
    pos, doc = low | (high << np.uint32(16)), np.repeat(docs, counts | (more_counts << np.uint32(8)))
    if len(batch) and batch.column("decided")[0].as_py():
        return Entries(np.zeros(0, np.uint64), None, doc, pos, np.zeros(0, bool))
    if not short:
        return Entries(_numbers(column["keys"], 8, "<u8")[0], _numbers(column["more"], 8, "<u8")[0], doc, pos, np.ones(len(pos), bool))
    key, _ = _numbers(column["keys"], _SHORT, "<u8")
    key |= np.repeat(batch.column("bucket").to_numpy().astype(np.uint64), n_keys) << np.uint64(8 * _SHORT)
    return Entries(key, None, doc, pos, pos % block == 0)


def _send(e: Entries, buckets: int, both_ways: bool) -> Iterator[pa.RecordBatch]:
    """What a batch has decided, and the rest packed by bucket."""
    hit, needed = decide(e, both_ways)
    if hit.any():
        done = e.take(hit)
        yield _pack(done, np.full(len(done.doc), int(done.doc[0] % buckets), np.int32), True)
    rest = e.take(needed)
    if len(rest.key):
        bucket = (((rest.key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        yield _pack(rest.take(order), bucket[order], False)


def _hits(packed: DataFrame, tasks: int, both_ways: bool, block: int) -> DataFrame:
    """(doc_id, pos) decided by batches or, bucket by bucket, among batches."""

    def out(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(doc), pa.array(pos.astype(np.int32))], names=["doc_id", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[Entries] = []
        for batch in batches:
            decided = batch.column("decided")
            done = batch.filter(decided)
            if len(done):
                e = _unpack(done, both_ways, block)
                yield out(e.doc, e.pos)
            kept.append(_unpack(batch.filter(pc.invert(decided)), both_ways, block))
        if kept:
            join = lambda f: np.concatenate([getattr(k, f) for k in kept])
            e = Entries(join("key"), None if both_ways else join("more"), join("doc"), join("pos"), join("indexed"))
            kept.clear()
            hit, _ = decide(e, both_ways)
            yield out(e.doc[hit], e.pos[hit])

    return packed.repartition(tasks, "bucket").mapInArrow(run, "doc_id bigint, pos int")


def _slices(batches: Iterator[pa.RecordBatch], column: str, room: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``room`` bytes of ``column``, and one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + room, side="right")))
            yield batch.slice(i, j - i)
            i = j


def _anchor_keys(docs: DataFrame, buckets: int, s: RepeatSettings) -> DataFrame:
    block = s.window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text", 6 * s.words_per_batch):
            a, _, starts = word_hashes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            key = rolling_keys(a, block, _BASES[0])
            sizes = np.diff(starts)
            pos = (np.arange(len(a)) - np.repeat(starts[:-1], sizes)).astype(np.uint32)
            ok = np.flatnonzero((pos + block <= np.repeat(sizes, sizes)) & np.repeat(sizes >= s.window, sizes))
            del a
            if len(ok):
                doc = np.repeat(ids, sizes)[ok]
                pos = pos[ok]
                yield from _send(Entries(key[ok], None, doc, pos, pos % block == 0), buckets, True)

    return docs.select("doc_id", "text").mapInArrow(run, _PACKED)


def _window_keys(marked: DataFrame, buckets: int, s: RepeatSettings) -> DataFrame:
    """Keys of all windows that hold a marked block; ``marked`` has doc_id, text and the blocks' positions."""
    block = s.window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text", 6 * s.words_per_batch):
            a, b, starts = word_hashes(batch.column("text"))
            which, docs, pos = [], [], []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                n = int(starts[i + 1] - starts[i])
                near = np.zeros(n + 1, np.int32)
                at = np.asarray(batch.column("blocks")[i].values, np.int64)
                np.add.at(near, np.maximum(0, at + block - s.window), 1)
                np.add.at(near, np.minimum(n, at + 1), -1)
                own = np.flatnonzero(np.cumsum(near)[: max(0, n - s.window + 1)] > 0)
                which.append(own + starts[i])
                docs.append(np.full(len(own), doc, np.int64))
                pos.append(own.astype(np.uint32))
            if which and sum(map(len, which)):
                at = np.concatenate(which)
                key = rolling_keys(a, s.window, _BASES[0])[at]
                del a
                more = rolling_keys(b, s.window, _BASES[1])[at]
                del b
                yield from _send(Entries(key, more, np.concatenate(docs), np.concatenate(pos), np.ones(len(at), bool)), buckets, False)

    return marked.mapInArrow(run, _PACKED)


def _without(marked: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_removed, kept) of documents with the starts of removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, starts in zip(*(batch.column(c) for c in ("doc_id", "text", "starts")), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(starts.values, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                rows.append((doc.as_py(), int(gone.sum()), b" ".join([w for w, g in zip(words, gone, strict=True) if not g])))
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "cut", "kept"])

    return marked.select("doc_id", "text", "starts").mapInArrow(run, "doc_id bigint, cut bigint, kept binary")


WORD_BREAK = r"[\x20\x09-\x0D]+"


def repeated_passages(docs: DataFrame, settings: RepeatSettings = RepeatSettings()) -> tuple[DataFrame, DataFrame]:
    """What each row of ``docs`` (doc_id, text) keeps, as two tables.

    The first has every row: doc_id, n_words, all_sha256 (of its words) and copy, true if nothing is kept because all its
    words are those of a smaller document. The second has, of other documents, those that lose words: doc_id, cut (words
    lost), kept (the UTF-8 bytes left) and cut_sha256.

    A word goes if a window of ``window`` words covers it whose words also start in a document of smaller doc_id.
    Texts of fewer words stay whole; null and blank texts have no words. A row without doc_id is no document of smaller
    or larger id, so it stays whole and takes nothing from others. Rows of one doc_id must have one text; such repeated
    rows all get the same result. Whole copies are told by the SHA-256 of their words, windows by 128 bits.
    """
    spark, s = docs.sparkSession, settings
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    base = materialize(docs.select("doc_id", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("all_sha256")))
    firsts = materialize(base.filter(F.col("n_words") >= s.window).groupBy("all_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    firsts = firsts.filter("rows > 1").drop("rows")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    state = materialize(base.join(firsts, "all_sha256", "left").select(*base.columns, copy.alias("copy")))

    copies = materialize(state.filter("copy").select("doc_id").distinct())
    single = docs.filter("doc_id IS NOT NULL").join(small(copies, copies.count()), "doc_id", "left_anti")
    n_words = state.filter("NOT copy").agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(8, -(-n_words // s.keys_per_bucket))
    tasks = partitions_for(spark, n_words, s.keys_per_bucket)
    anchors = _hits(_anchor_keys(single, buckets, s), tasks, True, s.window // 2)
    anchors = materialize(anchors.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("blocks")))
    n_marked = anchors.count()
    texts = docs.join(small(anchors.select("doc_id"), n_marked), "doc_id", "left_semi")
    marked = materialize(texts.join(anchors, "doc_id").dropDuplicates(["doc_id"]))
    found = _hits(_window_keys(marked, buckets, s), tasks, False, s.window // 2)
    starts = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    cut = _without(marked.select("doc_id", "text").join(starts, "doc_id"), s.window)
    cut = cut.select("doc_id", "cut", "kept", F.sha2("kept", 256).alias("cut_sha256"))
    return state, cut


def op5_fixed_block_substring_dedup(spark, sf_dir: str) -> DataFrame:
    state, cut = repeated_passages(table(spark, sf_dir, "documents"))
    nothing = hashlib.sha256(b"").hexdigest()
    return state.join(cut.drop("kept"), "doc_id", "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"),
    )


def remove_repeated_passages(docs: DataFrame, settings: RepeatSettings = RepeatSettings()) -> DataFrame:
    """``docs`` with repeated passages taken out of text; a text that loses words has its rest joined by one space."""
    state, cut = repeated_passages(docs, settings)
    changed = state.select("doc_id", "copy").distinct().join(cut.select("doc_id", "kept"), "doc_id", "left").filter("copy OR kept IS NOT NULL")
    text = F.when(F.col("copy"), F.lit("")).when(F.col("kept").isNotNull(), F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    return docs.join(changed, "doc_id", "left").withColumn("text", text).select(docs.columns)
