"""Benchmark decontamination with an FM-index over each shard of training text.

A task's batch of documents is a shard. Its words become symbols, an FM-index (suffix order, Burrows-Wheeler
transform, wavelet-tree ranks, sampled suffix positions) is built on them, all benchmark phrases are searched
backwards at once, and their occurrences are located and merged into spans of words. Words that no phrase has can't
be inside an occurrence, so they only separate runs; runs shorter than the shortest phrase are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import materialize, row_keys, same_row, table
from textloom.llm.substrings import _slices


@dataclass(frozen=True)
class DecontaminationSettings:
    #: Words of a phrase; an item of fewer words is one phrase.
    window: int = 10
    #: Every so many text positions one is kept in the index.
    position_sample: int = 8
    #: Bytes of text in a shard, and of benchmark text whose phrases one pass over the documents searches, about.
    shard_bytes: int = 16_000_000
    item_block_bytes: int = 8_000_000
    #: Phrases that a task searches at a time.
    phrases_at_once: int = 100_000


_END, _BREAK, _FIRST = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts (A-Z lower-cased, split at ASCII other than letters and digits; null: none), each text's
    first word, and the byte bounds of each word in its text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = pa.concat_arrays([texts])
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    plain = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    again = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(plain))
    cuts = pc.ascii_split_whitespace(again)
    flat = cuts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    firsts = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))[cuts.offsets.to_numpy()]
    inside = np.concatenate(([False], plain != 0x20, [False]))
    edge = inside[1:] != inside[:-1]
    starts, ends = edge.copy(), edge
    starts &= inside[1:]
    ends = ends & inside[:-1]
    whole = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(plain))]
    whole = np.unique(whole[inside[whole] & inside[whole + 1]])  # a text that ends and a next that begins with a word
    starts[whole], ends[whole] = True, True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    base = np.repeat(offsets[:-1], np.diff(firsts))
    return flat.filter(keep), firsts, starts - base, ends - base


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (ends in a unique smallest symbol) in the order of their suffixes, by prefix doubling."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        key[: n - i if i < n else 0] |= text[i:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int) -> None:
        order = suffix_order(text)
        last = text[order - 1]
        self.symbols = int(text.max()) + 1
        counts = np.bincount(text, minlength=self.symbols)
        self.smaller = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, (self.symbols - 1).bit_length()))):
            ones = (last >> bit) & 1
            upto = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            self.levels.append((bit, upto, len(last) - int(upto[-1])))
            last = np.concatenate((last[ones == 0], last[ones == 1]))
        self.begin = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))
        self.sampled = order % sample == 0
        self.sample_no = np.concatenate(([0], np.cumsum(self.sampled)))
        self.positions = order[self.sampled]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, upto, zeros in self.levels:
            ones = upto[at]
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row ``at`` of the transform."""
        return self._down(symbol, at) - self.begin[symbol]

    def _before(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that start one position earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for bit, upto, zeros in self.levels:
            one = upto[at + 1] - upto[at]
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + upto[at], at - upto[at])
        return self.smaller[symbol] + at - self.begin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) rows of all phrases; ``phrases`` is padded on the left and searched from the right."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled), np.int64)
        live = (phrases < self.symbols).all(axis=1)
        hi[~live] = 0
        for step in range(phrases.shape[1]):
            on = np.flatnonzero((lo < hi) & (lengths > step))
            if not len(on):
                break
            c = phrases[on, phrases.shape[1] - 1 - step]
            lo[on], hi[on] = self.smaller[c] + self.rank(c, lo[on]), self.smaller[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        found, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        row = row.copy()
        while len(todo):
            here = self.sampled[row]
            found[todo[here]] = self.positions[self.sample_no[row[here]]] + steps
            todo, row = todo[~here], row[~here]
            if len(todo):
                row = self._before(row)
                steps += 1
        return found


@dataclass
class Phrases:
    """Distinct phrases of a block of items: word numbers of the items one after another, where in them each phrase starts
    and how long it is, and the items that have each (those of phrase i are ``having[edges[i]:edges[i + 1]]``)."""

    vocabulary: pa.Array
    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    edges: np.ndarray
    having: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, items: pa.Array, texts: pa.Array, window: int) -> Phrases | None:
        """None if no item has a word. Items of one name count as one."""
        found, firsts, _, _ = split_words(texts)
        coded = found.dictionary_encode()
        words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + _FIRST
        sizes = np.diff(firsts)
        many = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        if not many.sum():
            return None
        item = np.repeat(np.arange(len(sizes)), many)
        starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + firsts[:-1][item]
        lengths = np.minimum(window, sizes[item])
        named = items.dictionary_encode()
        name = named.indices.fill_null(len(named.dictionary)).to_numpy(zero_copy_only=False)[item]
        _, first, same = np.unique(cls.padded(words, starts, lengths, window), axis=0, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((same.ravel(), name)), axis=1)
        edges = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        return cls(coded.dictionary, words, starts[first], lengths[first], edges, pairs[1].astype(np.int32), [*named.dictionary.to_pylist(), None])

    @staticmethod
    def padded(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        """Phrases as rows of ``width`` symbols, shorter ones filled up on the left."""
        at = starts[:, None] + lengths[:, None] - np.arange(width, 0, -1)
        return np.where(at >= starts[:, None], words[np.maximum(at, 0)], np.int32(_BREAK))

    def blocks(self, at_once: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first, symbols, lengths) of so many phrases at a time."""
        width = int(self.lengths.max())
        for i in range(0, len(self.starts), at_once):
            own = slice(i, i + at_once)
            yield i, self.padded(self.words, self.starts[own], self.lengths[own], width).astype(np.int64), self.lengths[own]


def find_phrases(texts: pa.Array, phrases: Phrases, s: DecontaminationSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Occurrences in a shard: (first word in the shard, phrase), each text's first word, and words' byte bounds."""
    words, firsts, starts, ends = split_words(texts)
    at = pc.fill_null(pc.index_in(words, phrases.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = at >= 0
    text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    new_run = np.ones(len(at), bool)
    if len(at):
        new_run[1:] = (known[1:] != known[:-1]) | (text_of[1:] != text_of[:-1])
    run = np.cumsum(new_run) - 1
    enough = np.bincount(run, minlength=1)[run] >= phrases.lengths.min() if len(at) else known
    kept = np.flatnonzero(known & enough)
    none = np.zeros(0, np.int64)
    if not len(kept):
        return none, none, firsts, (starts, ends)
    gap = np.concatenate(([False], run[kept][1:] != run[kept][:-1]))
    place = np.arange(len(kept)) + np.cumsum(gap)
    symbols = np.full(place[-1] + 2, _BREAK, np.int64)
    symbols[place] = at[kept] + _FIRST
    symbols[-1] = _END
    word_at = np.full(len(symbols), -1, np.int64)
    word_at[place] = kept
    index = FMIndex(symbols, s.position_sample)
    places, which = [none], [none]
    for first, block, lengths in phrases.blocks(s.phrases_at_once):
        lo, hi = index.search(block, lengths)
        found = np.flatnonzero(hi > lo)
        many = (hi - lo)[found]
        rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)
        places.append(word_at[index.locate(rows)])
        which.append(np.repeat(found + first, many))
    return np.concatenate(places), np.concatenate(which), firsts, (starts, ends)


_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "end", "from_byte", "to_byte")])
_FOUND = T.StructType([
    T.StructField("__n_words", T.LongType()), T.StructField("__spans", T.ArrayType(_SPAN)), T.StructField("__items", T.ArrayType(T.StringType())),
])


def _phrase_blocks(items: DataFrame, s: DecontaminationSettings) -> Iterator[bytes]:
    """Phrases of each block of ``items`` (item, text), pickled: made by a task each, taken by the driver one at a time."""
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-n_bytes // s.item_block_bytes) or 1

    def made(key: tuple, block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        item, text = (block.column(c).combine_chunks() for c in ("item", "text"))
        return pa.table({"block": [key[0].as_py()], "data": [pickle.dumps(Phrases.of(item, text, s.window))]}, schema=pa.schema([("block", pa.int32()), ("data", pa.binary())]))

    # an item's hash and length deal it, so that repeated names with other texts may part
    cut = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))
    made_blocks = materialize(cut.groupBy("block").applyInArrow(made, "block int, data binary"))
    for b in range(blocks):
        row = made_blocks.filter(F.col("block") == b).select("data").head()
        if row:
            yield bytes(row["data"])


def _searched(docs: DataFrame, phrases: bytes | None, s: DecontaminationSettings) -> DataFrame:
    """``docs`` (with text) with __n_words, and __spans and __items of the given phrases."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    span = pa.struct([(n, pa.int64()) for n in ("first", "end", "from_byte", "to_byte")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = pickle.loads(shared.value) if shared.value else None
        for batch in _slices(batches, "text", s.shard_bytes):
            texts, none = batch.column("text"), np.zeros(0, np.int64)
            if phrases is None:
                _, firsts, starts, ends = split_words(texts)
                first = which = none
            else:
                first, which, firsts, (starts, ends) = find_phrases(texts, phrases, s)
            cover = np.zeros(len(starts) + 1, np.int64)
            if len(first):
                np.add.at(cover, first, 1)
                np.add.at(cover, first + phrases.lengths[which], -1)
            cover = np.cumsum(cover)[:-1] > 0
            doc_of = np.searchsorted(firsts, first, side="right") - 1
            having: dict[int, set[str]] = {}
            for d, p in np.unique(np.stack((doc_of, which)), axis=1).T.tolist() if len(first) else ():
                having.setdefault(d, set()).update(phrases.names[i] for i in phrases.having[phrases.edges[p] : phrases.edges[p + 1]])
            spans, found = [], []
            for i in range(len(batch)):
                a, own = int(firsts[i]), cover[firsts[i] : firsts[i + 1]]
                found.append(sorted(having.get(i, set()) - {None}))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).reshape(-1, 2) if own.any() else none.reshape(0, 2)
                spans.append([{"first": x, "end": y, "from_byte": starts[a + x], "to_byte": ends[a + y - 1]} for x, y in edges.tolist()])
            new = [pa.array(np.diff(firsts)), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(pa.string()))]
            yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, *_FOUND.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_FOUND.fields]))


def _merged(spans: Column) -> Column:
    """Spans by place, with those that touch made one."""

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        both = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"), last["from_byte"].alias("from_byte"), F.greatest(last["to_byte"], x["to_byte"]).alias("to_byte"))
        return F.when(last["end"] >= x["first"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(T.ArrayType(_SPAN)), step)


def _with_findings(docs: DataFrame, items: DataFrame, s: DecontaminationSettings) -> DataFrame:
    """``docs`` (doc_id, text, and more) with __n_words, __spans and __items.

    One block of phrases takes one narrow pass over the documents. Further blocks take further passes, of which only
    rows with findings are kept; these are put together by row and joined to the documents once.
    """
    items = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = list(_passes(docs, items, s))
    if len(blocks) == 1:
        return blocks[0]
    keyed = docs.withColumns(dict(zip(same_row, row_keys("text"), strict=True)))
    each = [b.withColumns(dict(zip(same_row, row_keys("text"), strict=True))).filter(F.size("__spans") > 0).select(*same_row, *_FOUND.names).dropDuplicates(same_row) for b in blocks]
    found = reduce(DataFrame.unionByName, each).groupBy(*same_row).agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.flatten(F.collect_list("__items")).alias("__items"))
    found = materialize(found.select(*same_row, _merged(F.col("__spans")).alias("__spans"), F.array_sort(F.array_distinct("__items")).alias("__items")))
    counted = _searched(keyed, None, s).drop("__spans", "__items").join(found, same_row, "left")
    empty = {c: F.coalesce(F.col(c), F.array().cast(_FOUND[c].dataType)) for c in ("__spans", "__items")}
    return counted.withColumns(empty).select(*docs.columns, *_FOUND.names)


def _passes(docs: DataFrame, items: DataFrame, s: DecontaminationSettings) -> Iterator[DataFrame]:
    some = False
    for block in _phrase_blocks(items, s):
        some = True
        yield _searched(docs, block, s)
    if not some:
        yield _searched(docs, None, s)


def contamination(docs: DataFrame, items: DataFrame, settings: DecontaminationSettings = DecontaminationSettings()) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of ``docs`` (doc_id, text), for ``items`` (item_id, text).

    spans are the merged word ranges [first, end) that phrases cover, with their byte ranges in the UTF-8 text; items
    are the ids, as strings, of items with a phrase in the text, sorted. Null and blank texts have no words and no
    spans; items without words have no phrase; an item without id covers words but can't be listed; repeated rows count
    each for itself; other columns aren't read.
    """
    found = _with_findings(docs.select("doc_id", "text"), items, settings)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def remove_contamination(docs: DataFrame, items: DataFrame, settings: DecontaminationSettings = DecontaminationSettings()) -> DataFrame:
    """``docs`` with the text of every covered span taken out; n_chars, if there, follows the text.

    A text is cut from the first byte of a span's first word to the last byte of its last; the rest stays as it is. Rows
    with null or repeated doc_id are cut each by its own spans.
    """
    out = _with_findings(docs, items, settings)
    raw, spans = F.encode("text", "UTF-8"), F.col("__spans")
    n = F.size(spans)
    gap = lambda i: F.substring(  # noqa: E731  what stands before span i, or after the last one
        raw,
        F.when(i == 0, F.lit(1)).otherwise(F.get(spans, i - 1)["to_byte"] + 1).cast("int"),
        (F.when(i == n, F.octet_length("text")).otherwise(F.get(spans, i)["from_byte"]) - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["to_byte"])).cast("int"),
    )
    rest = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.decode(gap(i), "UTF-8")), "")
    out = out.withColumn("text", F.when(n > 0, rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(n > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op7_fm_index_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
