"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are phrases of ``max_words - 1`` words, edges the phrases of ``max_words`` that join two overlapping nodes, weighted
by how often they occur. Texts are read once, for edges and for what ends a piece before it fills an edge; all shorter
counts follow from these: a node occurs as often as edges leave it, and once more for each piece that ends in it. Where
all that enters a node comes by one edge and leaves by one, the edges are one path; what lies inside a path has its
weight, so counts are looked up only for its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize, new_path, small, table


@dataclass(frozen=True)
class CollocationSettings:
    max_words: int = 3
    min_count: int = 10
    #: A phrase is dropped if a longer one that holds it has so many percent of its occurrences.
    covered_percent: int = 50
    per_language: int = 2000
    #: Parts that grams are dealt to; by default so many that each holds those of some megabytes of text.
    parts: int | None = None

    def __post_init__(self) -> None:
        if self.max_words < 2 or self.min_count < 1:
            raise ValueError("phrases have two words or more and occur")


def _cols(n: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, first + n)]


#: Bytes of input, by the optimizer's estimate, for which there is a part, and the most parts.
PART_BYTES, MOST_PARTS = 8_000_000, 1_000_000
#: Bytes of text that a task counts at once; a longer piece is counted whole.
SLICE = 4_000_000
#: What ends a piece, and what parts words.
PIECE_ENDS, SPACES = b".,;:!?\x0A\x0B\x0C\x0D", b"\x20\x09"


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its lower case, and whether it is of a word (0), parts words (1) or ends a piece (2)."""
    lower, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    kind[list(SPACES)], kind[list(PIECE_ENDS)] = 1, 2
    return lower, kind


def _slices(offsets: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE that end where a text or a piece does."""
    begin, total = int(offsets[0]), int(offsets[-1])
    while begin < total:
        text, piece = np.searchsorted(offsets, begin + SLICE), np.searchsorted(ends, begin + SLICE)
        end = min(int(offsets[text]) if text < len(offsets) else total, int(ends[piece]) + 1 if piece < len(ends) else total)
        yield begin, end
        begin = end


def _added_up(keys: list[np.ndarray], sizes: list[int], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, sum of ``number``) of each distinct row of the columns ``keys``, whose values lie under ``sizes``."""
    key, bound = keys[0].astype(np.int64), sizes[0]
    for more, size in zip(keys[1:], sizes[1:]):
        if bound * size >= 1 << 62:  # closer numbers for what is joined so far
            known, key = np.unique(key, return_inverse=True)
            bound = len(known)
        key, bound = key * size + more, bound * size
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    return order[first], np.add.reduceat(number[order], first)


@dataclass
class _Grams:
    """Distinct grams of one language: a column of word numbers for each place, 0 for none, with the words and counts."""

    lang: str
    words: pa.Array
    columns: list[np.ndarray]
    counts: np.ndarray

    def shorter(self, k: int) -> _Grams:
        """The first ``k`` words of each, added up."""
        columns = self.columns[:k]
        first, counts = _added_up(columns, [len(self.words) + 1] * k, self.counts)
        return _Grams(self.lang, self.words, [c[first] for c in columns], counts)

    def where(self, rows: np.ndarray) -> _Grams:
        return _Grams(self.lang, self.words, [c[rows] for c in self.columns], self.counts[rows])

    def packed(self, part: int) -> tuple:
        """A row of PACKED: only words in use, their numbers in two or four bytes."""
        used, numbers = np.unique(np.concatenate(self.columns), return_inverse=True)
        if not len(used) or used[0]:
            used, numbers = np.concatenate(([0], used)), numbers + 1
        kind = "<u2" if len(used) <= 1 << 16 else "<u4"
        words = "\n".join(self.words.take(pa.array(used[1:] - 1)).to_pylist()).encode()
        return part, self.lang, words, numbers.astype(kind).tobytes(), self.counts.astype("<i8").tobytes()

    def dealt(self, parts: int) -> Iterator[tuple]:
        """Rows of PACKED, a row a part; a gram's part follows from its words alone."""
        own = np.array([0, *[xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()]], np.uint64)
        h = np.zeros(len(self.counts), np.uint64)
        for c in self.columns:
            h = (h ^ own[c]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        part = (h >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True]))) if len(order) else []
        for a, b in zip(edge, edge[1:]):
            yield self.where(order[a:b]).packed(int(part[order[a]]))


PACKED = "part int, lang string, words binary, numbers binary, counts binary"
#: Rows of grams that a task holds before it adds up what it has.
HELD = 3_000_000


def _strings(joined: bytes) -> pa.Array:
    """Words, each with a line feed after it."""
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    at = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(at), pa.py_buffer(data[data != 10]))


def _unpacked(lang: str, rows: list[tuple[bytes, bytes, bytes]], k: int) -> _Grams:
    """Packed rows (words, numbers, counts) of one language with one numbering of words, equal grams added up."""
    coded = _strings(b"".join(w + b"\n" for w, _, _ in rows)).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    columns, counts, base = [[] for _ in range(k)], [], 0
    for words, numbers, own in rows:
        counts.append(np.frombuffer(own, "<i8"))
        n = len(counts[-1])
        table = np.frombuffer(numbers, "<u2" if len(numbers) == 2 * k * n else "<u4").reshape(k, n)
        size = words.count(b"\n") + 1
        to = np.concatenate(([0], number[base : base + size]))
        base += size
        for column, c in zip(columns, table):
            column.append(to[c])
    return _Grams(lang, coded.dictionary, [np.concatenate(c) for c in columns], np.concatenate(counts)).shorter(k)


def _rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of rows of PACKED, of some megabytes each."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("numbers", pa.binary()), ("counts", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[2:]))
        if size > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _grams(langs: pa.Array, texts: pa.Array, n: int) -> Iterator[_Grams]:
    """Grams of ``n`` words of a batch of texts, by language and slice."""
    lower, kinds = _byte_classes()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    langs = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    lang_of, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
    _, where, buffer = texts.buffers()
    if not len(texts) or buffer is None:
        return
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)
    ends = np.flatnonzero(kinds[data[: offsets[-1]]] == 2)
    for begin, end in _slices(offsets, ends):
        kind = kinds[data[begin:end]]
        inside = kind == 0
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        starts_text = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
        new[starts_text] |= inside[starts_text]
        start = np.flatnonzero(new)
        if not len(start):
            continue
        doc = np.searchsorted(offsets, start + begin, "right") - 1
        piece = np.cumsum(kind == 2)[start] + doc
        held = lower[data[begin:end][inside]]
        at = np.concatenate((np.cumsum(inside)[start] - 1, [len(held)])).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(held)).dictionary_encode()
        columns = [coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1]
        for k in range(1, n):  # the word k places on, or 0 beyond the piece's end
            later = np.zeros(len(start), np.int64)
            later[:-k] = np.where(piece[k:] == piece[:-k], columns[0][k:], 0)
            columns.append(later)
        lang = lang_of[doc]
        for i in np.unique(lang):
            own = np.flatnonzero(lang == i)
            yield _Grams(names[i], coded.dictionary, [c[own] for c in columns], np.ones(len(own), np.int64)).shorter(n)


def edges(docs: DataFrame, settings: CollocationSettings, parts: int) -> DataFrame:
    """PACKED rows of how often each n-gram stands in pieces of ``docs`` (text, lang), with n = max_words; those that a piece's
    end cuts short lack words. A null text is empty, a null lang is ``und``. A task counts its texts by slices."""
    n = settings.max_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(row for batch in batches for grams in _grams(batch.column(0), batch.column(1), n) for row in grams.dealt(parts))

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, PACKED)


#: Parts that aren't dealt further: grams that occur often enough, and the number of all words.
OFTEN, TOTAL = -1, -2


def added_up(packed: DataFrame, k: int, settings: CollocationSettings, parts: int) -> DataFrame:
    """PACKED rows of grams of ``k`` words added up over all tasks: those that occur often enough under OFTEN, and what leaves
    each node of one word less, dealt by these nodes for the next such step (at one word: under TOTAL).

    Each gram has one part, so a task has all of it; a gram in every text is a row a slice before. A task holds the
    distinct grams of one part at a time.
    """
    least = settings.min_count

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[str, list[tuple]] = {}
        waiting: dict[str, int] = {}

        def through() -> Iterator[tuple]:
            for lang in list(held):
                all_of = _unpacked(lang, held.pop(lang), k)
                often = np.flatnonzero((all_of.counts >= least) & (all_of.columns[-1] > 0))
                if len(often):
                    yield all_of.where(often).packed(OFTEN)
                if k > 1:
                    yield from all_of.shorter(k - 1).dealt(parts)
                else:
                    yield TOTAL, lang, b"", b"", np.array([all_of.counts.sum()], "<i8").tobytes()
            waiting.clear()

        now = None
        for batch in batches:
            for part, lang, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    yield from through()
                    now = part
                held.setdefault(lang, []).append(tuple(row))
                waiting[lang] = waiting.get(lang, 0) + len(row[2]) // 8
                if waiting[lang] > HELD:
                    held[lang], waiting[lang] = [_unpacked(lang, held[lang], k).packed(OFTEN)[2:]], 0
        yield from through()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(rows(batches))

    # parts follow the input's size, tasks the session; where parts are more, a task takes its own one after another
    tasks = min(parts, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed.filter("part >= 0").repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, PACKED)


def rows_of(packed: DataFrame, k: int) -> DataFrame:
    """(lang, w1 .. wk, c) of the grams under OFTEN."""
    schema = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in _cols(k)], ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, *row in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                g = _unpacked(lang, [tuple(row)], k)
                words = [g.words.take(pa.array(c - 1)).cast(pa.string()) for c in g.columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g.counts)), *words, pa.array(g.counts)], schema=schema)

    return packed.filter(F.col("part") == OFTEN).mapInArrow(run, ", ".join(["lang string", *[f"{w} string" for w in _cols(k)], "c long"]))


def counts(docs: DataFrame, settings: CollocationSettings) -> tuple[dict[int, DataFrame], DataFrame]:
    """(lang, w1 .. wk, c) of phrases that occur often enough, for each length k, and (lang, n) of all words.

    Only edges are counted from texts: a node occurs as often as edges leave it, by whatever word or none.
    """
    spark, n = docs.sparkSession, settings.max_words
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # what sources say that can't tell their size
        size = PART_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = settings.parts or min(max(spark.sparkContext.defaultParallelism, size // PART_BYTES), MOST_PARTS)
    packed, path, often = edges(docs, settings, parts), None, {}
    for k in range(n, 0, -1):
        last, path = path, new_path(spark)
        packed = materialize(added_up(packed, k, settings, parts), path)
        often[k] = materialize(rows_of(packed, k))
        if last:
            discard(spark, last)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([int.from_bytes(x, "little") for x in batch.column(1).to_pylist()], pa.int64())], names=["lang", "n"])

    totals = packed.filter(F.col("part") == TOTAL).select("lang", "counts").mapInArrow(numbers, "lang string, n long")
    return often, totals.groupBy("lang").agg(F.sum("n").alias("n"))


def paths(often: DataFrame, nodes: DataFrame, words: int) -> tuple[DataFrame, list[str]]:
    """(lang, head, place, w1 .. wn, c, left, right) of edges ``often`` (lang, w1 .. wn, c) and the tables written for it:
    left and right are the counts of an edge's nodes, edges of one path share ``head``, its first edge's words, and have places from 0 on.

    A node is inside a path if the one edge has all its weight on the left and one on the right. Each edge has one such
    neighbour on either side at most, and none of these paths is a ring: every piece begins somewhere, which gives the
    node where it enters a ring more weight than the ring's edges have. Edges find their path's head by pointer doubling,
    so rounds grow with the logarithm of the longest path, which is never longer than a piece.
    """
    spark = often.sparkSession
    n, written = words, []

    def kept(df: DataFrame) -> DataFrame:
        written.append(new_path(spark))
        return materialize(df, written[-1])

    node = nodes.select("lang", *_cols(n - 1), F.col("c").alias("left"))
    both = often.join(node, ["lang", *_cols(n - 1)]).join(node.toDF("lang", *_cols(n - 1, 2), "right"), ["lang", *_cols(n - 1, 2)])
    phrase = lambda first: F.concat_ws(" ", *_cols(n - 1, first))
    both = kept(both.withColumn("edge", F.concat_ws(" ", *_cols(n))).withColumn("from", phrase(1)).withColumn("to", phrase(2)))
    # an edge whose left node is inside a path points to the edge before it
    inward = both.filter("c = right").select("lang", F.col("to").alias("from"), F.col("c").alias("left"), F.col("edge").alias("head"))
    linked = kept(both.filter("c = left").join(inward, ["lang", "from", "left"]).select("lang", "edge", "head", F.lit(1).cast("long").alias("place")))
    open_links = linked.count()
    while open_links:
        on = linked.select("lang", F.col("edge").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        linked = kept(linked.join(on, ["lang", "head"], "left").select("lang", "edge", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("further").isNotNull().alias("moved")))
        open_links = linked.filter("moved").count()
        linked = linked.drop("moved")
    placed = both.join(linked, ["lang", "edge"], "left").select("lang", F.coalesce("head", "edge").alias("head"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), *_cols(n), "c", "left", "right")
    return placed, written


def compact_paths(placed: DataFrame, words: int) -> DataFrame:
    """(lang, words, edges, c): each path of ``paths`` as one phrase, never longer than the piece it comes from."""
    steps = F.array_sort(F.collect_list(F.struct("place", *_cols(words))))
    grouped = placed.groupBy("lang", "head").agg(steps.alias("s"), F.max("c").alias("c"))
    first = F.array(*[F.get("s", F.lit(0))[w] for w in _cols(words - 1)])
    return grouped.select("lang", F.array_join(F.concat(first, F.transform("s", lambda x: x[f"w{words}"])), " ").alias("words"), F.size("s").cast("long").alias("edges"), "c")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in 38 digits; counts of up to 15 digits fit."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (wide(left) * wide(right)).cast("decimal(31,0)"))


def collocations(docs: DataFrame, settings: CollocationSettings | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``max_words`` words of each language of ``docs``
    (text, lang; other columns, of whatever name, aren't read).

    Letters A-Z are lower-cased; texts are cut into pieces at punctuation and line ends, pieces into words at spaces and
    tabs; counts are of whole tables, per language, overlaps included. A phrase that occurs ``min_count`` times is cut
    where its score is lowest, at the first such place, and left out where a longer one covers it. Null texts are empty, a null lang is
    ``und``, repeated rows count again; an empty table gives an empty result; ties in score go by count, then by phrase.

    Only counts of phrases are shuffled, combined before; a very common phrase is one row a task. Tables written in
    between are deleted but for those that the result reads.
    """
    s = settings or CollocationSettings()
    n = s.max_words
    spark = docs.sparkSession
    often, total = counts(docs, s)
    placed, written = paths(often[n], often[n - 1], n)
    placed_at = new_path(spark)
    placed = materialize(placed, placed_at)
    known = {k: small(often[k], often[k].count()) for k in range(1, n)}
    found = materialize(reduce(DataFrame.unionByName, _candidates(often, known, placed, s)))
    for path in [*written, placed_at]:
        discard(spark, path)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= s.per_language)
    return top.join(small(total, total.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _candidates(often: dict[int, DataFrame], known: dict[int, DataFrame], placed: DataFrame, s: CollocationSettings) -> list[DataFrame]:
    """(lang, phrase, a, l, r, score) of phrases that no longer one covers, for each length."""
    n, out = s.max_words, []
    for k in range(2, n + 1):
        if k == n:
            rows = placed.withColumnRenamed("c", "a")
            # inside a path a node's count is the path's: known without a look at the nodes
            rows = rows.withColumn(f"l{n - 1}", F.col("left")).withColumn("r1", F.col("right")).drop("left", "right", "head", "place")
        else:
            rows = often[k].withColumnRenamed("c", "a")
            # the longer phrase that covers it best has one word more, before or after; longer ones still occur no more often
            longer = often[k + 1]
            cover = reduce(DataFrame.unionByName, [longer.groupBy("lang", *_cols(k, i)).agg(F.max("c").alias("c")).toDF("lang", *_cols(k), "c") for i in (1, 2)])
            cover = cover.groupBy("lang", *_cols(k)).agg(F.max("c").alias("cover"))
            rows = rows.join(cover, ["lang", *_cols(k)], "left").filter(F.coalesce("cover", F.lit(0)) * 100 < F.col("a") * s.covered_percent).drop("cover")
        for j in range(1, k):
            if f"l{j}" not in rows.columns:
                rows = rows.join(known[j].withColumnRenamed("c", f"l{j}"), ["lang", *_cols(j)])
            if f"r{j}" not in rows.columns:
                rows = rows.join(known[k - j].toDF("lang", *_cols(k - j, j + 1), f"r{j}"), ["lang", *_cols(k - j, j + 1)])
        cuts = [F.struct(_score(F.col("a"), F.col(f"l{j}"), F.col(f"r{j}")).alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k)]
        rows = rows.withColumn("cut", F.least(*cuts) if k > 2 else cuts[0])
        out.append(rows.select("lang", F.concat_ws(" ", *_cols(k)).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    return out


def op12_de_bruijn_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


#: DuckDB: counts of one, two and three words from the places of all words.
OP12_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM w, unnest(range(1, len(w) + 1)) t(i)),
    u AS (SELECT lang, w1, count(*) AS c FROM g GROUP BY ALL),
    b AS (SELECT lang, w1, w2, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    t AS (SELECT lang, w1, w2, w3, count(*) AS c FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    n AS (SELECT lang, sum(c)::BIGINT AS n FROM u GROUP BY lang),
    cover AS (SELECT lang, w1, w2, max(c) AS m FROM (SELECT lang, w1, w2, c FROM t UNION ALL SELECT lang, w2, w3, c FROM t) x GROUP BY ALL),
    b2 AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.c AS a, x.c AS l, y.c AS r, ((1000000::HUGEINT * b.c * b.c) // (x.c::HUGEINT * y.c))::BIGINT AS score
        FROM b JOIN u x ON x.lang = b.lang AND x.w1 = b.w1 JOIN u y ON y.lang = b.lang AND y.w1 = b.w2 LEFT JOIN cover ON cover.lang = b.lang AND cover.w1 = b.w1 AND cover.w2 = b.w2
        WHERE 100 * coalesce(m, 0) < 50 * b.c),
    t2 AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.c AS a, x.c AS l1, y.c AS r1, z.c AS l2, v.c AS r2,
        ((1000000::HUGEINT * t.c * t.c) // (x.c::HUGEINT * y.c))::BIGINT AS s1, ((1000000::HUGEINT * t.c * t.c) // (z.c::HUGEINT * v.c))::BIGINT AS s2
        FROM t JOIN u x ON x.lang = t.lang AND x.w1 = t.w1 JOIN b y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
        JOIN b z ON z.lang = t.lang AND z.w1 = t.w1 AND z.w2 = t.w2 JOIN u v ON v.lang = t.lang AND v.w1 = t.w3),
    a AS (SELECT * FROM b2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM t2),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM a)
    SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""
