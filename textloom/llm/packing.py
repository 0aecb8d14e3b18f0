"""Best-fit packing of tokenised documents into sequences of fixed length, after dominance reduction.

Documents become pieces of at most ``capacity`` tokens. How many pieces there are of each length is a table of at
most ``capacity`` rows whatever the corpus; the packing is planned on that table, as a list of patterns with
multiplicities, and each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, table


@dataclass(frozen=True)
class PackSettings:
    tokenizer_path: str
    capacity: int = 1024
    end_id: int = 2
    #: Cuts of texts whose ids one Python worker keeps.
    cached_cuts: int = 400_000
    #: Pieces of one length that one task ranks.
    rows_per_rank: int = 50_000


def default_settings() -> PackSettings:
    import public_tokenizers

    return PackSettings(public_tokenizers.path("byte_bpe_50k.json"))


class TextEncoder:
    """Ids of whole texts by byte-level BPE; each distinct chunk of a batch is encoded once.

    The vocabulary is that of the tokenizers file; its ids are the ranks of its merges, so tiktoken gives the same
    ids, faster. A space before other text starts a new token whatever precedes it, so a text may be cut before its
    spaces and the cuts encoded on their own, unless white space stands before a space or at the end: such texts
    are encoded whole. So are texts with one of the file's added tokens, which has its own id wherever it stands.
    """

    _shared: dict[str, TextEncoder] = {}

    def __init__(self, path: str, room: int) -> None:
        import tiktoken

        file = json.loads(Path(path).read_text())
        model, added = file["model"], file.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take more or less than their own text aren't supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.cut_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(model["vocab"][m] != 256 + i for i, m in enumerate(joined)):
            raise ValueError("ids of this vocabulary aren't the ranks of its merges")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(joined)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.room, self.known = room, {}

    @classmethod
    def get(cls, path: str, room: int) -> TextEncoder:
        """One for each worker process, kept over tasks."""
        if path not in cls._shared:
            cls._shared[path] = cls(path, room)
        return cls._shared[path]

    def _whole(self, text: str) -> bytes:
        parts = self.cut_added.split(text) if self.cut_added else [text]
        return b"".join(self.added[x] if i % 2 else np.array(self.encoding.encode_ordinary(x), "<u4").tobytes() for i, x in enumerate(parts))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit numbers; null is as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, r"[\pZ\t-\r\x{85}] |[\pZ\t-\r\x{85}]\z").to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cuts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets = cuts.offsets.to_numpy()
        coded = cuts.flatten().dictionary_encode()
        known, encode = self.known, self.encoding.encode_ordinary
        if len(known) > self.room:
            known.clear()
        packed = []
        for cut in coded.dictionary.to_pylist():
            ids = known.get(cut)
            if ids is None:
                ids = known[cut] = np.array(encode(" " + cut), "<u4").tobytes()
            packed.append(ids)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(b"".join(packed), "<i4"))
        where = coded.indices.to_numpy()
        first = pc.list_element(cuts, 0).to_pylist()
        for i, text_odd in enumerate(odd):
            if text_odd:
                yield self._whole(texts[i].as_py())
            else:
                rest = lists.take(pa.array(where[offsets[i] + 1 : offsets[i + 1]])).flatten()
                yield (self._whole(first[i]) if first[i] else b"") + rest.to_numpy().tobytes()


def _cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece; only the first may be short."""
    first = total % capacity or capacity
    yield 0, first
    for start in range(first, total, capacity):
        yield start, capacity


def tokenize_pieces(docs: DataFrame, settings: PackSettings, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece of ``docs`` (doc_id, text); null text is empty."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.get(s.tokenizer_path, s.cached_cuts)
        end = np.array([s.end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            held = 0
            for doc, packed in zip(ids.to_pylist(), encoder.encode(texts), strict=True):
                packed += end
                for n, (start, length) in enumerate(_cut(len(packed) // 4, s.capacity)):
                    own = packed[4 * start : 4 * (start + length)]
                    rows.append((doc, n, start, length, zlib.crc32(own), own if with_ids else None))
                    held += len(own) if with_ids else 0
                if held > 32_000_000:
                    yield _batch(rows, with_ids)
                    rows, held = [], 0
            yield _batch(rows, with_ids)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, piece, start, length, crc, own = zip(*rows, strict=True) if rows else ((),) * 6
    cols = {
        "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
        "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
    }
    if with_ids:
        cols["ids"] = pa.array([np.frombuffer(x, "<i4") for x in own], pa.list_(pa.int32()))
    return pa.record_batch(list(cols.values()), names=list(cols))


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), sequences of this kind


def reduce_instance(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix, and take out of ``count``, sets that dominate every other set with their largest piece.

    For the largest piece w of the rest, a set {w, x} dominates when whatever else could lie beside w would
    fit into x's place: x fills the sequence exactly; or no two pieces fit beside w and x is the largest that
    fits; or at most two fit and no two that fit are together longer than x. If nothing fits beside w, w stays alone.
    """
    fixed: list[Pattern] = []

    def take(pieces: list[int]) -> None:
        kinds = {w: pieces.count(w) for w in pieces}
        times = min(count[w] // k for w, k in kinds.items())
        for w, k in kinds.items():
            count[w] -= k * times
            if not count[w]:
                del count[w]
        fixed.append((tuple(kinds.items()), times))

    changed = True
    while changed:
        changed = False
        for w in sorted(count, reverse=True):
            while w in count:
                gap = capacity - w
                rest = {x: n - (x == w) for x, n in count.items() if n - (x == w) > 0 and x <= gap}
                if not rest:
                    take([w])
                elif gap in rest:
                    take([w, gap])
                else:
                    smallest = sorted(rest)[:3]
                    firsts = [x for x in smallest for _ in range(min(3, rest[x]))][:3]
                    best = max(rest)
                    if len(firsts) < 2 or firsts[0] + firsts[1] > gap:
                        take([w, best])
                    elif (len(firsts) < 3 or sum(firsts) > gap) and _largest_pair(rest, gap) <= best:
                        take([w, best])
                    else:
                        break
                changed = True
    return fixed


def _largest_pair(rest: dict[int, int], gap: int) -> int:
    """Largest sum of two pieces of ``rest`` within ``gap``, 0 if none."""
    sizes, best = sorted(rest), 0
    i, j = 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > gap or (i == j and rest[sizes[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest pieces first, on counts: equal sequences are handled together."""
    open_: dict[int, list[Pattern]] = {capacity: [((), sum(count.values()))]}
    for w in sorted(count, reverse=True):
        n = count[w]
        while n:
            room = min(r for r in open_ if r >= w)
            content, sequences = open_[room].pop()
            if not open_[room]:
                del open_[room]
            full = room // w
            whole = min(sequences, n // full)
            parts = [(full, whole)]
            n -= full * whole
            if whole < sequences and n:  # fewer pieces are left than fill another sequence
                parts.append((n, 1))
                n = 0
            used = sum(s for _, s in parts)
            parts.append((0, sequences - used))
            for k, s in parts:
                if s:
                    open_.setdefault(room - k * w, []).append(((*content, (w, k)) if k else content, s))
    return [(c, s) for kinds in open_.values() for c, s in kinds if c]


def plan_packing(count: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset) and the number of sequences."""
    count = dict(count)
    patterns = reduce_instance(count, capacity)
    patterns += best_fit(count, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in patterns:
        offset = 0
        for w, k in content:
            first = used.get(w, 0)
            used[w] = first + k * times
            rows.append((w, first, used[w], sequence, k, offset))
            offset += k * w
        sequence += times
    return rows, sequence


def pack_pieces(pieces: DataFrame, settings: PackSettings) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read twice and should be a written table."""
    spark = pieces.sparkSession
    sizes = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan, _ = plan_packing(sizes, settings.capacity)
    buckets = max(64, -(-sum(sizes.values()) // settings.rows_per_rank))
    cut = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = cut.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))
    schema = "p_length bigint, first bigint, end bigint, sequence bigint, k bigint, p_offset bigint"
    # the plan has a few rows for each length, and lengths end at capacity
    places = F.broadcast(spark.createDataFrame(plan, schema))
    at = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    i = F.col("rank") - F.col("first")
    return ranked.join(places, at).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(i / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + (i % F.col("k")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, settings: PackSettings | None = None) -> DataFrame:
    """Where each piece of each document lies.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one piece with
    the end id alone. Texts longer than ``capacity`` tokens are cut into full pieces, the first one perhaps shorter.
    Repeated rows are packed each for itself; other columns aren't read; an empty table gives no rows.
    """
    settings = settings or default_settings()
    return pack_pieces(materialize(tokenize_pieces(docs, settings)), settings)


def sequences(docs: DataFrame, settings: PackSettings | None = None) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; each has at most ``capacity`` ids."""
    settings = settings or default_settings()
    pieces = materialize(tokenize_pieces(docs, settings, with_ids=True))
    placed = pack_pieces(pieces.drop("ids"), settings).select("doc_id", "piece", "sequence_id", "offset")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.select("doc_id", "piece", "ids").join(placed, ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
