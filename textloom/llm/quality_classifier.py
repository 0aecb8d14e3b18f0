"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_j x_j + sum over pairs <v_i, v_j> x_i x_j), and the pair sum is taken in linear time as half of
|sum v_j x_j|^2 - sum |v_j|^2 x_j^2. Inputs come from the text and its length alone; labels, language, source and
doc_id are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import table
from textloom.llm.substrings import _slices, word_hashes


@dataclass(frozen=True)
class ClassifierSettings:
    buckets: int = 1 << 14
    rank: int = 4
    #: Labelled rows, at most, that the model is fitted on: those of smallest hashed doc_id.
    train_rows: int = 12_000
    #: Batches that the fit takes, whatever the number of rows.
    steps: int = 900
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 7
    threshold: float = 0.7
    slice_bytes: int = 12_000_000


_CLASSES = {"symbol": b"#$%&*<>", "pipe": b"|", "shout": b"!", "digit": b"0123456789", "stop": b".,;:?", "line": b"\n"}
STATISTICS = (*_CLASSES, "upper", "n_words", "n_chars", "word_length", "distinct", "stutter", "top_word", "dup_lines", "triples")


def structure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text, scaled to about 0 to 1, and its words as hashes: (rows by STATISTICS, hashes, starts, text of each word)."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])

    words, _, starts = word_hashes(texts)
    size = np.diff(starts)
    text_of = np.repeat(np.arange(n), size)
    cols: dict[str, np.ndarray] = {}
    per_word = np.maximum(size, 1)
    for name, chars in _CLASSES.items():
        lut = np.zeros(256, bool)
        lut[list(chars)] = True
        cols[name] = np.minimum(per_text(lut[data]) / per_word / 3, 1.0)
    upper = (data >= 65) & (data <= 90)
    if len(data) > 1:  # capitals of Latin-1 letters, in UTF-8
        upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    cols["upper"] = per_text(upper) / np.maximum(chars, 1)
    cols["n_words"] = np.log1p(size) / 10
    cols["n_chars"] = np.log1p(chars) / 12
    cols["word_length"] = np.minimum(chars / per_word / 12, 2.0)
    same_text = text_of[1:] == text_of[:-1]
    order = np.lexsort((words, text_of))
    sw, st = words[order], text_of[order]
    new = np.concatenate(([True], (sw[1:] != sw[:-1]) | (st[1:] != st[:-1]))) if len(sw) else np.zeros(0, bool)
    counts = np.diff(np.append(np.flatnonzero(new), len(sw)))
    cols["distinct"] = np.bincount(st[new], minlength=n) / per_word if len(sw) else np.zeros(n)
    cols["stutter"] = np.bincount(text_of[1:][same_text & (words[1:] == words[:-1])], minlength=n) / per_word if len(sw) else np.zeros(n)
    top = np.zeros(n)
    np.maximum.at(top, st[new], counts)
    cols["top_word"] = top / per_word
    lines = pc.split_pattern(texts, "\n")
    line_of = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    code = lines.flatten().dictionary_encode().indices.to_numpy()
    filled = pc.greater(pc.binary_length(lines.flatten()), 0).to_numpy(zero_copy_only=False)
    pairs = np.unique(np.stack((line_of[filled], code[filled])), axis=1)[0] if filled.any() else np.zeros(0, np.int64)
    n_lines = np.bincount(line_of[filled], minlength=n)
    cols["dup_lines"] = (n_lines - np.bincount(pairs, minlength=n)) / np.maximum(n_lines, 1)
    cols["triples"] = np.zeros(n)
    if len(words) > 2:
        with np.errstate(over="ignore"):
            triple = words[:-2] + words[1:-1] * np.uint64(0x9E3779B97F4A7C15) + words[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        ok = text_of[2:] == text_of[:-2]
        o = np.lexsort((triple[ok], text_of[2:][ok]))
        tr, tt = triple[ok][o], text_of[2:][ok][o]
        again = np.concatenate(([False], (tr[1:] == tr[:-1]) & (tt[1:] == tt[:-1]))) if len(tr) else np.zeros(0, bool)
        cols["triples"] = np.bincount(tt[again], minlength=n) / per_word
    return np.stack([cols[c] for c in STATISTICS], axis=1), words, starts, text_of


def sparse_rows(texts: pa.Array, s: ClassifierSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, inputs, values) of the rows' inputs: words by bucket, of length 1 together, then the statistics."""
    stats, words, _, text_of = structure(texts)
    n = len(stats)
    key = text_of * s.buckets + (words % np.uint64(s.buckets)).astype(np.int64)
    key, counts = np.unique(key, return_counts=True)
    row, col = key // s.buckets, key % s.buckets
    value = np.sqrt(counts.astype(float))
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    value /= norm[row] if len(row) else 1
    width = stats.shape[1]
    row = np.concatenate((row, np.repeat(np.arange(n), width)))
    col = np.concatenate((col, np.tile(s.buckets + np.arange(width), n)))
    value = np.concatenate((value, stats.ravel()))
    order = np.argsort(row, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), col[order], value[order]


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def raw(self, starts: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of factors that their gradients need. Rows aren't empty."""
        at = starts[:-1]
        vx = self.factors[col] * value[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weight[col] * value, at) + pairs, total

    def score(self, starts: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, col, value)[0], -30, 30)))


def fit(starts: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray, s: ClassifierSettings) -> FactorisationMachine:
    """Adam on the logistic loss, row batches in a seeded order."""
    rng = np.random.default_rng(s.seed)
    d = s.buckets + len(STATISTICS)
    m = FactorisationMachine(0.0, np.zeros(d), rng.normal(0, 0.05, (d, s.rank)))
    moments = {k: [0.0, 0.0] for k in ("b", "w", "v")}
    step = 0

    def adam(name: str, grad):
        first, second = moments[name]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        moments[name] = [first, second]
        return s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)

    while step < s.steps and len(label):
        order = rng.permutation(len(label))
        for i in range(0, len(order), s.batch):
            rows = order[i : i + s.batch]
            sizes = (starts[1:] - starts[:-1])[rows]
            own = np.concatenate(([0], np.cumsum(sizes)))
            take = np.arange(own[-1]) - np.repeat(own[:-1], sizes) + np.repeat(starts[rows], sizes)
            c, x = col[take], value[take]
            raw, total = m.raw(own, c, x)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]) / len(rows)
            e = np.repeat(error, sizes)
            step += 1
            gw = np.bincount(c, e * x, minlength=d) + s.decay * m.weight
            spread = np.repeat(total, sizes, axis=0)
            gv = np.stack([np.bincount(c, e * x * (spread[:, f] - m.factors[c, f] * x), minlength=d) for f in range(s.rank)], axis=1) + s.decay * m.factors
            m.bias -= float(adam("b", error.sum()))
            m.weight -= adam("w", gw)
            m.factors -= adam("v", gv)
    return m


def train(docs: DataFrame, labels: DataFrame, settings: ClassifierSettings = ClassifierSettings()) -> FactorisationMachine:
    """A model fitted on at most ``train_rows`` rows of ``docs`` that ``labels`` (doc_id, quality) labels; one of no rows
    scores everything by its start. Null labels aren't taken."""
    s = settings
    known = labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label")).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(iter([batch]), "text", s.slice_bytes):
                starts, col, value = sparse_rows(part.column("text"), s)
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x.astype(t)))
                yield pa.record_batch([part.column("doc_id"), part.column("label"), lists(col, np.int32), lists(value, np.float32)], names=["doc_id", "label", "col", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
    got = rows.mapInArrow(run, f"doc_id {kind}, label double, col array<int>, value array<float>").toArrow().sort_by("doc_id")
    cols, values = (got.column(c).combine_chunks() for c in ("col", "value"))
    if not got.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), s)
    sizes = pc.list_value_length(got.column("col")).to_numpy()
    return fit(
        np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), pc.list_flatten(cols).to_numpy(zero_copy_only=False).astype(np.int64),
        pc.list_flatten(values).to_numpy(zero_copy_only=False).astype(float), got.column("label").to_numpy(), s,
    )


def score_quality(docs: DataFrame, model: FactorisationMachine, settings: ClassifierSettings = ClassifierSettings()) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text); null and empty texts are scored by their statistics.

    Repeated rows score alike; other columns aren't read; an empty table gives no rows.
    """
    s = settings
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * (rank + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text", s.slice_bytes):
            scores = shared.value.score(*sparse_rows(batch.column("text"), s))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op10_factorisation_machine_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.pmod(F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")), F.lit(4)) == 2
    s = ClassifierSettings()
    model = train(docs, labels.filter(~held_out("doc_id")), s)
    return score_quality(docs, model, s).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted")
    )
