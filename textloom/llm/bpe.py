"""Byte-level BPE, encoded by merge rounds over all words of a block at once and decoded by a table of bytes.

The symbols of many words lie in one flat array. A round looks up the rank of neighbouring symbols by binary search in
the sorted keys of all pairs, finds each word's lowest, and merges every place that has it; words without a pair that
merges drop out. Words met before come from a table that each Python worker keeps within a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import table

#: Words of the byte-level split: contractions, letters, numbers or other characters with a space before, white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{LN}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max


@dataclass(frozen=True)
class BpeSettings:
    tokenizer_path: str
    #: Distinct words whose ids a Python worker keeps; beyond it the table starts anew.
    known_words: int = 150_000
    #: Words that are looked up and gathered in one step.
    words_per_block: int = 200_000


def default_settings() -> BpeSettings:
    import public_tokenizers

    return BpeSettings(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_letters() -> dict[str, int]:
    """The letter that a vocabulary writes for each byte: printable ones themselves, the rest in order from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _newer_letters(splitter) -> tuple[set[str], set[str]]:
    """Characters that are letters and numbers to the regex library but not to ``splitter``, whose Unicode is older."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: list[set[str]] = []
    for kind, beside in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        found, newer = regex.findall(kind, every), set()
        for i in range(0, len(found), 5000):
            joined = "".join(f" {beside}{c}{beside}" for c in found[i : i + 5000])
            same = {joined[a + 2] for _, (a, b) in splitter.pre_tokenize_str(joined) if b - a == 4}
            newer |= set(found[i : i + 5000]) - same
        out.append(newer)
    return out[0], out[1]


def _word_pattern(letters: set[str], numbers: set[str]) -> regex.Pattern:
    """WORDS, without the given letters and numbers being any."""
    less = lambda kind, odd: rf"[\p{{{kind}}}--[{''.join(map(regex.escape, sorted(odd)))}]]" if odd else rf"\p{{{kind}}}"
    l, n = less("L", letters), less("N", numbers)
    if not letters and not numbers:
        return regex.compile(WORDS.replace("{LN}", r"\p{L}\p{N}").replace("{L}", l).replace("{N}", n))
    return regex.compile(WORDS.replace(r"[^\s{LN}]", rf"[^\s{l}{n}]").replace("{L}", l).replace("{N}", n), regex.V1)


class Tokens:
    """The bytes of each id of a tokenizers file with a byte-level BPE model: all that decoding needs."""

    _shared: dict[tuple, Tokens] = {}

    def __init__(self, settings: BpeSettings) -> None:
        file = json.loads(Path(settings.tokenizer_path).read_text(encoding="utf-8"))
        self._read(settings, file)

    @classmethod
    def get(cls, settings: BpeSettings):
        """One of each kind for each worker process, kept over tasks."""
        if (cls, settings) not in cls._shared:
            cls._shared[cls, settings] = cls(settings)
        return cls._shared[cls, settings]

    def _read(self, settings: BpeSettings, file: dict) -> None:
        model, before, after = file["model"], file["pre_tokenizer"] or {}, file["decoder"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not (model.get("type", "BPE") == "BPE" and plain and file["normalizer"] is None and before.get("type") == after.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]):
            raise ValueError("only byte-level BPE without normalizer, prefix space and special merging is supported")
        added = file.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take more or less than their own text aren't supported")
        self.settings = settings
        self.added = {t["content"]: t["id"] for t in added if t["content"]}
        byte_of = _byte_letters()
        as_bytes = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        ids = model["vocab"]
        spelled = {i: as_bytes(t) for t, i in (ids | self.added).items()}
        self.size = max(spelled) + 1
        lengths = np.zeros(self.size + 1, np.int64)  # the last is for ids that aren't in the vocabulary
        for i, b in spelled.items():
            lengths[i] = len(b)
        self.token_length, self.token_start = lengths, np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(self.size)), np.uint8)
        self.letter_ids = [ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]

    def decode(self, packed: list[bytes | None]) -> list[str]:
        """The texts that ids stand for; bytes that aren't UTF-8 become U+FFFD, ids not in the vocabulary nothing."""
        ids = np.frombuffer(b"".join(x or b"" for x in packed), "<u4").astype(np.int64)
        ids[ids > self.size] = self.size
        data = gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()
        ends = np.cumsum(np.concatenate(([0], self.token_length[ids])))[np.cumsum([len(x or b"") // 4 for x in packed], dtype=np.int64)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


class Bpe(Tokens):
    """Merges and known words besides: what encoding needs."""

    def __init__(self, settings: BpeSettings) -> None:
        from tokenizers import Tokenizer

        text = Path(settings.tokenizer_path).read_text(encoding="utf-8")
        file = json.loads(text)
        self._read(settings, file)
        model, ids = file["model"], file["model"]["vocab"]
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.byte_id = np.array(self.letter_ids, np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, made = (np.array([ids[t] for t in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        # where a merge can't make a symbol whose own pairs rank lower, all places of a rank merge in one round
        first_made = np.full(self.size, -1, np.int64)
        first_made[made] = np.arange(len(made))
        self.in_order = len(set(made.tolist())) == len(made) and bool((np.maximum(first_made[left], first_made[right]) < np.arange(len(made))).all())
        splitter = Tokenizer.from_str(text).pre_tokenizer
        newer = _newer_letters(splitter)
        self.odd, self.words, self.odd_words = newer[0] | newer[1], _word_pattern(set(), set()), _word_pattern(*newer)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {token: i for i, token in enumerate(self.added)}
        self.flat, self.start, self.length = np.array(list(self.added.values()), np.uint32), np.arange(len(self.added)), np.ones(len(self.added), np.int64)

    def _split(self, text: str) -> Iterator[str]:
        """Words of ``text``; an added token is a word of its own wherever it stands."""
        for part in self.cut_added.split(text) if self.cut_added else (text,):
            if part in self.added:
                yield part
                continue
            pattern = self.words if part.isascii() or self.odd.isdisjoint(part) else self.odd_words
            # a long text's words aren't all held at once
            yield from pattern.findall(part) if len(part) < 1_000_000 else (m.group() for m in pattern.finditer(part))

    def encode(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers; null is as empty."""
        block: list[str] = []
        counts: list[int] = []
        for text in texts:
            words = self._split(text or "")
            parts = []
            count = 0
            while new := list(islice(words, self.settings.words_per_block)):
                if len(new) == self.settings.words_per_block:
                    parts.append(self._ids(new)[0].tobytes())
                else:
                    block += new
                    count = len(new)
            counts.append(count)
            if parts:  # a text of many blocks goes out by itself, after those before it
                own, block = block[len(block) - count :], block[: len(block) - count]
                yield from self._packed(block, counts[:-1])
                yield b"".join(parts) + self._ids(own)[0].tobytes()
                block, counts = [], []
            elif len(block) >= self.settings.words_per_block:
                yield from self._packed(block, counts)
                block, counts = [], []
        yield from self._packed(block, counts)

    def _packed(self, words: list[str], counts: list[int]) -> Iterator[bytes]:
        ids, lengths = self._ids(words)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts, dtype=np.int64)] if counts else ()
        begin = 0
        for end in ends:
            yield ids[begin:end].tobytes()
            begin = end

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` one after another, and how many each has."""
        if len(self.known) > self.settings.known_words:
            self._forget()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            coded = [w.encode() for w in new]
            ids, lengths = self.merge(np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, len(coded)))
            known.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(lengths) - lengths))
            self.length, self.flat = np.concatenate((self.length, lengths)), np.concatenate((self.flat, ids))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return gather(self.flat, self.start[at], self.length[at]), self.length[at]

    def _ranks(self, symbols: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pairs that begin ``at`` these places; NO_RANK where none merges or the word ends."""
        key = symbols[at].astype(np.int64) * self.size + symbols[np.minimum(at + 1, len(symbols) - 1)]
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[place] == key) & ~last[at], self.pair_ranks[place], NO_RANK)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, whose bytes are in ``data`` one word after another, and how many each has. No word is empty."""
        count = np.zeros(len(lengths), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        symbols, word, size = self.byte_id[data], np.arange(len(lengths)), lengths.copy()
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(size) - 1] = True
        rank = self._ranks(symbols, last, np.arange(len(symbols)))
        while len(symbols):
            start = np.cumsum(size) - size
            lowest = np.minimum.reduceat(rank, start)
            live = lowest < NO_RANK
            if 2 * size[~live].sum() >= size.sum():  # words that are through leave once they are half of what is held
                keep = np.repeat(live, size)
                done.append((word[~live], symbols[~keep]))
                count[word[~live]] = size[~live]
                symbols, rank, last, word, size, lowest = symbols[keep], rank[keep], last[keep], word[live], size[live], lowest[live]
                if not len(symbols):
                    break
                start = np.cumsum(size) - size
            at = np.flatnonzero((rank == np.repeat(lowest, size)) & (rank < NO_RANK))
            owner = np.searchsorted(start, at, "right") - 1
            if self.in_order:  # of places side by side, where a symbol pairs with itself, every other one merges
                fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
                taken = (at - at[fresh][np.cumsum(fresh) - 1]) % 2 == 0
            else:  # one place a word and round, the leftmost
                taken = np.concatenate(([True], owner[1:] != owner[:-1]))
            at, owner = at[taken], owner[taken]
            symbols[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, rank, last = symbols[stays], rank[stays], last[stays]
            size = size - np.bincount(owner, minlength=len(size))
            at = at - np.arange(len(at))
            rank[at] = self._ranks(symbols, last, at)
            before = at[at > 0] - 1
            rank[before] = self._ranks(symbols, last, before)
        ids = np.empty(int(count.sum()), np.uint32)
        begin = np.cumsum(count) - count
        for words, own in done:
            ids[places(begin[words], count[words])] = own
        return ids, count


def places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] numbers), then those from start[1] on, and so forth."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return flat[places(start, length)]


#: Bytes of ids that a task holds before it hands them on.
HELD = 4_000_000
_CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DECODED = pa.schema([*_CODED, ("text", pa.string())])


def _encoded(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of batches (doc_id, text), in batches of about HELD bytes."""
    for batch in batches:
        begin, held, size = 0, [], 0
        for ids in bpe.encode(x.as_py() for x in batch.column(1)):
            held.append(ids)
            size += len(ids)
            if size > HELD:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), pa.array(held, pa.binary())], schema=_CODED)
                begin, held, size = begin + len(held), [], 0
        if held:
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), pa.array(held, pa.binary())], schema=_CODED)


def _decoded(batches: Iterator[pa.RecordBatch], tokens: Tokens) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, text) of batches (doc_id, ids), by so many rows at once that their ids take about HELD bytes."""
    for batch in batches:
        begin, rows, size = 0, [], 0
        last = len(batch) - 1
        for i, x in enumerate(batch.column(1)):
            rows.append(x.as_py())
            size += len(rows[-1] or b"")
            if size > HELD or i == last:
                cut = batch.slice(begin, len(rows))
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(tokens.decode(rows), pa.string())], schema=_DECODED)
                begin, rows, size = i + 1, [], 0


def encode(docs: DataFrame, settings: BpeSettings | None = None) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text, other columns are left out): ids are packed as little-endian
    unsigned 32-bit numbers, four bytes a token, as training readers take them.

    Null and empty texts have no ids (an empty binary, not null). doc_id is passed on whatever it is, null or repeated;
    an empty table gives an empty result. Tasks need nothing of each other, so lost ones are just run again. Memory holds
    one batch, its words by blocks, and the table of known words; a word of n bytes takes as many rounds as it merges
    different pairs. Texts with tokens of the file's list of added ones give these tokens' ids.
    """
    s = settings or default_settings()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _encoded(batches, Bpe.get(s)), "doc_id long, ids binary")


def decode(coded: DataFrame, settings: BpeSettings | None = None) -> DataFrame:
    """(doc_id, ids, text) for each row of ``coded`` (doc_id, ids as ``encode`` makes them). Null ids give an empty text and
    stay null."""
    s = settings or default_settings()
    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(lambda batches: _decoded(batches, Tokens.get(s)), "doc_id long, ids binary, text string")


def encode_and_decode(docs: DataFrame, settings: BpeSettings | None = None) -> DataFrame:
    """``decode(encode(docs))`` by one worker a task instead of two, to check an encoding where it is made."""
    s = settings or default_settings()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _decoded(_encoded(batches, Bpe.get(s)), Bpe.get(s)), "doc_id long, ids binary, text string")


def op11_merge_round_bpe(spark, sf_dir: str) -> DataFrame:
    back = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
