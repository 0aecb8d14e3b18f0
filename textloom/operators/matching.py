"""All occurrences of many terms in each text, and their resolution, without a shuffle.

The terms, counted to be within a bound, go to the tasks once. Where whole words are asked for, terms of one word are
looked up by the words of a text; a task builds one Aho-Corasick automaton of all other terms and walks texts by chunks
of letters. What it finds is checked for word ends in arrays, so only true matches become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of terms, all together, up to which tasks get an automaton of all, and of terms that are looked up as words.
AUTOMATON_CHARS, WORD_CHARS = 2_000_000, 5_000_000
#: Letters of texts that are walked at once, and rows that are handed on at once.
CHUNK_CHARS, CHUNK_ROWS = 400_000, 200_000
#: Stands between texts; no character, so terms with it never match.
APART = "\U0010ffff"


class Matcher:
    """Terms with the ids of each: an automaton and, for whole words, a look-up of those of one word."""

    _last: dict[tuple, Matcher] = {}
    _word: np.ndarray | None = None
    _lower: np.ndarray | None = None

    def __init__(self, terms: pa.Array, first_id: np.ndarray, ids: np.ndarray, whole_word: bool) -> None:
        """``ids`` from one ``first_id`` to the next are a term's places in the sorted ids, several where terms say the same."""
        import ahocorasick

        self.first_id, self.n_ids, self.ids, self.whole_word = first_id[:-1], np.diff(first_id), ids, whole_word
        self.length = np.zeros(len(terms), np.int64)
        self.words: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        word = self.word_letters()
        for i, x in enumerate(terms):
            term = x.as_py()
            self.length[i] = len(term)
            if whole_word and word[_codes(term)].all():
                self.words[term] = i
            else:
                self.automaton.add_word(term, i)
        if len(self.automaton):
            self.automaton.make_automaton()

    @classmethod
    def get(cls, key: tuple, *given) -> Matcher:
        """One of the last two in this worker process, if it is of the same terms."""
        if key not in cls._last:
            while len(cls._last) > 1:
                del cls._last[next(iter(cls._last))]
            cls._last[key] = cls(*given)
        return cls._last[key]

    @classmethod
    def word_letters(cls) -> np.ndarray:
        """Whether each code point is a letter, a number or a low line."""
        if cls._word is None:
            import regex

            word, one = np.zeros(0x110000, bool), regex.compile(r"[\p{L}\p{N}_]")
            # by blocks, so that a worker never holds a string for each code point
            for a in range(0, 0x110000, 0x800):
                if not 0xD800 <= a < 0xE000:
                    word[[ord(c) for c in one.findall("".join(map(chr, range(a, a + 0x800))))]] = True
            cls._word = word
        return cls._word

    @classmethod
    def lower_letters(cls) -> np.ndarray:
        """The small letter of each code point, or no code point where it isn't one of the same kind."""
        if cls._lower is None:
            small = np.fromiter((ord(x) if len(x) == 1 else 0 for x in map(str.lower, map(chr, range(0x110000)))), np.uint32, 0x110000)
            small[cls.word_letters()[small] != cls.word_letters()] = 0xFFFFFFFF
            cls._lower = small
        return cls._lower

    def walk(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, number of the term, start, end, whole) of all places of terms, of whole words only if the matcher is of
        those; ``whole`` tells whether no word goes on at either end."""
        joined = APART + APART.join(texts) + APART
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        word = self.word_letters()[_codes(joined)]
        term = end = np.zeros(0, np.int64)
        if len(self.automaton):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
            term, end = hits[:, 1], hits[:, 0] + 1
        start = end - self.length[term]
        whole = ~word[start - 1] & ~word[end]
        if self.whole_word:
            term, start, end = term[whole], start[whole], end[whole]
        if self.words:
            edge = np.flatnonzero(np.diff(word.view(np.int8))) + 1
            own = np.fromiter((self.words.get(joined[a:b], -1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())), np.int64, len(edge) // 2)
            kept = own >= 0
            term, start, end = (np.concatenate(x) for x in ((term, own[kept]), (start, edge[::2][kept]), (end, edge[1::2][kept])))
        if self.whole_word:
            whole = np.ones(len(term), bool)
        text = np.searchsorted(begins, start, "right") - 1
        return text, term, start - begins[text], end - begins[text], whole

    def find(self, texts: list[str], resolve: bool) -> tuple[np.ndarray, ...]:
        """(text, id, start, end) of all matches in ``texts``; with ``resolve`` the longest, then the earliest, then the
        smallest id of those that overlap."""
        text, term, start, end, _ = self.walk(texts)
        n = self.n_ids[term]
        each = np.repeat(np.arange(len(term)), n)
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(self.first_id[term] - (np.cumsum(n) - n), n)]
        text, start, end = text[each], start[each], end[each]
        if resolve and len(ids):
            # places of one text lie apart from those of the next
            at = np.cumsum([0, *(len(t) + 1 for t in texts)])[text]
            kept = disjoint(start + at, end + at, ids)
            text, ids, start, end = text[kept], ids[kept], start[kept], end[kept]
        return text, ids, start, end


def _letter_by_letter(text: str, folded: str) -> bool:
    """Whether ``folded`` is ``text`` with each letter made small by itself, so that equal places of texts stay equal."""
    if text.isascii() and folded.isascii():
        return True
    return len(text) == len(folded) and bool((Matcher.lower_letters()[_codes(text)] == _codes(folded)).all())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def disjoint(start: np.ndarray, end: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Which spans stay if longer ones go first, then earlier ones, then smaller terms, and none overlaps one that stays."""
    order = np.lexsort((term, end, start))
    s, e = start[order], end[order]
    reach = np.concatenate(([-1], np.maximum.accumulate(e)[:-1]))
    first = np.flatnonzero(s >= reach)
    size = np.diff(np.concatenate((first, [len(s)])))
    kept = [order[first[size == 1]]]
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
        own = order[a : a + n]
        taken: list[tuple[int, int]] = []
        for x, y, _, i in sorted(zip(start[own].tolist(), end[own].tolist(), term[own].tolist(), own.tolist()), key=lambda r: (r[0] - r[1], r[0], r[2])):
            if all(y <= b or x >= c for b, c in taken):
                taken.append((x, y))
                kept.append(np.array([i]))
    return np.sort(np.concatenate(kept))


def _chunks(texts: pa.Array, letters: int = CHUNK_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and their texts, of about so many ``letters``; rows without a text are left out."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if t:
            rows.append(i)
            held.append(t)
            size += len(t)
        if size > letters:
            yield rows, held
            rows, held, size = [], [], 0
    if held:
        yield rows, held


def _given(terms: DataFrame, whole_word: bool) -> tuple[Callable[[], Matcher], pa.Array]:
    """How tasks get a matcher of ``terms`` (term_id, term), and the ids, each once, in order: a smaller place is a smaller id."""
    rows = terms.select("term_id", "term").toArrow()
    each = sorted(set(zip(rows["term"].to_pylist(), rows["term_id"].to_pylist())))
    ids = sorted({i for _, i in each})
    place = {x: i for i, x in enumerate(ids)}
    said = sorted({t for t, _ in each})
    own = np.fromiter((place[i] for _, i in each), np.int64, len(each))
    number = {t: i for i, t in enumerate(said)}
    first = np.searchsorted(np.fromiter((number[t] for t, _ in each), np.int64, len(each)), np.arange(len(said) + 1))
    key = hashlib.sha256(repr(each).encode("utf-8", "surrogatepass")).hexdigest(), whole_word
    given = terms.sparkSession.sparkContext.broadcast((pa.array(said, pa.string()), first, own, whole_word))
    return (lambda: Matcher.get(key, *given.value)), pa.array(ids, rows["term_id"].type)


def counts_in_tasks(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, n_anywhere, n_whole): in how many of ``segments`` (text) each of ``terms`` (term_id, term) stands at all and
    as whole words, in parts to be added up. One walk finds both; a task hands on a row a term."""
    get, ids = _given(terms, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = get()
        n = len(matcher.length)
        anywhere, whole = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                text, term, _, _, ends = matcher.walk(texts)
                pair = text * n + term
                anywhere += np.bincount(np.unique(pair) % n, minlength=n)
                whole += np.bincount(np.unique(pair[ends]) % n, minlength=n)
        each = np.repeat(np.arange(n), matcher.n_ids)
        found = np.flatnonzero(anywhere[each])
        yield pa.record_batch([ids.take(pa.array(matcher.ids[found])), pa.array(anywhere[each[found]]), pa.array(whole[each[found]])], names=["term_id", "n_anywhere", "n_whole"])

    return segments.select("text").mapInArrow(run, f"term_id {_kind(terms, 'term_id')}, n_anywhere long, n_whole long")


def candidates_in_tasks(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(seg_id, term_id, start, end, place): whole-word matches of ``terms`` (term_id, term, folded) in ``segments`` (seg_id,
    text, folded), each as written or folded, once and numbered by place in its row.

    Where folding goes letter by letter what matches as written matches folded too; only other texts are walked for both.
    """
    exact, ids = _given(terms.select("term_id", "term"), True)
    low, _ = _given(terms.select("term_id", F.col("folded").alias("term")), True)
    pairs = terms.filter(F.col("term") != F.col("folded")).select("term", "folded").toArrow()
    plain = all(_letter_by_letter(a, b) for a, b in zip(pairs["term"].to_pylist(), pairs["folded"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = low()
        for batch in batches:
            for rows, texts in _chunks(batch.column(1)):
                folded = [batch.column(2)[i].as_py() for i in rows]
                found = matcher.find(folded, False)
                odd = [i for i, (a, b) in enumerate(zip(texts, folded)) if not (plain and _letter_by_letter(a, b))]
                if odd:
                    text, *others = exact().find([texts[i] for i in odd], False)
                    found = tuple(np.concatenate(x) for x in zip(found, (np.array(odd, np.int64)[text], *others)))
                order = np.lexsort((found[1], found[3], found[2], found[0]))
                text, term, start, end = (x[order] for x in found)
                new = np.ones(len(text), bool)
                new[1:] = np.any([np.diff(x) != 0 for x in (text, term, start, end)], axis=0)
                text, term, start, end = (x[new] for x in (text, term, start, end))
                place = np.arange(len(text)) - np.searchsorted(text, text) + 1
                row = np.array(rows, np.int64)[text]
                for a in range(0, len(row), CHUNK_ROWS):
                    own = slice(a, a + CHUNK_ROWS)
                    yield pa.record_batch([batch.column(0).take(pa.array(row[own])), ids.take(pa.array(term[own])), *(pa.array(x[own]) for x in (start, end, place))], names=["seg_id", "term_id", "start", "end", "place"])

    shape = f"seg_id {_kind(segments, 'seg_id')}, term_id {_kind(terms, 'term_id')}, start long, `end` long, place long"
    return segments.select("seg_id", "text", "folded").mapInArrow(run, shape)


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def find_in_tasks(segments: DataFrame, terms: DataFrame, whole_word: bool, resolve: bool, once: bool = False) -> DataFrame:
    """(seg_id, term_id, start, end) of ``terms`` (term_id, term), counted to be within bounds, in ``segments``
    (seg_id, text). Ids are of any type that sorts; texts stay in their tasks. With ``once`` a term has its first place in a
    row only."""
    get, ids = _given(terms, whole_word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = get()
        for batch in batches:
            for rows, texts in _chunks(batch.column(1)):
                text, term, start, end = matcher.find(texts, resolve)
                if once:
                    first = np.lexsort((start, term, text))
                    new = np.ones(len(first), bool)
                    new[1:] = (np.diff(text[first]) != 0) | (np.diff(term[first]) != 0)
                    text, term, start, end = (x[first[new]] for x in (text, term, start, end))
                row = np.array(rows, np.int64)[text]
                for a in range(0, len(row), CHUNK_ROWS):
                    b = a + CHUNK_ROWS
                    yield pa.record_batch([batch.column(0).take(pa.array(row[a:b])), ids.take(pa.array(term[a:b])), pa.array(start[a:b]), pa.array(end[a:b])], names=["seg_id", "term_id", "start", "end"])

    return segments.select("seg_id", "text").mapInArrow(run, f"seg_id {_kind(segments, 'seg_id')}, term_id {_kind(terms, 'term_id')}, start long, `end` long")
