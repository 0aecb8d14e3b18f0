"""BPE against the tokenizers library, collocations against counting, fill-in-the-middle against a walk over lines."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, collocations, fill_in_middle

SCHEMA = "doc_id long, text string, lang string, n long, form string, ids string, phrase string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, lang, 1, "f", "i", "p") for i, t, lang in rows], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_settings().tokenizer_path)


ODD = [None, "", " ", "\n\n  x\t y", "<|endoftext|>a<|endoftext|><|endoftext|> b", "don't WE'RE it's", "aaaaaaaaaaaaaaaaaaaaaaa" * 9, "é中文 テスト \U0001f600 ́", "1234 5,678 ²", "x" * 3000, "ab" * 700]


def test_bpe_equals_the_library(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab cd'st\n\té中\U0001f600<|endoftext|>12") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "null id"), (3, texts[3])]
    got = bpe.decode(bpe.encode(frame(spark, [(i, t, "en") for i, t in rows]))).collect()
    t = library()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0], bytes(r[1]))
    assert sorted([(r.doc_id, bytes(r.ids), r.text) for r in got], key=key) == sorted(want, key=key)
    assert sorted(bpe.encode_and_decode(frame(spark, [(i, t, "en") for i, t in rows])).collect(), key=key) == sorted(got, key=key)


def test_bpe_of_every_character():
    t, b = library(), bpe.Bpe.get(bpe.default_settings())
    every = [f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)}  {chr(c)} b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = ["".join(every[i : i + 500]) for i in range(0, len(every), 500)]
    for ids, want in zip(b.encode(iter(every)), t.encode_batch(every, add_special_tokens=False), strict=True):
        assert ids == np.array(want.ids, "<u4").tobytes()


def test_bpe_blocks_and_forgetting():
    """Small blocks and a small table of words change nothing, nor does a text of many blocks among short ones."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(n)) for n in (0, 3, 900, 2, 0, 450, 100, 1)]
    tiny = bpe.Bpe(bpe.BpeSettings(bpe.default_settings().tokenizer_path, known_words=40, words_per_block=100))
    want = [np.array(e.ids, "<u4").tobytes() for e in library().encode_batch(texts, add_special_tokens=False)]
    assert list(tiny.encode(iter(texts))) == want
    one_place = bpe.Bpe(bpe.default_settings())
    one_place.in_order = False  # the rounds for vocabularies whose merges may make lower ones
    assert list(one_place.encode(iter(texts))) == want and tiny.in_order


def test_merge_rounds_take_the_lowest_then_the_leftmost():
    """Merge rounds against the plain definition, with ranks in any order."""
    rng = random.Random(6)
    for in_order in (True, False):
        b = object.__new__(bpe.Bpe)
        made, ranks = {}, {}
        symbols = list(range(4))
        for rank in range(12):
            pair = rng.choice(symbols), rng.choice(symbols)
            if pair not in ranks:
                ranks[pair], made[pair] = len(ranks), len(symbols)
                symbols.append(len(symbols))
        if not in_order:
            shuffled = list(range(len(ranks)))
            rng.shuffle(shuffled)
            ranks = {p: shuffled[r] for p, r in ranks.items()}
        b.size, b.in_order, b.byte_id = len(symbols), in_order, np.arange(256, dtype=np.int32)
        keys = sorted(ranks, key=lambda p: p[0] * b.size + p[1])
        b.pair_keys = np.array([x * b.size + y for x, y in keys])
        b.pair_ranks = np.array([ranks[p] for p in keys], np.int32)
        by_rank = sorted(ranks, key=ranks.get)
        b.made = np.array([made[p] for p in by_rank], np.int32)
        words = [bytes(rng.randrange(4) for _ in range(rng.randint(1, 30))) for _ in range(200)]
        ids, count = b.merge(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
        end = np.cumsum(count)
        for w, a, z in zip(words, end - count, end, strict=True):
            x = list(w)
            while found := [(ranks[p], i) for i, p in enumerate(zip(x, x[1:])) if p in ranks]:
                _, i = min(found)
                x[i : i + 2] = [made[x[i], x[i + 1]]]
            assert list(ids[a:z]) == x


def counted(rows, s):
    """Collocations as the definition says, by counting every phrase."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, s.max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {x for x in f if f[x] >= s.min_count and len(x[1]) > 1}
    rows = []
    for lang, p in often:
        a = f[lang, p]
        inside = [q for m, q in often if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f[lang, q] >= s.covered_percent * a]
        if not inside:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= s.per_language:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return out


def prose(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "dd", "É", "e\x1f", "ff", "g"])
    passage = " ".join(word() for _ in range(12))
    rows = [(0, None, "en"), (1, "", None), (2, " .. ;\n\t", "en"), (3, "single", "en")]
    for i in range(n):
        t = " ".join(word() + rng.choice(["", "", "", ",", "\n", "\t \t"]) for _ in range(rng.randint(1, 60)))
        rows.append((i, t + (" unique" + str(i % 3) + " one path of words in a row " + passage if i % 4 == 0 else ""), rng.choice(["en", "de", None, "und"])))
    return rows + rows[-5:]


@pytest.mark.parametrize("max_words, min_count, slice_bytes", [(2, 3, 4_000_000), (3, 3, 4_000_000), (3, 10, 100), (5, 2, 700)])
def test_collocations_against_counting(spark, monkeypatch, max_words, min_count, slice_bytes):
    """Whatever the slices, the parts and what a task holds at once."""
    monkeypatch.setattr(collocations, "SLICE", slice_bytes)
    monkeypatch.setattr(collocations, "HELD", slice_bytes)
    s = collocations.CollocationSettings(max_words=max_words, min_count=min_count, per_language=50, parts=max_words * 3)
    rows = prose(max_words, 150)
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows), s).collect()))
    assert got == sorted(counted(rows, s)) and got


def test_paths_hold_every_edge_once(spark):
    s = collocations.CollocationSettings(min_count=2)
    line = " ".join(f"w{i}" for i in range(70))
    rows = [(i, line if i < 3 else "w3 w4 x " + " ".join(["y z"] * 5), "en") for i in range(6)]
    often, _ = collocations.counts(frame(spark, rows), s)
    placed, _ = collocations.paths(often[3], often[2], 3)
    found = {r.words: (r.edges, r.c) for r in collocations.compact_paths(placed, 3).collect()}
    assert found["w3 w4 x y z"] == (3, 3) or found["w3 w4 x"] == (1, 3)
    words = line.split()
    assert found[" ".join(words[:5])] == (3, 3) and found[" ".join(words[3:])] == (65, 3)
    assert sum(e for e, _ in found.values()) == placed.count() == placed.select("w1", "w2", "w3").distinct().count()


def test_gram_keys_beyond_62_bits():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 3, 500) for _ in range(6)]
    first, number = collocations._added_up(cols, [1 << 30] * 6, np.ones(500, np.int64))
    assert Counter(zip(*(c.tolist() for c in cols))) == {tuple(int(c[i]) for c in cols): int(k) for i, k in zip(first, number)}


def test_scores_beyond_64_bits(spark):
    a, left, right = 10**13, 3 * 10**13, 2 * 10**13 + 7
    got = spark.range(1).select(collocations._score(F.lit(a), F.lit(left), F.lit(right))).first()[0]
    assert got == 10**6 * a * a // (left * right)


def middle(doc_id, text, s):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= s.rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < s.suffix_first:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("settings", [fill_in_middle.FimSettings(), fill_in_middle.FimSettings(seed=1, rate=60, suffix_first=0)])
def test_fill_in_middle(spark, settings):
    rng = random.Random(8)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "x<P>y", "<M>", "<", "P>", "S>\n<", "\U0001f600\né\r\n\x0b中\n", "long\n" * 20_000, "y" * 100_000]
    texts += ["".join(rng.choice("ab<PSM>\né\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no\nid\n"), (4, "a")]
    made = fill_in_middle.fill_in_middle(frame(spark, [(i, t, "en") for i, t in rows]), settings)
    assert sorted(made.columns) == sorted(["doc_id", "text", "lang", "ids", "phrase", "n", "form", "output", "prefix_chars", "middle_chars"])
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), settings)).collect()
    want = Counter((i, *middle(i, t, settings)) for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == ({"plain", "psm", "spm"} if settings.suffix_first else {"plain", "psm"})


def test_fill_in_middle_of_other_units_and_marks(spark):
    s = fill_in_middle.FimSettings(unit="[a-z]+ ?", prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two three", "not covered 1", "four"])], "doc_id long, text string")
    got = {r.doc_id: r for r in fill_in_middle.fill_in_middle(docs, s).collect()}
    assert got[0].n == 3 and got[1].form == "plain" and got[1].output == "not covered 1" and got[2].form != "plain"
    with pytest.raises(ValueError):
        fill_in_middle.FimSettings(prefix_mark="aa")
    with pytest.raises(ValueError):
        fill_in_middle.FimSettings(prefix_mark="<P>x", middle_mark="x<M>")


def test_queries_on_the_smallest_tables(spark):
    """What the queries return against the library and the definitions, over all documents."""
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    t = library()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}
    got = bpe.op11_merge_round_bpe(spark, d).collect()
    assert {tuple(r) for r in got} == {(i, len(v), sha(struct.pack(f"<{len(v)}I", *v)), sha(t.decode(v, skip_special_tokens=False).encode())) for i, v in ids.items()}
    assert sorted(map(tuple, collocations.op12_de_bruijn_collocations(spark, d).collect())) == sorted(counted(rows, collocations.CollocationSettings()))
    want = {(i, *middle(i, x, fill_in_middle.FimSettings())) for i, x, _ in rows}
    text = {i: x or "" for i, x, _ in rows}
    assert {tuple(r) for r in fill_in_middle.op13_fill_in_middle(spark, d).collect()} == {(i, n, f, p, m, sha(o.encode()), sha(text[i].encode())) for i, n, f, p, m, o in want}


def test_empty_tables_of_the_three(spark):
    empty = frame(spark, [])
    assert bpe.decode(bpe.encode(empty)).count() == 0 and collocations.collocations(empty).count() == 0 and fill_in_middle.fill_in_middle(empty).count() == 0
    blank = frame(spark, [(None, None, None), (1, "", "en")])
    assert collocations.collocations(blank).count() == 0 and {bytes(r.ids) for r in bpe.encode(blank).collect()} == {b""}
