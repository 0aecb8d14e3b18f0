"""The matcher and the maintained table of occurrences against brute force; committed versions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import glossary, matching, occurrences
from textloom.sources import committed


def brute(texts, terms, case_sensitive, whole_word):
    fold = (lambda x: x) if case_sensitive else str.lower
    word = lambda c: c.isalnum() or c == "_"
    out = set()
    for seg, text in texts:
        t = fold(text or "")
        for term_id, term in terms:
            k = fold(term or "")
            if not k or whole_word and not any(map(word, k)):
                continue
            for i in range(len(t) - len(k) + 1):
                if t.startswith(k, i) and not (whole_word and (i and word(t[i - 1]) or i + len(k) < len(t) and word(t[i + len(k)]))):
                    out.add((seg, term_id, i, i + len(k)))
    return out


def made(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("aAbB_ .é\U0001f600-1") for _ in range(rng.randint(0, n)))
    texts = [(i, some(60)) for i in range(40)] + [(100, None), (101, ""), (102, "ab " * 3000)]
    terms = [(i, some(5)) for i in range(60)] + [(200, "ab"), (201, "ab ab"), (202, "AB"), (203, "..."), (204, None), (200, "ab")]
    return texts, terms


def frames(spark, texts, terms):
    return spark.createDataFrame(texts, "seg_id long, text string"), spark.createDataFrame(terms, "term_id long, source_term string")


@pytest.mark.parametrize("chars, chunk", [(2_000_000, 400_000), (2_000_000, 50), (0, 400_000)])
def test_matches_against_brute_force(spark, monkeypatch, chars, chunk):
    """With an automaton, in small chunks, and by shuffle where terms are too many for one."""
    monkeypatch.setattr(matching, "AUTOMATON_CHARS", chars)
    monkeypatch.setattr(matching, "CHUNK_CHARS", chunk)
    texts, terms = made(1)
    s, t = frames(spark, texts, terms)
    for case_sensitive, whole_word in ((True, True), (False, True), (True, False)):
        got = [tuple(r) for r in glossary.find_terms(s, t, case_sensitive, whole_word).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts, terms, case_sensitive, whole_word)
    got = {tuple(r) for r in glossary.resolved_terms(s, t, False).collect()}
    taken = set()
    for seg, term, a, b in sorted(brute(texts, terms, False, True), key=lambda r: (r[0], r[2] - r[3], r[2], r[1])):
        if not any(x[0] == seg and a < x[3] and x[2] < b for x in taken):
            taken.add((seg, term, a, b))
    assert got == taken == {tuple(r) for r in glossary.resolve_overlaps(glossary.find_terms(s, t, False)).collect()}


def test_matches_are_found_without_a_shuffle(spark):
    texts, terms = made(2)
    s, t = frames(spark, texts, terms)
    plan = glossary.resolved_terms(s, t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    empty = s.limit(0), t.limit(0)
    assert glossary.find_terms(empty[0], t).count() == glossary.find_terms(s, empty[1]).count() == 0


def test_the_kept_table_follows_changes_on_both_sides(spark, tmp_path):
    rng = random.Random(5)
    texts, terms = made(3)
    path = f"file://{tmp_path}/occ"

    def check(want):
        s, t = frames(spark, texts, terms)
        changes = occurrences.refresh(spark, path, s, t)
        assert changes == want
        got = [tuple(r) for r in occurrences.occurrences(spark, path, s, t).collect()]
        full = {tuple(r) for r in glossary.find_terms(s, t, False).collect()}
        assert len(got) == len(set(got)) and set(got) == full

    said = lambda rows: {x for _, x in rows if x is not None}
    check({"new_texts": len(said(texts) - {""}), "gone_texts": 0, "new_terms": len(said(terms)), "gone_terms": 0})
    check({"new_texts": 0, "gone_texts": 0, "new_terms": 0, "gone_terms": 0})
    assert committed.current(spark, path)[0] == 1
    for _ in range(2):  # some texts and terms change, go and come; one text moves to another segment
        before = said(texts) - {""}, said(terms)
        texts = [(i, x + " ab new" if x and rng.random() < 0.05 else x) for i, x in texts[1:]] + [(500 + len(texts), "ab 1 ab"), (600 + len(texts), texts[5][1])]
        terms = [(i, "b_" if rng.random() < 0.03 else x) for i, x in terms[1:]] + [(700, "new"), (701, "1 ab")]
        after = said(texts) - {""}, said(terms)
        check({"new_texts": len(after[0] - before[0]), "gone_texts": len(before[0] - after[0]), "new_terms": len(after[1] - before[1]), "gone_terms": len(before[1] - after[1])})


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/catalogue"
    assert committed.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path, "models")
    assert committed.commit(spark, path, {"models": spark.range(3), "prices": spark.range(1)}) == 1
    dies = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("dies"))).alias("id"))
    with pytest.raises(Exception, match="dies"):
        committed.commit(spark, path, {"models": spark.range(5), "prices": dies})
    assert committed.current(spark, path)[0] == 1 and committed.read_committed(spark, path, "models").count() == 3
    assert len([x for x in (tmp_path / "catalogue").iterdir() if x.name.startswith("v-")]) == 1
    # a version may be made from the one before, and two writers of one version don't both win
    assert committed.commit(spark, path, {"models": committed.read_committed(spark, path, "models").unionAll(spark.range(2))}) == 2
    with pytest.raises(FileExistsError):
        committed.commit(spark, path, {"models": spark.range(7)}, after=1)
    assert committed.read_committed(spark, path, "models").count() == 5
    assert committed.commit(spark, path, {"models": spark.range(1)}) == 3
    committed.drop_old_versions(spark, path, keep=1)
    assert committed.read_committed(spark, path, "models").count() == 1 and len([x for x in (tmp_path / "catalogue").iterdir() if x.name.startswith("v-")]) == 1


def test_phrases_against_a_loop_and_in_one_long_line(spark):
    import random

    import regex

    from textloom.operators import glossary, phrases

    rng, word = random.Random(3), r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"
    texts = ["".join(rng.choices(["a", "the", "The", "é", "x1", "_", "𝒳", "'", "’", " ", " ", "-", ".", "\t"], k=rng.randint(0, 25))) for _ in range(400)]

    def loop(text, common):
        w = list(regex.finditer(word, text))
        for n in (2, 3):
            for i in range(len(w) - n + 1):
                run = w[i : i + n]
                if all(regex.fullmatch(r"[ \t\n\x0b\f\r-]+", text[x.end() : y.start()]) for x, y in zip(run, run[1:])) and not {run[0][0].lower(), run[-1][0].lower()} & common:
                    yield run[0].start(), run[-1].end(), text[run[0].start() : run[-1].end()]

    s = spark.createDataFrame([*enumerate(texts), (-1, None)], "seg_id long, text string")
    for common, table in ((("a", "the"), None), ((), spark.createDataFrame([("a",), ("the",)], "word string"))):
        found = glossary.phrase_candidates(s, glossary.MiningSettings(max_words=3, common=common), table)
        assert sorted(map(tuple, found.collect())) == sorted((i, *x) for i, t in enumerate(texts) for x in loop(t, {"a", "the"}))
    # places come from arrays: a line of many words isn't walked again for each
    joined, _, found = phrases.word_runs(["ab " * 200_000], 2, 4, frozenset(("of",)))
    assert len(found[0]) == 3 * 200_000 - 6 and joined[found[0][-1] : found[3][-1]] == "ab ab ab ab"


def test_ranks_of_places_compared_in_tasks_are_those_of_rows(spark):
    from textloom.operators import glossary as g

    texts = ["The Blue House of Java, the Blue House; fooBar fooBar red car", "red car and Red car. The Blue House", None, "", "red-car HTTP HTTP x_y", "𝒳 Blue House fooBar red car"]
    s = spark.createDataFrame([*enumerate(texts * 3)], "seg_id long, text string")
    rows = g.rank_candidates({"TECHNICAL_IDENTIFIER": g.technical_candidates(s), "NAMED_ENTITY": g.entity_candidates(s), "REPEATED_PHRASE": g.phrase_candidates(s)})
    columns = ["term", "kind", "variant", "n", "confidence"]
    got = g.rank_mined(s)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, rows.select(columns).collect())) and {r.kind for r in got.collect()} == {"TECHNICAL_IDENTIFIER", "NAMED_ENTITY", "REPEATED_PHRASE"}
    # one shuffle, of counted spellings: no place of a text leaves its task
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1 and "seg_id" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]


def test_held_terms_once_a_text(spark):
    texts = spark.createDataFrame([(1, "red red\nRED fox"), (1, "red"), (2, "redder fox fox"), (3, None), (4, "")], "seg_id long, text string")
    terms = spark.createDataFrame([(7, "red"), (8, "fox"), (9, "Red Fox")], "term_id long, source_term string")
    held = glossary.held_terms(texts, terms, False)
    assert sorted(tuple(r) for r in held.collect()) == [(1, 7), (1, 8), (1, 9), (2, 8)]
    # a text's repeats are left in its task
    rows = glossary._matches(texts, terms, False, True, False, True)
    assert sorted((r.seg_id, r.term_id) for r in rows.collect()) == [(1, 7), (1, 7), (1, 8), (1, 9), (2, 8)]


def test_words_are_looked_up_where_an_automaton_has_no_room(spark, monkeypatch):
    monkeypatch.setattr(matching, "AUTOMATON_CHARS", 8)
    texts = [(1, "Alpha beta alphabet beta-alpha"), (2, "gamma_x gamma"), (3, None)]
    terms = [(i, t) for i, t in enumerate(["alpha", "beta", "gamma", "delta", "alphabet", "a-b"])]
    s, t = frames(spark, texts, terms)
    found = glossary.find_terms(s, t, False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    assert {tuple(r) for r in found.collect()} == brute(texts, terms, False, True)


@pytest.mark.parametrize("chars", [2_000_000, 60])
@pytest.mark.parametrize("again", [False, True])
def test_segments_are_counted_in_tasks(spark, monkeypatch, chars, again):
    """By one automaton and by blocks; a repeated segment is a row of its own anywhere, and one segment for whole words."""
    monkeypatch.setattr(matching, "AUTOMATON_CHARS", chars)
    texts, terms = made(4)
    terms = sorted({(i, t) for i, t in terms if t})
    texts = texts + texts[:5] * again
    s, t = frames(spark, texts, terms)
    found = glossary.segment_counts(s, t)
    if not again:
        assert "seg_id" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    word = lambda c: c.isalnum() or c == "_"
    want = {}
    for i, term in terms:
        rows = [(seg, x) for seg, x in texts if x and term in x]
        if rows:
            want[i] = len(rows), len({m[0] for m in brute(rows, [(i, term)], True, True)}) if any(map(word, term)) else 0
    assert {r.term_id: (r.n_anywhere, r.n_whole) for r in found.collect()} == want


@pytest.mark.parametrize("again", [False, True])
def test_candidates_are_numbered_where_their_texts_are(spark, again):
    """Also where folding moves places (a capital dotted I becomes two letters) and where a segment has two rows."""
    texts, terms = made(6)
    texts = texts + [(200, "\u0130 AB ab \u0130\u0130 ab"), (201, "\u00c9 ab \u00e9"), (202, "\u03a3\u03a3 \u03a3. ab")] + [(5, "ab AB")] * again
    terms = sorted({(i, t) for i, t in terms if t}) + [(300, "\u00c9"), (301, "\u0130"), (302, "\u03a3\u03a3")]
    s, t = frames(spark, texts, terms)
    found = glossary.numbered_candidates(s, t)
    assert again or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    each = {tuple(r) for x in (True, False) for r in glossary.find_terms(s, t, x).collect()}
    want, last, place = set(), None, 0
    for r in sorted(each, key=lambda r: (r[0], r[2], r[3], r[1])):
        place, last = (place + 1 if r[0] == last else 1), r[0]
        want.add((*r, place))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("many", [100_000, 0])
@pytest.mark.parametrize("again", [False, True])
def test_phrases_are_counted_in_tasks(spark, monkeypatch, many, again):
    monkeypatch.setattr(glossary, "MANY_WORDS", many)
    docs = [(1, "en", "The red fox\n \nthe Red  fox ran"), (2, "en", "a red fox"), (3, "en", "a dog"), (4, "en", "a cat"), (5, "en", "a a a"), (6, "de", " \n "), (7, None, "x y"), (8, "en", None)]
    docs = docs + [(1, "en", "dog dog"), (1, "en", "dog")] * again
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    stop = glossary.words_of_share(d, 2)
    # two of five documents of the language hold red and fox, four hold a
    assert {r.word for r in stop.collect()} == {"a"}
    words = stop if again else stop.unionByName(spark.createDataFrame([("the",)], "word string"))
    found = glossary.phrase_counts(d.select(F.explode(F.split("text", "\n")).alias("text"), F.monotonically_increasing_id().alias("seg_id")), glossary.MiningSettings(max_words=2), words)
    want = {"red fox": 2, "red  fox": 1, "fox ran": 1, "x y": 1} | ({"the red": 2, "dog dog": 1} if again else {})
    assert {r.phrase: r.n for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert many == 0 or "Join" not in plan


def test_winners_by_reference_make_the_rules_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(1, "DOCUMENT", 4, 0, "KEEP_SOURCE", None, 7), (2, "DOCUMENT", 4, 1, "FORBIDDEN", None, 7), (3, "DOMAIN", 1, 2, "PREFERRED", "x", 8), (4, "DOMAIN", 1, 2, "PREFERRED", "y", 8), (5, "USER", 2, 9, "FORBIDDEN", None, 7)]
    kind = "rule_id long, scope string, scope_rank long, priority long, rule_type string, target string, at long"
    rules = spark.createDataFrame(rows, kind).mapInArrow(count, kind)
    segments = spark.createDataFrame([(10, 7, 8), (11, 9, 8), (12, 9, 9), (13, None, 8)], "seg_id long, doc long, source long")
    won = glossary.winners_by_reference(segments, rules, {"DOCUMENT": (F.col("at"), F.col("doc")), "DOMAIN": (F.col("at"), F.col("source"))}, "seg_id")
    assert sorted(map(tuple, won.collect())) == [(10, 2, False), (11, None, True), (13, None, True)]
    assert made.value == len(rows)
