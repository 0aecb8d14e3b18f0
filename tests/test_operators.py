"""Literal cases of the operators."""

import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from textloom.functions.spans import find_spans, greedy_disjoint, replace_spans
from textloom.operators import batching, glossary, layout, protect, qa, records
from textloom.operators import text as t
from textloom.streaming import jobs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("r")).first()["r"]


def test_find_spans_counts_code_points(spark):
    got = one(spark, "a𝒳b a", lambda x: find_spans(x, "[ab]"))
    assert [(s.start, s.end, s.value) for s in got] == [(0, 1, "a"), (2, 3, "b"), (4, 5, "a")]
    assert one(spark, None, lambda x: find_spans(x, "a")) == [] and one(spark, "", lambda x: find_spans(x, "a")) == []


def test_find_spans_of_long_texts_against_a_loop(spark):
    text = " ".join("ab𝒳"[: 1 + i % 3] + "." * (i % 4) for i in range(1000))
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+", text)]
    assert [tuple(x) for x in one(spark, text, lambda x: find_spans(x, r"[\p{L}\p{N}_]+"))] == want


def test_find_terms_of_several_words_and_marks(spark):
    texts = {1: "Open source code, open source. (Open) source codes", 2: None, 3: "", 4: "open"}
    terms = {1: "open", 2: "open source", 3: "open source code", 4: "(open)", 5: "source.", 6: "...", 7: "code, open"}
    s = spark.createDataFrame(list(texts.items()), "seg_id long, text string")
    g = spark.createDataFrame(list(terms.items()), "term_id long, source_term string")
    want = set()
    for seg, text in texts.items():
        low = (text or "").lower()
        for term_id, term in terms.items():
            for i in range(len(low)):
                before, after = low[i - 1 : i], low[i + len(term) : i + len(term) + 1]
                if term != "..." and low.startswith(term, i) and not before.isalnum() and not after.isalnum():
                    want.add((seg, term_id, i, i + len(term)))
    got = [tuple(r) for r in glossary.find_terms(s, g, case_sensitive=False).select("seg_id", "term_id", "start", "end").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_replace_spans(spark):
    got = one(spark, "one two two", lambda x: replace_spans(x, find_spans(x, "two"), lambda s, i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))))
    assert got == "one <0> <1>"


def test_greedy_takes_the_longest_first(spark):
    df = spark.createDataFrame([("s", 1, 0, 3), ("s", 2, 2, 10), ("s", 3, 9, 12), ("s", 4, 10, 12)], "seg_id string, term_id long, start long, end long")
    got = {(r.term_id, r.start) for r in glossary.resolve_overlaps(df).collect()}
    assert got == {(2, 2), (4, 10)}
    assert one(spark, 1, lambda x: greedy_disjoint(F.array().cast(protect.SPAN), protect.SPAN), "int") == []


@pytest.mark.parametrize("raw,clean", [
    ("ﬁrst\nsecond", "first second"), ("trans-\nlation", "translation"), ("A-\nB", "A- B"), ("one\n- two\n• three", "one\n- two\n• three"), ("a\n  b   c", "a b c"), ("so­ft", "soft"), ("", ""),
])
def test_normalize_lines(spark, raw, clean):
    assert one(spark, raw, t.normalize_lines) == clean


def test_term_keys(spark):
    assert one(spark, " Große  Straße ", t.term_key) == "grosse strasse"
    decomposed = unicodedata.normalize("NFD", "É ﬁx")
    assert one(spark, decomposed, t.exact_term_key) == "é fix"


def test_uuid5(spark):
    assert one(spark, "https://example.org/ä", t.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/ä"))


@pytest.mark.parametrize("raw,number", [("1,234.50", "1234.5"), ("1.234,50", "1234.5"), ("1.234", "1234"), ("3,14", "3.14"), ("2.0", "2"), ("+7", "+7"), ("-1.000.000", "-1000000"), ("12", "12")])
def test_canonical_number(spark, raw, number):
    assert one(spark, raw, t.canonical_number) == number


@pytest.mark.parametrize("url,state", [("https://a.b/c", "PRESERVED"), ("mailto:a@b.c", "PRESERVED"), ("ftp://a.b", "DISABLED"), ("a/b", "BROKEN"), ("http:///x", "BROKEN"), ("https://a.b/ c", "BROKEN"), ("mailto:a", "BROKEN"), (None, "BROKEN")])
def test_link_state(spark, url, state):
    assert one(spark, url, t.link_state)["state"] == state


SENTENCES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("Dr. Smith paid 3.50 today. Fine.", ["Dr. Smith paid 3.50 today.", "Fine."]), ("See e.g. Table 2. Next.", ["See e.g. Table 2.", "Next."]),
    ('He said "Go." Then left.', ['He said "Go."', "Then left."]), ("Wait... Now.", ["Wait...", "Now."]), ("it ends. not here", ["it ends. not here"]), ("", []),
    ("Read https://a.b/c.d. Then `x. Y` runs.", ["Read https://a.b/c.d.", "Then `x. Y` runs."]),
]


@pytest.mark.parametrize("text,parts", SENTENCES)
def test_sentences_native_and_exact(spark, text, parts):
    assert one(spark, text, layout.split_sentences) == parts
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.text for r in layout.sentences(df).orderBy("n").collect()] == parts


def test_protected_items_of_every_kind(spark):
    text = "Call `f(x)` at https://a.b/c?d=1). Mail a.b@c.org, GET /v1/items or /usr/lib/x.so [12] (Smith et al., 2020) snake_case NASA"
    got = {(r.kind, r.value) for r in protect.inventory(spark.createDataFrame([(1, text)], "k int, text string"), "k").collect()}
    assert {("CODE", "`f(x)`"), ("URL", "https://a.b/c?d=1"), ("EMAIL", "a.b@c.org"), ("ENDPOINT", "GET /v1/items"), ("FILE_PATH", "/usr/lib/x.so"), ("CITATION", "[12]"), ("CODE", "snake_case"), ("ACRONYM", "NASA"), ("CITATION", "(Smith et al., 2020)")} <= got


def test_mask_restore_and_audit(spark):
    d = protect.mask(spark.createDataFrame([(1, "NASA met ESA at a@b.org."), (2, None), (3, "")], "k int, text string"))
    r = d.select("k", "text", "masked", protect.restore(F.col("masked"), F.col("items")).alias("back"), protect.audit(F.col("masked"), F.col("items")).alias("a")).orderBy("k").collect()
    assert r[0].back == r[0].text and "NASA" not in r[0].masked and r[0].a == []
    swapped = d.filter("k = 1").select(protect.audit(F.concat_ws(" ", F.get("items", F.lit(1))["placeholder"], F.get("items", F.lit(0))["placeholder"], F.get("items", F.lit(2))["placeholder"]), F.col("items")).alias("a")).first()["a"]
    assert swapped == ["REORDERED"]


def test_many_items_in_one_text(spark):
    text = " ".join(f"AB{i}" for i in range(12_000))
    m = protect.mask(spark.createDataFrame([(text,)], "text string"))
    r = m.select("masked", protect.restore(F.col("masked"), F.col("items")).alias("back"), F.get("items", F.lit(11_999))["placeholder"].alias("last"), F.size(F.array_distinct(F.transform("items", lambda x: x["placeholder"]))).alias("n"), protect.audit(F.col("masked"), F.col("items")).alias("codes")).first()
    assert r.back == text and r.n == 12_000 and "_ACRONYM_12000_" in r.last and r.codes == []


def test_placeholders_avoid_tokens_of_the_text(spark):
    mask = lambda text: protect.mask(spark.createDataFrame([(text,)], "text string")).select("masked", "items", protect.restore(F.col("masked"), F.col("items")).alias("back")).first()
    plain = mask("use API here")["items"][0]["placeholder"]
    near = mask(f"use API here, not {plain}")
    kind = [x["placeholder"] for x in near["items"] if x["value"] == "API"][0]
    assert kind != plain and kind[:-4] == plain[:-4] and near["back"] == f"use API here, not {plain}"
    taken = " ".join(f"__TLM_ACRONYM_0001_{k:02X}__" for k in range(256))
    full = mask(f"API {taken}")
    assert [x["placeholder"] for x in full["items"] if x["value"] == "API"][0].startswith("__TLM_ACRONYM_0002_") and full["back"] == f"API {taken}"


def test_audit_codes(spark):
    m = protect.mask(spark.createDataFrame([("call API and SDK",)], "text string"))
    a, b = (F.get("items", F.lit(i))["placeholder"] for i in (0, 1))
    texts = {"ALTERED": F.concat(F.substring(a, 1, 20), F.lit("_0A__ "), b), "UNKNOWN": F.concat(a, b, F.lit("__TLM_CODE_0077_00__")), "MALFORMED": F.concat(a, b, F.lit(" __TLM_CODE"))}
    got = m.select(*[protect.audit(x, F.col("items")).alias(k) for k, x in texts.items()]).first()
    assert all(k in got[k] for k in texts) and "MISSING" in got["ALTERED"] and got["UNKNOWN"] == ["UNKNOWN"] and got["MALFORMED"] == ["MALFORMED"]


RULE = "term string, rule_id long, rule_type string, target string, scope string, scope_rank int, scope_reference_id string, priority int, conditions map<string,string>, active boolean"


@pytest.mark.parametrize(
    "a,b,want",
    [
        ({}, {"target": "u"}, ("TARGET", None)), ({}, {"rule_type": "KEEP_SOURCE", "target": None}, ("RULE", None)), ({}, {"scope": "DOCUMENT", "scope_rank": 4, "target": "u"}, ("SCOPE", 2)),
        ({}, {"priority": 3, "target": "u"}, ("SCOPE", 2)), ({"conditions": {"k": "x"}}, {"conditions": {"k": "x", "l": "y"}, "target": "u"}, ("CONTEXT", None)),
        ({"conditions": {"k": "x"}}, {"conditions": {"k": "z"}, "target": "u"}, None), ({"scope_reference_id": "p"}, {"scope_reference_id": "q", "target": "u"}, None), ({}, {}, None), ({}, {"active": False, "target": "u"}, None),
        ({"scope": "DOMAIN", "scope_reference_id": None}, {"scope": "DOMAIN", "scope_reference_id": "q", "target": "u"}, ("SCOPE", None)),
    ],
)
def test_conflicts(spark, a, b, want):
    base = {"term": "t", "rule_type": "PREFERRED", "target": "v", "scope": "PROJECT", "scope_rank": 3, "scope_reference_id": "p", "priority": 1, "conditions": {}, "active": True}
    rows = [base | a | {"rule_id": 1}, base | b | {"rule_id": 2}]
    got = [(r.kind, r.winner) for r in glossary.conflicts(spark.createDataFrame(rows, RULE)).collect()]
    assert got == ([want] if want else [])


def test_open_sessions_as_a_stream(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    for i, rows in enumerate([[(1, at(0)), (2, at(1)), (1, at(3))], [(2, at(4))], [(3, at(40))], [(3, at(41))]]):
        spark.createDataFrame(rows, "job_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    beats = spark.readStream.schema("job_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = jobs.open_sessions(beats).writeStream.format("memory").queryName("open_sessions").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {(r.job_id, r.last_beat.minute, r.stale) for r in spark.table("open_sessions").collect()}
    assert {(1, 3, True), (2, 4, True), (3, 41, False)} <= rows and not any(j == 3 and stale for j, _, stale in rows)


def test_batches_hold_their_limits(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate([40, 40, 4000, 40, 40, 40])]
    got = batching.greedy_batches(spark.createDataFrame(rows, "doc long, o int, text string"), ["doc"], ["o"], batching.BatchLimits(2, 100))
    assert [r.batch for r in got.orderBy("o").collect()] == [0, 0, 1, 2, 2, 3]
    assert batching.BatchLimits(5, 101).smaller() == batching.BatchLimits(3, 51)


def test_retry_levels(spark):
    got = [one(spark, n, batching.retry_level, "int") for n in (0, 1, 2, 4, 5, 6)]
    assert got == ["SAME", "SAME", "SMALLER", "SINGLE", "REDUCED_CONTEXT", "MANUAL_REVIEW"]


PAIRS = [
    ("It costs $1,200.50", "Harganya $1200.5", set()), ("It costs 12", "Harganya 13", {"NUMBER_MISMATCH"}), ("See https://a.b", "Lihat", {"URL_MISMATCH", "SUSPICIOUS_LENGTH"}),
    ("Never go", "Pergi saja", {"NEGATION_MISMATCH"}), ("Hello there", " ", {"EMPTY_TRANSLATION", "SUSPICIOUS_LENGTH"}), ("Version 1.2.3 of 2020-01-02", "Versi 1.2.3 dari 2020-01-02", set()),
    ("in the house of the king", "in the house of the king", {"TARGET_LANGUAGE_MISMATCH", "UNTRANSLATED_SOURCE_FRAGMENT"}), ("see [3]", "lihat", {"CITATION_MISMATCH", "NUMBER_MISMATCH"}), (None, None, {"EMPTY_TRANSLATION"}),
]


@pytest.mark.parametrize("source,target,codes", PAIRS)
def test_pair_checks(spark, source, target, codes):
    df = spark.createDataFrame([(1, source, target)], "pair_id long, source string, target string")
    assert {r.code for r in qa.issues(df).collect()} == codes


def test_mining(spark):
    s = spark.createDataFrame([(1, "Open Source tools and the Open Source tools use HTTP_CODE")], "seg_id long, text string")
    got = {r.term: (r.kind, r.n) for r in glossary.rank_candidates({"TECHNICAL_IDENTIFIER": glossary.technical_candidates(s), "NAMED_ENTITY": glossary.entity_candidates(s), "REPEATED_PHRASE": glossary.phrase_candidates(s)}).collect()}
    assert got["open source"] == ("NAMED_ENTITY", 2) and got["source tools"] == ("REPEATED_PHRASE", 2) and "tools and" not in got


def test_whole_words_and_places(spark):
    s = spark.createDataFrame([(1, "the theme, the end"), (2, None)], "seg_id long, text string")
    g = spark.createDataFrame([(7, "the"), (8, "the end")], "term_id long, source_term string")
    assert {(r.term_id, r.start) for r in glossary.find_terms(s, g).collect()} == {(7, 0), (7, 11), (8, 11)}
    assert {(r.term_id, r.start) for r in glossary.find_terms(s, g, whole_word=False).collect()} == {(7, 0), (7, 4), (7, 11), (8, 11)}


def test_scope_ties_give_no_winner(spark):
    c = spark.createDataFrame([("o1", 1, 3, 1, "KEEP", None), ("o1", 2, 3, 1, "PREFERRED", "x"), ("o2", 3, 2, 0, "KEEP", None), ("o2", 4, 5, 0, "FORBIDDEN", None)], "occ string, rule_id long, scope_rank int, priority int, rule_type string, target string")
    got = {r.occ: (r.rule_id, r.ambiguous) for r in glossary.scope_winners(c, "occ").collect()}
    assert got == {"o1": (None, True), "o2": (4, False)}


def test_components_and_union_area(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 5.0, 5.0, 10.0, 10.0), (1, 3, 100.0, 0.0, 10.0, 10.0)]
    b = spark.createDataFrame(rows, "page long, idx long, x double, y double, w double, h double")
    assert layout.union_area(b).first()["area"] == 275.0
    got = {r.idx: r.component for r in layout.page_components(b, layout.same_column()).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_state_machine_skips_what_is_locked(spark):
    log = spark.createDataFrame([(1, i, a) for i, a in enumerate(["edit", "lock", "edit", "unlock", "approve"])], "k long, o int, a string")
    r = records.fold_changes(log, "k", ["o"], "a").first()
    assert (r.state, r.revision) == ("APPROVED", 4)


def test_keyset_page(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, v long")
    got = [r.id for r in records.keyset_page(df, [("v", True), ("id", True)], (3, 7), 3).collect()]
    assert got == [6, 5, 4]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from textloom.streaming import jobs

    rows = [(f"2024-01-01 00:{m:02d}:00", j) for j, m in ((1, 0), (1, 3), (1, 20), (2, 1), (2, 1), (1, 22))]
    e = spark.createDataFrame(rows, "ts string, job_id long").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([("2024-06-01 00:00:00", 9)], "ts string, job_id long").withColumn("ts", F.to_timestamp("ts"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.sessions(stream, late="1 hour").writeStream.format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    last.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.job_id, str(r.started), r.beats)
    assert sorted(map(key, spark.table("s").collect())) == sorted(map(key, jobs.sessions(e).collect()))


def test_sinks_and_table_function(spark, tmp_path):
    from textloom.functions import udtf
    from textloom.sources import sinks

    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "project_id string, version int, term string")
    sinks.write_snapshot(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_snapshot(df, str(tmp_path / "s"))
    sinks.append_revisions(df, str(tmp_path / "r"))
    sinks.append_revisions(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    sinks.write_report(df, str(tmp_path / "j"))
    assert len(list((tmp_path / "j").glob("part-*.json"))) == 1
    udtf.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM find_spans('a1b22', '[0-9]+')").collect()] == [(1, 2, "1"), (3, 5, "22")]


@pytest.mark.parametrize("tiles", [layout.TileSettings(), layout.TileSettings(7, 3, 30), layout.TileSettings(1000, 1000), layout.TileSettings(5, 5, 0)])
def test_overlapping_pairs_against_all_pairs(spark, tiles):
    """Tiles of any size, wide boxes, boxes that only touch, equal boxes and boxes without area."""
    import random

    rng = random.Random(2)
    rows = [(page, i, float(rng.randint(-20, 90)), float(rng.randint(-9, 60)), float(rng.choice([0, 1, 5, 5, 20, 300])), float(rng.choice([0, 1, 4, 9, 90]))) for page in (1, 2) for i in range(60)]
    rows += [(3, 1, 0.0, 0.0, 10.0, 10.0), (3, 2, 10.0, 0.0, 10.0, 10.0), (3, 3, 0.0, 0.0, 10.0, 10.0), (3, 4, 9.5, 9.5, 0.25, 0.25)]
    want = set()
    for p in rows:
        for q in rows:
            across, down = min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]), min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])
            if p[0] == q[0] and p[1] < q[1] and across > 0 and down > 0 and p[4] * p[5] > 0 and q[4] * q[5] > 0:
                want.add((p[0], p[1], q[1]))
    boxes = spark.createDataFrame(rows, "page long, idx long, x double, y double, w double, h double")
    got = [tuple(r) for r in layout.overlapping_pairs(boxes, tiles).select("p.page", "p.idx", F.col("q.idx").alias("other")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_page_of_many_boxes_takes_time_in_proportion_to_its_hits(spark):
    n = 50_000  # all pairs would be over a thousand million
    boxes = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("idx"), ((F.col("id") % 250) * 30.0).alias("x"), (F.floor(F.col("id") / 250) * 12.0).alias("y"), F.lit(33.0).alias("w"), F.lit(11.0).alias("h"))
    assert layout.overlapping_pairs(boxes).count() == 200 * 249


def test_ledger_gives_a_line_break_one_kind(spark):
    d = spark.createDataFrame([(1, "wo-  \nrd"), (2, "wo-\na. b"), (3, "Wo-\nRd"), (4, "wo-\n\nrd"), (5, "x\n-"), (6, "x\n-\ny"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.kind.split("_")[0], r.start, r.end) for r in t.normalization_ledger(d).collect() if "BREAK" in r.kind)
    assert got == [
        (1, "HYPHENATED", 2, 6), (2, "HYPHENATED", 2, 4), (3, "VISUAL", 3, 4), (4, "VISUAL", 3, 4), (4, "VISUAL", 4, 5), (5, "PRESERVED", 1, 2), (6, "PRESERVED", 1, 2), (6, "VISUAL", 3, 4),
    ]


def test_pairs_differ_without_a_shuffle(spark):
    from textloom.plans.more import _differing

    token = "__TLM_CODE_0001_00__"
    rows = [(1, "see ABC", "see ABC"), (2, "see ABC", "see DEF"), (3, "no item", "none"), (4, "a@b.org ABC", "ABC a@b.org"), (5, token, "x"), (6, "ABC 1", "ABC 2"), (7, None, "ABC"), (8, f"{token} ABC", f"{token}  ABC")]
    pairs = spark.createDataFrame(rows, "pair_id int, source string, target string")
    found = _differing(pairs.na.fill("", ["source", "target"]), protect.placeholders_left)
    assert {r.pair_id for r in found.collect()} == {2, 4, 5, 7}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    masked = protect.mask(pairs.select(F.col("source").alias("text")).filter("text IS NOT NULL"))
    kept = masked.select(F.regexp_extract_all("masked", F.lit(protect.TOKEN), F.lit(0)).alias("a"), protect.placeholders_left(F.col("text")).alias("b")).collect()
    assert kept and all(r.a == r.b for r in kept)


def test_code_of_pairs_is_sought_in_a_text_computed_once(spark):
    d = spark.createDataFrame([("see a_b, www.x.org/a_c and `q`",)], "text string").select(qa.code_inventory(F.col("text")).alias("c"))
    assert d.first().c == ["`q`", "a_b"]
    # the text without its addresses is made at one place of the plan
    assert d._jdf.queryExecution().optimizedPlan().toString().count("https?") == 1
