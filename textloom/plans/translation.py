"""Protected spans, batches and target checks over documents, segments, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import batching as b
from textloom.operators import protect as p
from textloom.operators import qa
from textloom.operators import text as t
from textloom.plans.base import query
from textloom.sources import views as v
from textloom.sources.tables import read

_MAIL = r"[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
_ACRONYM = r"[A-Z]{2,}[0-9]*|[A-Z][0-9][A-Z0-9]*"
# In SQL an item is an e-mail address or a word that is an acronym; the other kinds are counted with the same meaning below
# and stand nowhere inside these. Marks between words stand twice there, so that two matches may share one.
_TOKENS = rf"(?i:{_MAIL})|[\pL\pN_]+"
_W = r"\pL\pM\pN\p{Pc}"
_NAMES = rf"(?:^|[^{_W}])((?:[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9_]*(?:\.\.[A-Za-z_][A-Za-z0-9_]*)+)(?:\(\(\)\))?)(?:[^{_W}]|$)"
_OTHERS = {
    "URL": (r"(?i)(?:https?://|www\.)[^\s<>\"'']+",), "CODE": (r"```[\s\S]*?```|`[^`\r\n]+`",),
    "ENDPOINT": (r"(?i)(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[A-Za-z0-9._~{}:/-]+", r"(?i)/(?:api|v[0-9]+)(?:/[A-Za-z0-9._~{}:-]+)+"),
    "FILE_PATH": (r"(?:[A-Za-z]:\\|\\\\[A-Za-z0-9._$-]+\\)[^\s]+", r"(?:[A-Za-z0-9._~-]+[\\/])+[A-Za-z0-9._~-]*[A-Za-z0-9_~)-]"),
    "CITATION": (r"\[(?:\d{1,4})(?:\s*[-,;]\s*\d{1,4})*\]", r"\([A-Z][\pL\pN_''-]+(?:\s+et\s+al\.)?(?:\s*&\s*[A-Z][\pL\pN_''-]+)?,\s*(?:19|20)\d{2}[a-z]?\)"),
}


def _items(table: str, key: str, text: str = "text") -> str:
    """SQL: the tokens of a text with the gap before each, and of each item its kind, number and placeholder."""
    return rf"""SELECT {key}, i, w, gap, kind, number, CASE WHEN kind <> '' THEN '__TLM_' || kind || '_' || format('{{:04d}}', number) || '_' || upper(left(sha256(encode(kind) || unhex('00') || encode(number::VARCHAR) || unhex('00') || encode(w)), 2)) || '__' END AS placeholder
      FROM (SELECT *, sum((kind <> '')::INT) OVER (PARTITION BY {key} ORDER BY i)::BIGINT AS number FROM (SELECT {key}, i, w[i] AS w, g[i] AS gap, CASE WHEN contains(w[i], '@') THEN 'EMAIL' WHEN regexp_full_match(w[i], '{_ACRONYM}') THEN 'ACRONYM' ELSE '' END AS kind
        FROM (SELECT {key}, regexp_extract_all({text}, '{_TOKENS}') AS w, string_split_regex({text}, '{_TOKENS}') AS g FROM {table}) a, unnest(range(1, len(w) + 1)) u(i)) b) c"""


def _masked(table: str, key: str, text: str = "text") -> str:
    """SQL: ({key}, masked, items): texts with placeholders, and the placeholders in order."""
    return rf"""SELECT t.{key}, coalesce(m.head, '') || coalesce(string_split_regex(t.{text}, '{_TOKENS}')[-1], t.{text}) AS masked, coalesce(m.items, []) AS items FROM {table} t
      LEFT JOIN (SELECT {key}, string_agg(gap || coalesce(placeholder, w), '' ORDER BY i) AS head, list(placeholder ORDER BY i) FILTER (WHERE kind <> '') AS items FROM ({_items(table, key, text)}) x GROUP BY {key}) m ON m.{key} = t.{key}"""


_TOKEN_SQL = "__TLM_(?:" + "|".join(p.KINDS) + ")_[0-9]{4,}_[0-9A-F]{2}__"
_BARE = f"regexp_replace(text, '(?i){_MAIL}', ' ', 'g')"
_KINDS_SQL = " UNION ALL ".join(
    [f"SELECT lang, kind FROM (SELECT i.kind, s.lang FROM ({_items('v_segments', 'seg_id')}) i JOIN v_segments s USING (seg_id) WHERE i.kind <> '') k"]
    + [f"SELECT lang, '{kind}' FROM (SELECT lang, unnest(regexp_extract_all({_BARE}, '{one}')) FROM v_segments) o" for kind, every in _OTHERS.items() for one in every]
    + [f"SELECT lang, 'CODE' FROM (SELECT lang, unnest(regexp_extract_all(regexp_replace({_BARE}, '([^{_W}])', '\\1\\1', 'g'), '{_NAMES}', 1)) FROM v_segments) o"]
)


@query("protected_inventory_by_language", f"SELECT lang, kind, count(*) AS n FROM ({_KINDS_SQL}) q GROUP BY ALL", "v_segments")
def _(spark, d):
    return p.inventory(v.segments(spark, d), "seg_id", "lang").groupBy("lang", "kind").agg(F.count("*").alias("n"))


@query("p01_protected_items")
def _(spark, d):
    return p.inventory(read(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query("p02_url_ends", r"""SELECT page_id, u AS raw, regexp_replace(u, '[.,;:!?]+$', '') AS url FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(https?://|www\.)[^\s<>"'']+')) AS u FROM pages) q""")
def _(spark, d):
    u = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(p.PATTERNS[2][1]), F.lit(0))).alias("raw"))
    return u.withColumn("url", p.trim_end(F.lit("URL"), F.col("raw")))


def _benchmark_spans(spark, d):
    """Segments with the spans of benchmark lines in them, one a term and place, as array ``extra``: what a glossary adds to the patterns."""
    from textloom.operators import glossary as g

    # rows that share a seg_id, or have none, are told apart by their texts
    s = v.segments(spark, d).withColumn("row", F.concat_ws(":", "seg_id", F.sha2("text", 256)))
    terms = v.glossary(spark, d).filter("term_id < 1000000000")
    found = g.find_terms(s.select(F.col("row").alias("seg_id"), "text"), terms).groupBy(F.col("seg_id").alias("row")).agg(F.collect_set(F.struct("start", "end", "term_id")).alias("found"))
    rank = p.KINDS.index("TERM")

    def span(x):
        n, start = (x["end"] - x["start"]).cast("int"), x["start"].cast("int")
        return F.struct((-n).alias("n"), start.alias("start"), F.lit(rank).alias("rank"), x["end"].cast("int").alias("end"), F.lit("TERM").alias("kind"), F.substring(F.col("text"), start + 1, n).alias("value"))

    spans = F.coalesce(F.transform("found", span).cast(p.SPAN), F.array().cast(p.SPAN))
    return s.join(found, "row", "left").withColumn("extra", spans).drop("row", "found")


_MERGED = f"""SELECT seg_id, 'TERM' AS kind, s, e FROM (SELECT s.seg_id, instr(s.text, g.source_term) - 1 AS s, instr(s.text, g.source_term) - 1 + length(g.source_term) AS e FROM v_segments s JOIN v_glossary g ON g.term_id < 1000000000 AND contains(s.text, g.source_term)) t
    UNION ALL SELECT seg_id, kind, e - length(w), e FROM (SELECT seg_id, kind, w, sum(length(gap) + length(w)) OVER (PARTITION BY seg_id ORDER BY i) AS e FROM ({_items('v_segments', 'seg_id')}) i) j WHERE kind <> ''"""


@query("p03_merged_spans", f'SELECT seg_id, kind, s::INT AS "start", e::INT AS "end" FROM ({_MERGED}) m', "v_segments", "v_glossary")
def _(spark, d):
    spans = p.protected_spans(F.col("text"), F.col("extra"))
    # addresses hold dotted names, which resolving takes out
    outside = F.filter(spans, lambda s: (s["kind"] != "CODE") | ~F.exists(spans, lambda m: (m["kind"] == "EMAIL") & (m["start"] <= s["start"]) & (s["end"] <= m["end"])))
    return _benchmark_spans(spark, d).select("seg_id", F.inline(outside)).select("seg_id", "kind", "start", "end")


@query("p04_resolved_spans", f"""SELECT seg_id, kind, s::INT AS "start", e::INT AS "end" FROM ({_MERGED}) m WHERE kind = 'TERM' OR NOT EXISTS (SELECT 1 FROM ({_MERGED}) t WHERE t.kind = 'TERM' AND t.seg_id = m.seg_id AND t.s < m.e AND m.s < t.e AND t.e - t.s > m.e - m.s)""", "v_segments", "v_glossary")
def _(spark, d):
    return p.inventory(_benchmark_spans(spark, d), "seg_id", extra=F.col("extra")).select("seg_id", "kind", "start", "end")


@query("p05_placeholders", f"SELECT seg_id, number, kind, placeholder FROM ({_items('v_segments', 'seg_id')}) i WHERE kind <> ''", "v_segments")
def _(spark, d):
    items = p.inventory(v.segments(spark, d), "seg_id")
    n = F.row_number().over(Window.partitionBy("seg_id").orderBy("start")).cast("long")
    return items.withColumn("number", n).select("seg_id", "number", "kind", p.placeholder(F.col("kind"), F.col("number"), F.col("value")).alias("placeholder"))


@query("p06_masked_texts", f"SELECT seg_id, masked, len(items)::BIGINT AS n_items FROM ({_masked('v_segments', 'seg_id')}) m", "v_segments")
def _(spark, d):
    return p.mask(v.segments(spark, d).select("seg_id", "text")).select("seg_id", "masked", F.size("items").cast("long").alias("n_items"))


@query("p08_round_trip", "SELECT doc_id, sha256(text) AS restored FROM documents")
def _(spark, d):
    m = p.mask(read(spark, d, "documents").select("doc_id", "text"))
    return m.select("doc_id", F.sha2(p.restore(F.col("masked"), F.col("items")), 256).alias("restored"))


# what a model may do to a masked text: leave the first token out, write it twice, write another one, change its checksum,
# break it, turn all words round, nothing
_FAULTED = """SELECT *, CASE seg_id % 7 WHEN 1 THEN replace(masked, coalesce(items[1], ''), '') WHEN 2 THEN masked || coalesce(items[1], '') WHEN 3 THEN masked || '__TLM_CODE_9999_00__' WHEN 4 THEN replace(masked, right(coalesce(items[1], ''), 4), '0G__')
    WHEN 5 THEN replace(masked, coalesce(items[1], ''), rtrim(coalesce(items[1], ''), '_')) WHEN 6 THEN array_to_string(list_reverse(string_split(masked, ' ')), ' ') ELSE masked END AS output FROM m"""
_SEEN = f"regexp_extract_all(output, '{_TOKEN_SQL}')"
_NUMBER_OF = "regexp_extract({}, '__TLM_[A-Z_]+_0*([0-9]+)_', 1)"
_AUDIT = rf"""SELECT seg_id, unnest(list_sort(list_filter([CASE WHEN len(list_filter(items, lambda x: NOT list_contains(seen, x))) > 0 THEN 'MISSING' END, CASE WHEN len(list_filter(items, lambda x: len(list_filter(seen, lambda y: y = x)) > 1)) > 0 THEN 'DUPLICATED' END,
      CASE WHEN len(list_filter(strange, lambda x: list_contains(numbers, {_NUMBER_OF.format('x')}))) > 0 OR len(list_filter(cut, lambda x: {_NUMBER_OF.format('x')} <> '' AND list_contains(numbers, {_NUMBER_OF.format('x')}))) > 0 THEN 'ALTERED' END,
      CASE WHEN len(list_filter(strange, lambda x: NOT list_contains(numbers, {_NUMBER_OF.format('x')}))) > 0 THEN 'UNKNOWN' END, CASE WHEN len(cut) > 0 THEN 'MALFORMED' END,
      CASE WHEN list_sort(known) = list_sort(items) AND known <> items THEN 'REORDERED' END], lambda c: c IS NOT NULL))) AS code
    FROM (SELECT *, list_filter(seen, lambda x: NOT list_contains(items, x)) AS strange, list_filter(seen, lambda x: list_contains(items, x)) AS known, list_transform(items, lambda x: {_NUMBER_OF.format('x')}) AS numbers,
      list_filter(regexp_extract_all(output, '__TLM[A-Za-z0-9_]*'), lambda x: NOT regexp_matches(x, '^{_TOKEN_SQL}')) AS cut FROM (SELECT *, {_SEEN} AS seen FROM ({_FAULTED}) f) g) h"""


@query("p07_placeholder_audit", f"WITH m AS ({_masked('v_segments', 'seg_id')}) {_AUDIT}", "v_segments")
def _(spark, d):
    m = p.mask(v.segments(spark, d).select("seg_id", "text"))
    first, k = F.coalesce(F.get("items", F.lit(0))["placeholder"], F.lit("")), F.col("seg_id") % 7
    swap = lambda old, new: F.when(old == "", F.col("masked")).otherwise(F.replace("masked", old, new))
    text = (
        F.when(k == 1, swap(first, F.lit(""))).when(k == 2, F.concat("masked", first)).when(k == 3, F.concat("masked", F.lit("__TLM_CODE_9999_00__"))).when(k == 4, swap(F.substring(first, -4, 4), F.lit("0G__")))
        .when(k == 5, swap(first, F.rtrim(first, F.lit("_")))).when(k == 6, F.array_join(F.reverse(F.split("masked", " ")), " ")).otherwise(F.col("masked"))
    )
    return m.select("seg_id", F.explode(p.audit(text, F.col("items"))).alias("code"))


@query("p09_inventory_checks", f"SELECT doc_id, count(*) AS n_items, count(*) - count(DISTINCT placeholder) AS n_same_tokens, count(*) - count(DISTINCT number) AS n_same_numbers FROM ({_items('v_segments', 'seg_id')}) i JOIN v_segments s USING (seg_id) WHERE kind <> '' GROUP BY doc_id", "v_segments")
def _(spark, d):
    # segments are numbered each for itself, so that put together a document's numbers come again
    m = p.mask(v.segments(spark, d).select("doc_id", "text")).select("doc_id", F.posexplode("items").alias("i", "x"))
    return m.groupBy("doc_id").agg(F.count("*").alias("n_items"), (F.count("*") - F.count_distinct("x.placeholder")).alias("n_same_tokens"), (F.count("*") - F.count_distinct("i")).alias("n_same_numbers"))


@query("p10_protected_only", rf"SELECT seg_id, NOT regexp_matches(text, '[\pL\pN]') OR regexp_full_match(text, '[^\pL\pN]*({_ACRONYM})[^\pL\pN]*') AS passes FROM v_segments", "v_segments")
def _(spark, d):
    only = F.col("text").rlike(rf"\A[^\p{{L}}\p{{N}}]*(?:{_ACRONYM})[^\p{{L}}\p{{N}}]*\z")
    return v.segments(spark, d).select("seg_id", (p.protected_only(F.col("text")) | only).alias("passes"))


@query("b01_selection", "SELECT seg_id, status FROM v_seg_state WHERE status NOT IN ('LOCKED', 'APPROVED') AND section % 2 = 0 AND (status = 'READY' OR revision = 0)", "v_seg_state")
def _(spark, d):
    s = v.segment_state(spark, d).filter(~F.col("status").isin("LOCKED", "APPROVED") & (F.col("section") % 2 == 0))
    return s.filter((F.col("status") == "READY") | (F.col("revision") == 0)).select("seg_id", "status")


@query("b02_selector_membership", "SELECT l_orderkey + (l_orderkey % 3) AS requested, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey + (l_orderkey % 3)) GROUP BY 1")
def _(spark, d):
    asked = read(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_orderkey") % 3).alias("requested"))
    have = read(spark, d, "orders").select(F.col("o_orderkey").alias("requested"))
    return asked.join(have, "requested", "left_anti").groupBy("requested").agg(F.count("*").alias("n"))


@query("b03_context_window", """SELECT seg_id, sha256(right(coalesce(b, ''), 2000)) AS before_sha256, sha256(left(coalesce(a, ''), 2000)) AS after_sha256 FROM (SELECT seg_id, string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY seg_order ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b,
    string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY seg_order ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM v_segments) q""", "v_segments")
def _(spark, d):
    c = b.context_window(v.segments(spark, d), "doc_id", "seg_order")
    return c.select("seg_id", F.sha2("before", 256).alias("before_sha256"), F.sha2("after", 256).alias("after_sha256"))


_PACK = """WITH RECURSIVE r AS (SELECT doc_id, seg_id, ((strlen(text) + 3) // 4)::BIGINT AS t, row_number() OVER (PARTITION BY doc_id ORDER BY seg_order) AS rn FROM v_segments),
    w AS (SELECT doc_id, seg_id, rn, t, 0::BIGINT AS batch, 1 AS n, t AS total, t > 300 AS alone FROM r WHERE rn = 1
      UNION ALL SELECT r.doc_id, r.seg_id, r.rn, r.t, w.batch + f::INT, CASE WHEN f THEN 1 ELSE w.n + 1 END, CASE WHEN f THEN r.t ELSE w.total + r.t END, r.t > 300
      FROM (SELECT w.*, r.seg_id AS seg2, (r.t > 300 OR w.alone OR w.n >= 20 OR w.total + r.t > 300) AS f FROM w JOIN r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1) w JOIN r ON r.seg_id = w.seg2)"""


def _packed(spark, d, limits=b.BatchLimits(20, 300)):
    s = v.segments(spark, d).select("doc_id", "seg_order", "seg_id", "text")
    return b.greedy_batches(s, ["doc_id"], ["seg_order"], limits)


@query("b04_greedy_batches", f"{_PACK} SELECT doc_id, seg_id, batch FROM w", "v_segments")
def _(spark, d):
    return _packed(spark, d).select("doc_id", "seg_id", "batch")


@query("b05_isolated_batches", f"{_PACK} SELECT doc_id, batch, max(t) > 300 AS oversized, count(*) AS n FROM w GROUP BY doc_id, batch HAVING max(t) > 300", "v_segments")
def _(spark, d):
    return _packed(spark, d).groupBy("doc_id", "batch").agg((F.max("tokens") > 300).alias("oversized"), F.count("*").alias("n")).filter("oversized")


@query("b06_locked_excluded", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM v_seg_state WHERE status <> 'LOCKED'", "v_seg_state")
def _(spark, d):
    return v.segment_state(spark, d).filter("status <> 'LOCKED'").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("b07_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("b08_functional_dependency", """SELECT 'part to supplier' AS rule, l_partkey AS key, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1
    UNION ALL SELECT 'nation to region', n_nationkey, count(DISTINCT n_regionkey) FROM nation GROUP BY 2 HAVING count(DISTINCT n_regionkey) > 1""")
def _(spark, d):
    def broken(df, rule, a, z):
        return df.groupBy(F.col(a).alias("key")).agg(F.count_distinct(z).alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), "key", "n")

    return broken(read(spark, d, "lineitem"), "part to supplier", "l_partkey", "l_suppkey").unionByName(broken(read(spark, d, "nation"), "nation to region", "n_nationkey", "n_regionkey"))


@query("b09_batch_totals", f"{_PACK} SELECT doc_id, batch, sum(t)::BIGINT AS tokens, count(*) AS n_segments, sum(t) > 300 AS over FROM w GROUP BY doc_id, batch", "v_segments")
def _(spark, d):
    return _packed(spark, d).groupBy("doc_id", "batch").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_segments"), (F.sum("tokens") > 300).alias("over"))


@query("b10_request_envelopes", f"""{_PACK} SELECT w.doc_id, batch, '{{"version":1,"segments":[' || string_agg('{{"seg_order":' || seg_order || ',"seg_id":' || seg_id || ',"text":' || to_json(text) || '}}', ',' ORDER BY seg_order, seg_id) || ']}}' AS request
    FROM w JOIN v_segments USING (seg_id) GROUP BY w.doc_id, batch""", "v_segments")  # fmt: skip
def _(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("seg_order", "seg_id", "text")))
    return _packed(spark, d).groupBy("doc_id", "batch").agg(F.to_json(F.struct(F.lit(1).alias("version"), rows.alias("segments"))).alias("request"))


@query("b11_batch_inference", "SELECT seg_id AS pair_id, sha256(replace(text, 'the', 'THE')) AS target_sha256 FROM v_segments", "v_segments")
def _(spark, d):
    s = v.segments(spark, d).select(F.col("seg_id").alias("pair_id"), F.col("text").alias("source"))
    return b.run_model(s, lambda: lambda texts: [x.replace('the', 'THE') for x in texts]).select("pair_id", F.sha2("target", 256).alias("target_sha256"))


# a response a document; by its number it is wrapped, cut short, of another shape, or its items are repeated, lost, unknown or blank
_RAW = """SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN left(body, length(body) - 1) WHEN 3 THEN '{"items": []}' ELSE body END AS raw FROM (SELECT doc_id, '{"segments":[' || string_agg(item, ',' ORDER BY seg_order) || ']}' AS body
    FROM (SELECT doc_id, seg_order, '{"id":' || CASE WHEN doc_id % 9 = 4 AND seg_order > 1 THEN doc_id * 100000 + 1 WHEN doc_id % 9 = 6 THEN seg_id + 50000 ELSE seg_id END || ',"text":"' || CASE WHEN doc_id % 9 = 7 AND length(text) % 5 = 0 THEN '  ' ELSE length(text)::VARCHAR END || '"}' AS item
      FROM v_segments WHERE NOT (doc_id % 9 = 5 AND length(text) % 3 = 0)) i GROUP BY doc_id) b"""
_PARSED = f"""SELECT doc_id, CASE WHEN starts_with(trim(raw), '```') OR ends_with(trim(raw), '```') THEN 'MARKDOWN_WRAPPER' WHEN NOT json_valid(raw) THEN 'INVALID_JSON' WHEN json_extract(raw, '$.segments') IS NULL THEN 'SCHEMA_MISMATCH'
    WHEN len(ids) > len(list_distinct(ids)) THEN 'DUPLICATE_SEGMENT' WHEN len(list_filter(ids, lambda x: NOT list_contains(known, x))) > 0 THEN 'UNKNOWN_SEGMENT_ID' WHEN len(list_filter(known, lambda x: NOT list_contains(ids, x))) > 0 THEN 'MISSING_SEGMENT'
    WHEN len(list_filter(texts, lambda x: trim(x) = '')) > 0 THEN 'EMPTY_TRANSLATION' ELSE 'OK' END AS code FROM (SELECT r.doc_id, raw, known, list_transform(CASE WHEN json_valid(raw) THEN json_extract(raw, '$.segments[*].id') END, lambda x: x::BIGINT) AS ids,
      CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.segments[*].text') END AS texts FROM ({_RAW}) r JOIN (SELECT doc_id, list(seg_id) AS known FROM v_segments GROUP BY 1) k ON k.doc_id = r.doc_id) q"""


@query("b12_parse_responses", _PARSED, "v_segments")
def _(spark, d):
    s, k = v.segments(spark, d), F.col("doc_id") % 9
    key = F.when((k == 4) & (F.col("seg_order") > 1), F.col("doc_id") * 100000 + 1).when(k == 6, F.col("seg_id") + 50000).otherwise(F.col("seg_id"))
    text = F.when((k == 7) & (F.length("text") % 5 == 0), "  ").otherwise(F.length("text").cast("string"))
    item = F.struct("seg_order", F.to_json(F.struct(key.alias("id"), text.alias("text"))).alias("j"))
    body = s.filter(~((k == 5) & (F.length("text") % 3 == 0))).groupBy("doc_id").agg(F.concat(F.lit('{"segments":['), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), ","), F.lit("]}")).alias("body"))
    raw = F.when(k == 1, F.concat(F.lit("```json\n"), "body", F.lit("\n```"))).when(k == 2, F.expr("left(body, length(body) - 1)")).when(k == 3, '{"items": []}').otherwise(F.col("body"))
    responses = body.select("doc_id", raw.alias("raw")).join(s.groupBy("doc_id").agg(F.collect_list("seg_id").alias("known")), "doc_id")
    return responses.select("doc_id", b.response_code(F.col("raw"), F.col("known")).alias("code"))


@query("b13_run_status", """SELECT o_custkey, CASE WHEN g = 0 THEN 'FAILED' WHEN g < n THEN 'PARTIALLY_COMPLETED' WHEN w > 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status
    FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS g, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS w FROM orders GROUP BY 1) q""")
def _(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("g"), F.count_if(F.col("o_orderpriority").like("1%")).alias("w"))
    return g.select("o_custkey", b.final_status(F.col("n"), F.col("g"), F.col("w")).alias("status"))


@query("b14_idempotent_runs", """SELECT event_id, CASE WHEN n = 1 THEN 'NEW' WHEN props = first_props THEN 'REUSE' ELSE 'CONFLICT' END AS outcome FROM (SELECT event_id, props, row_number() OVER w AS n, first_value(props) OVER w AS first_props FROM events
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) q""")
def _(spark, d):
    # of a user's events of one type the first is the run, and each later one asks for it again
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("event_id", "props", F.row_number().over(w).alias("n"), F.first("props").over(w).alias("run"))
    return e.select("event_id", F.when(F.col("n") == 1, "NEW").when(F.col("props") == F.col("run"), "REUSE").otherwise("CONFLICT").alias("outcome"))


@query("b15_retry_plan", """SELECT o_custkey, n, CASE WHEN n < 2 THEN 'SAME' WHEN n < 4 THEN 'SMALLER' WHEN n < 5 THEN 'SINGLE' WHEN n < 6 THEN 'REDUCED_CONTEXT' ELSE 'MANUAL_REVIEW' END AS level
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') < 5) q""")
def _(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).filter("done < 5")
    return g.select("o_custkey", "n", b.retry_level(F.col("n")).alias("level"))


@query("b16_provider_failure", "SELECT event_id, coalesce(max((event_type = 'error' AND value > 90)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS unattempted FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.coalesce(((F.col("event_type") == "error") & (F.col("value") > 90)).cast("int"), F.lit(0))
    return read(spark, d, "events").select("event_id", (F.max(bad).over(w) == 1).alias("unattempted"))


@query("b17_kept_segments", "SELECT pair_id FROM v_pairs WHERE regexp_matches(coalesce(target, ''), '[^\\s]')", "v_pairs")
def _(spark, d):
    bad = qa.issues(v.pairs(spark, d)).filter("code = 'EMPTY_TRANSLATION'").select("pair_id")
    return v.pairs(spark, d).select("pair_id").join(bad, "pair_id", "left_anti")


@query("q01_segment_mapping", "SELECT doc_id, list(seg_id ORDER BY seg_order) <> list(seg_id ORDER BY length(text), seg_order) AS mismatch FROM v_segments GROUP BY doc_id", "v_segments")
def _(spark, d):
    # the answer has a document's segments by length, so its order differs wherever texts don't grow
    order = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "seg_id"))), lambda x: x["seg_id"])
    s = v.segments(spark, d).withColumn("n", F.length("text"))
    return s.groupBy("doc_id").agg((order("seg_order") != order("n", "seg_order")).alias("mismatch"))




def _double(text: str) -> str:
    return f"regexp_replace({text}, '([^{_W}])', '\\1\\1', 'g')"


_EDGE = f"(?:^|[^{_W}])", f"(?:[^{_W}]|$)"
_VERSION = r"(v?\d+(?:\.\.\d+){2,})"
_DATE = r"(\d{1,4}(?:--|//)\d{1,2}(?:--|//)\d{1,4})"
_DECADE = r"(\d{3}0)(?:(?:\x27\x27|’’)?s|(?:--)?an)"
_NUMBER = r"((?:(?:USD|IDR|EUR|GBP|JPY|Rp|\$\$|€€|££|¥¥)\s*)?(?:\+\+|--)?(?:\d{1,3}(?:(?:\.\.|,,)\d{3})+|\d+)(?:(?:\.\.|,,)\d+)?(?:\s*%%)?)"


def _numbers(text: str) -> str:
    """SQL: the sorted versions, dates, decades and numbers of a text. A source and its target spell the same number alike
    here, so the spelling stands for the canonical form."""
    every = lambda x, p: f"regexp_extract_all({x}, '(?i){_EDGE[0]}{p}{_EDGE[1]}', 1)"
    without = lambda x, p: f"regexp_replace({x}, '(?i)({_EDGE[0]}){p}({_EDGE[1]})', ' ', 'g')"
    whole = _double(text)
    left = without(without(whole, _VERSION), _DATE)
    return f"list_sort(list_transform(list_concat({every(whole, _VERSION)}, {every(whole, _DATE)}, {every(left, _DECADE)}, {every(without(left, _DECADE), _NUMBER)}), lambda x: lower(x)))"


@query("q03_number_mismatch", f"SELECT pair_id FROM v_pairs WHERE {_numbers('source')} <> {_numbers('target')}", "v_pairs")
def _(spark, d):
    return v.pairs(spark, d).filter(qa.number_inventory(F.col("source")) != qa.number_inventory(F.col("target"))).select("pair_id")


@query("q04_url_mismatch", """SELECT page_id FROM pages WHERE list_sort(list_transform(regexp_extract_all(html, '(?i)(https?://|www\\.)[^\\s<>"'']+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))
    <> list_sort(list_transform(regexp_extract_all(html || ' ' || url, '(?i)(https?://|www\\.)[^\\s<>"'']+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))""")
def _(spark, d):
    return read(spark, d, "pages").filter(qa.url_inventory(F.col("html")) != qa.url_inventory(F.concat_ws(" ", "html", "url"))).select("page_id")


_SET = r"list_distinct(regexp_extract_all(replace(lower({}), 'n''t', ' not'), '\pL+'))"
_EN = "['" + "','".join(qa.MARKERS["en"]) + "']"
_ID = "['" + "','".join(qa.MARKERS["id"]) + "']"
_NEG = "['" + "','".join(qa.NEGATIONS) + "']"


@query("q07_target_language", f"SELECT doc_id, e >= 2 AND e >= i + 2 AS wrong FROM (SELECT doc_id, len(list_intersect({_SET.format('text')}, {_EN})) AS e, len(list_intersect({_SET.format('text')}, {_ID})) AS i FROM documents) q")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", qa.wrong_language(F.col("text"), "id", "en").alias("wrong"))


@query("q08_untranslated_fragment", f"SELECT pair_id FROM v_pairs WHERE len(list_intersect(list_intersect({_SET.format('source')}, {_SET.format('target')}), {_EN})) > 0", "v_pairs")
def _(spark, d):
    return v.pairs(spark, d).filter(qa.untranslated(F.col("source"), F.col("target"), "en")).select("pair_id")


@query("q09_empty_translation", "SELECT pair_id FROM v_pairs WHERE trim(target) = ''", "v_pairs")
def _(spark, d):
    return qa.issues(v.pairs(spark, d)).filter("code = 'EMPTY_TRANSLATION'").select("pair_id")


@query("q10_suspicious_length", r"SELECT pair_id, round(t::DOUBLE / s, 6) AS ratio FROM (SELECT pair_id, length(regexp_replace(source, '\s+', '', 'g')) AS s, length(regexp_replace(target, '\s+', '', 'g')) AS t FROM v_pairs) q WHERE s > 0 AND (t::DOUBLE / s < 0.5 OR t::DOUBLE / s > 2)", "v_pairs")
def _(spark, d):
    s, g = F.col("source"), F.col("target")
    return v.pairs(spark, d).filter(qa.suspicious_length(s, g)).select("pair_id", F.round(qa.length_ratio(s, g), 6).alias("ratio"))


@query("q11_negation_mismatch", f"SELECT pair_id FROM v_pairs WHERE (len(list_intersect({_SET.format('source')}, {_NEG})) > 0) <> (len(list_intersect({_SET.format('target')}, {_NEG})) > 0)", "v_pairs")
def _(spark, d):
    return v.pairs(spark, d).filter(qa.negated(F.col("source")) != qa.negated(F.col("target"))).select("pair_id")




def _sorted_lists(text: str, patterns: list[str], *more: str) -> str:
    return "list_sort(list_concat(" + ", ".join([f"regexp_extract_all({text}, '{x}')" for x in patterns] + [*more]) + "))"


def _urls(text: str) -> str:
    return rf"list_sort(list_transform(regexp_extract_all({text}, '{_OTHERS['URL'][0]}'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))"


def _cited(text: str) -> str:
    return _sorted_lists(text, [*_OTHERS["CITATION"], r"(?i)\b(?:fig(?:ure)?|table|eq(?:uation)?)\.?\s+\d+(?:\.\d+)*\b"])


def _coded(text: str) -> str:
    bare = f"regexp_replace({text}, '{_OTHERS['URL'][0]}', ' ', 'g')"
    return _sorted_lists(bare, [x for k in ("CODE", "ENDPOINT", "FILE_PATH") for x in _OTHERS[k]], f"regexp_extract_all({_double(bare)}, '{_NAMES}', 1)")


_CHARS = r"length(regexp_replace({}, '\s+', '', 'g'))"
_ISSUES = f"""SELECT pair_id, code, CASE WHEN code IN ('TARGET_LANGUAGE_MISMATCH', 'UNTRANSLATED_SOURCE_FRAGMENT', 'SUSPICIOUS_LENGTH', 'NEGATION_MISMATCH') THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM (SELECT pair_id, unnest(list_filter([
      CASE WHEN regexp_extract_all(s, '{_TOKEN_SQL}') <> regexp_extract_all(g, '{_TOKEN_SQL}') THEN 'PLACEHOLDER_MISMATCH' END, CASE WHEN {_numbers('s')} <> {_numbers('g')} THEN 'NUMBER_MISMATCH' END,
      CASE WHEN {_urls('s')} <> {_urls('g')} THEN 'URL_MISMATCH' END, CASE WHEN {_coded('s')} <> {_coded('g')} THEN 'CODE_MISMATCH' END, CASE WHEN {_cited('s')} <> {_cited('g')} THEN 'CITATION_MISMATCH' END,
      CASE WHEN NOT regexp_matches(g, '[^\\s]') THEN 'EMPTY_TRANSLATION' END, CASE WHEN e >= 2 AND e >= i + 2 THEN 'TARGET_LANGUAGE_MISMATCH' END, CASE WHEN len(list_intersect(list_intersect({_SET.format('s')}, {_SET.format('g')}), {_EN})) > 0 THEN 'UNTRANSLATED_SOURCE_FRAGMENT' END,
      CASE WHEN {_CHARS.format('s')} > 0 AND NOT ({_CHARS.format('g')}::DOUBLE / {_CHARS.format('s')} BETWEEN 0.5 AND 2) THEN 'SUSPICIOUS_LENGTH' END, CASE WHEN (len(list_intersect({_SET.format('s')}, {_NEG})) > 0) <> (len(list_intersect({_SET.format('g')}, {_NEG})) > 0) THEN 'NEGATION_MISMATCH' END],
      lambda c: c IS NOT NULL)) AS code FROM (SELECT *, len(list_intersect({_SET.format('g')}, {_EN})) AS e, len(list_intersect({_SET.format('g')}, {_ID})) AS i FROM (SELECT pair_id, coalesce(source, '') AS s, coalesce(target, '') AS g FROM v_pairs) x) y) z"""


@query("q12_all_issues", _ISSUES, "v_pairs")
def _(spark, d):
    return qa.issues(v.pairs(spark, d))


@query("q13_report_by_code", f"SELECT severity, code, count(*) AS n, count(DISTINCT pair_id) AS n_pairs FROM ({_ISSUES}) i GROUP BY ROLLUP (severity, code)", "v_pairs")
def _(spark, d):
    return qa.issues(v.pairs(spark, d)).rollup("severity", "code").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("n_pairs"))


@query("q14_grouped_issues", f"SELECT pair_id, max(CASE WHEN severity = 'CRITICAL' THEN 2 ELSE 1 END) AS highest, '[' || string_agg(DISTINCT '\"' || code || '\"', ',' ORDER BY '\"' || code || '\"') || ']' AS codes FROM ({_ISSUES}) i GROUP BY pair_id", "v_pairs")
def _(spark, d):
    rank = F.when(F.col("severity") == "CRITICAL", 2).otherwise(1)
    return qa.issues(v.pairs(spark, d)).groupBy("pair_id").agg(F.max(rank).alias("highest"), F.to_json(F.array_sort(F.collect_set("code"))).alias("codes"))


@query("q16_cell_integrity", """SELECT l_orderkey, bool_and(round(l_discount * 100)::INT % 10 = 0 AND round(l_tax * 100)::INT % 10 = 0) AS intact FROM lineitem GROUP BY 1""")
def _(spark, d):
    # one table has two decimals and grouped thousands, the other one decimal: cells agree where nothing was lost
    cell = lambda c, form: t.numeric_signature(F.format_string(form, c))
    both = [cell(c, "%.2f") == cell(c, "%.1f") for c in ("l_discount", "l_tax")]
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and((cell("l_extendedprice", "%,.2f") == cell("l_extendedprice", "%.2f")) & both[0] & both[1]).alias("intact"))


@query("q17_rectangular_table", "SELECT l_orderkey, max(l_linenumber)::BIGINT AS width, max(l_linenumber) - count(DISTINCT l_linenumber) AS n_filled FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"), F.collect_set("l_linenumber").alias("have"))
    grid = F.sequence(F.lit(1), F.col("m"))
    return rows.select("l_orderkey", F.col("m").cast("long").alias("width"), F.size(F.array_except(grid, "have")).cast("long").alias("n_filled"))
