"""Text column operators over documents, events, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import text as t
from textloom.plans.base import query
from textloom.sources import views as v
from textloom.sources.tables import read

_LIST = r"(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][.)]\s+)"
_LIG = "text"
for _one, _many in t.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_one}', '{_many}')"


@query("s01_normalize_lines", rf"""SELECT doc_id, sha256(n) AS norm_sha256, length(n)::BIGINT AS n_norm FROM (SELECT doc_id, replace(trim(regexp_replace(
    regexp_replace(regexp_replace(replace({_LIG}, chr(173), ''), '(\pL)-[ \t]*\n\s*(\p{{Ll}})', '\1\2', 'g'), '\s*\n({_LIST})', chr(1) || '\1', 'g'), '\s+', ' ', 'g')), chr(1), chr(10)) AS n FROM documents) q""")
def _(spark, d):
    n = t.normalize_lines(F.col("text"))
    return read(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.sha2("n", 256).alias("norm_sha256"), F.length("n").cast("long").alias("n_norm"))


@query("s02_normalization_ledger", rf"""SELECT doc_id, kind, count(*) AS n_changes FROM (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[ﬀ-ﬆ]'), lambda x: 'LIGATURE')) AS kind FROM documents
    UNION ALL SELECT doc_id, unnest(list_transform(regexp_extract_all(text, chr(173)), lambda x: 'SOFT_HYPHEN')) FROM documents
    UNION ALL SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[ \t\r\f]{{2,}}|[\t\r\f]'), lambda x: 'WHITESPACE')) FROM documents
    UNION ALL SELECT doc_id, CASE WHEN regexp_matches(p, '\pL-[ \t]*$') AND regexp_matches(n, '^\s*\p{{Ll}}') THEN 'HYPHENATED_LINE_BREAK'
        WHEN regexp_matches(n || chr(10) || coalesce(r, 'x'), '^{_LIST}') THEN 'PRESERVED_LINE_BREAK' ELSE 'VISUAL_LINE_BREAK' END
      FROM (SELECT doc_id, s[i] AS p, s[i + 1] AS n, s[i + 2] AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) x, unnest(range(1, len(s))) u(i)) y) z GROUP BY ALL""")
def _(spark, d):
    return t.normalization_ledger(read(spark, d, "documents")).groupBy("doc_id", "kind").agg(F.count("*").alias("n_changes"))


@query("s03_clean_lines", r"""SELECT doc_id, sha256(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)),
    '(\pL)-\n(\p{Ll})', '\1\2', 'g')) AS clean_sha256 FROM documents""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(t.clean_lines(F.col("text")), 256).alias("clean_sha256"))


@query("s04_term_key", r"SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS key_sha256 FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(t.term_key(F.col("text")), 256).alias("key_sha256"))


@query("s05_segment_ids", """SELECT seg_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT seg_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('segment:' || seg_id::VARCHAR)) AS h FROM v_segments) q""", "v_segments")
def _(spark, d):
    return v.segments(spark, d).select("seg_id", t.uuid5(F.concat(F.lit("segment:"), F.col("seg_id").cast("string"))).alias("uuid"))


@query("s06_fingerprint", "SELECT doc_id, sha256(lang || chr(1) || source || chr(1) || text) AS print FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", t.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("print"))


@query("s07_token_estimate", """SELECT 'documents' AS kind, doc_id AS id, ((strlen(text) + 3) // 4)::BIGINT AS tokens FROM documents
    UNION ALL SELECT 'conversations', conv_id * 1000 + turn, ((strlen(text) + 3) // 4)::BIGINT FROM conversations""")
def _(spark, d):
    n = t.estimate_tokens(F.col("text")).alias("tokens")
    docs = read(spark, d, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), n)
    return docs.unionByName(read(spark, d, "conversations").select(F.lit("conversations").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), n))


@query("s08_content_length", r"SELECT pair_id, length(regexp_replace(target, '\s+', '', 'g'))::BIGINT AS n_content, trim(coalesce(target, '')) = '' AS blank FROM v_pairs", "v_pairs")
def _(spark, d):
    return v.pairs(spark, d).select("pair_id", t.content_length(F.col("target")).alias("n_content"), (F.trim(F.coalesce("target", F.lit(""))) == "").alias("blank"))


@query("s09_word_set", r"SELECT doc_id, len(list_distinct(regexp_extract_all(replace(lower(text), 'n''t', ' not'), '\pL+')))::BIGINT AS n_distinct FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(t.words(F.col("text"))).cast("long").alias("n_distinct"))


_CANON = """CASE WHEN contains(b, '.') AND contains(b, ',') OR (NOT regexp_full_match(b, '[^.,]*([.,]\\d{3})+') AND regexp_full_match(b, '\\d+[.,]\\d*'))
    THEN regexp_replace(regexp_extract(b, '^(.*)[.,][^.,]*$', 1), '[.,]', '', 'g') || CASE WHEN regexp_replace(regexp_extract(b, '[.,]([^.,]*)$', 1), '0+$', '') = '' THEN '' ELSE '.' || regexp_replace(regexp_extract(b, '[.,]([^.,]*)$', 1), '0+$', '') END
    WHEN regexp_full_match(b, '[^.,]*([.,]\\d{3})+') THEN regexp_replace(b, '[.,]', '', 'g') ELSE b END"""


@query("s10_canonical_numbers", rf"""SELECT doc_id, number, canonical, count(*) AS n FROM (SELECT doc_id, number, s || {_CANON} AS canonical FROM (SELECT doc_id, number, regexp_extract(number, '^[+-]?') AS s, regexp_replace(number, '^[+-]', '') AS b
    FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[^\s]+'), lambda x: regexp_full_match(x, '[+-]?(\d{{1,3}}([.,]\d{{3}})+|\d+)([.,]\d+)?'))) AS number FROM documents) x) y) z GROUP BY ALL""")
def _(spark, d):
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)), lambda x: x.rlike(r"^[+-]?(\d{1,3}([.,]\d{3})+|\d+)([.,]\d+)?$"))
    n = read(spark, d, "documents").select("doc_id", F.explode(tokens).alias("number"))
    return n.withColumn("canonical", t.canonical_number(F.col("number"))).groupBy("doc_id", "number", "canonical").agg(F.count("*").alias("n"))


@query("s11_numeric_signature", """SELECT l_orderkey, idx, regexp_replace(regexp_replace(printf('%.2f', l_extendedprice), '0+$', ''), '[.]$', '') AS price_signature FROM v_line""", "v_line")
def _(spark, d):
    cell = F.format_string("%.2f", F.col("l_extendedprice"))
    return v.lines(spark, d).select("l_orderkey", "idx", F.get(t.numeric_signature(cell), F.lit(0)).alias("price_signature"))


@query("s12_json_path_filter", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events WHERE (json_extract_string(props, '$.k'))::BIGINT = 7")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").filter(k == 7).select("event_id", k.alias("k"))


@query("s13_tolerant_json", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE coalesce((json_extract_string(props, '$.k'))::BIGINT, -1) END AS k FROM events""")
def _(spark, d):
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{oops"), F.col("props"))).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", F.coalesce(F.from_json(broken, "k long")["k"], F.lit(-1).cast("long")).alias("k"))


@query("s14_status_vocabulary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'UNKNOWN' END AS status FROM orders")
def _(spark, d):
    known = F.create_map(F.lit("F"), F.lit("COMPLETED"), F.lit("O"), F.lit("RUNNING"))
    return read(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(known, F.col("o_orderstatus")), F.lit("UNKNOWN")).alias("status"))


@query("s15_semantic_role", """SELECT page, idx, CASE kind WHEN 'TEXT' THEN 'BODY' WHEN 'IMAGE' THEN 'FIGURE' WHEN 'TABLE' THEN 'DATA' ELSE 'OTHER' END AS role FROM v_boxes""", "v_boxes")
def _(spark, d):
    roles = F.create_map(*map(F.lit, ("TEXT", "BODY", "IMAGE", "FIGURE", "TABLE", "DATA")))
    return v.boxes(spark, d).select("page", "idx", F.coalesce(F.try_element_at(roles, F.col("kind")), F.lit("OTHER")).alias("role"))


_URLS = """SELECT page_id, CASE page_id % 5 WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN regexp_replace(url, '^[a-z]+:', '') WHEN 3 THEN url || ' x' WHEN 4 THEN 'mailto:' || page_id::VARCHAR ELSE url END AS u FROM pages"""


@query("s16_link_state", rf"""SELECT page_id, CASE code WHEN 'OK' THEN 'PRESERVED' WHEN 'SCHEME' THEN 'DISABLED' ELSE 'BROKEN' END AS state, code FROM (SELECT page_id, CASE WHEN trim(u) = '' THEN 'EMPTY' WHEN regexp_matches(u, '[\x00-\x20\x7f]') THEN 'UNSAFE_CHARACTER'
    WHEN s = '' THEN 'NO_SCHEME' WHEN s NOT IN ('http', 'https', 'mailto') THEN 'SCHEME' WHEN s = 'mailto' AND NOT contains(u, '@') THEN 'NO_ADDRESS' WHEN s <> 'mailto' AND h = '' THEN 'NO_HOST' ELSE 'OK' END AS code
    FROM (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2) AS h FROM ({_URLS}) a) b) c""")
def _(spark, d):
    u, k = F.col("url"), F.col("page_id") % 5
    faulty = F.when(k == 1, F.replace(u, F.lit("http"), F.lit("ftp"))).when(k == 2, F.regexp_replace(u, "^[a-z]+:", "")).when(k == 3, F.concat(u, F.lit(" x"))).when(k == 4, F.concat(F.lit("mailto:"), F.col("page_id").cast("string"))).otherwise(u)
    return read(spark, d, "pages").select("page_id", t.link_state(faulty).alias("l")).select("page_id", "l.state", "l.code")


@query("s17_enforced_text", "SELECT rule_id, CASE rule_type WHEN 'KEEP_SOURCE' THEN term WHEN 'PREFERRED' THEN target END AS enforced FROM v_rules", "v_rules")
def _(spark, d):
    return v.rules(spark, d).select("rule_id", t.enforced_text(F.col("rule_type"), F.col("term"), F.col("target")).alias("enforced"))


@query("s18_box_algebra", """SELECT a.page, a.idx, a.x + a.w AS right_edge, a.y + a.h AS bottom, a.w * a.h AS area, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) AS x_overlap,
    greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared FROM v_boxes a JOIN v_boxes b ON b.page = a.page AND b.idx = a.idx + 1""", "v_boxes")
def _(spark, d):
    b = v.boxes(spark, d)
    p, q = b.alias("p"), b.alias("q")
    return p.join(q, (F.col("p.page") == F.col("q.page")) & (F.col("q.idx") == F.col("p.idx") + 1)).select(
        F.col("p.page").alias("page"), F.col("p.idx").alias("idx"), (F.col("p.x") + F.col("p.w")).alias("right_edge"), (F.col("p.y") + F.col("p.h")).alias("bottom"), (F.col("p.w") * F.col("p.h")).alias("area"),
        t.overlap_1d(F.col("p.x"), F.col("p.w"), F.col("q.x"), F.col("q.w")).alias("x_overlap"), t.intersection_area("p", "q").alias("shared"),
    )


@query("s19_bounded_percent", """SELECT source, printf('%.1f%%', 100 * least(1.0, greatest(0.0, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::DOUBLE / count(*)))) AS english FROM documents GROUP BY source""")
def _(spark, d):
    g = read(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("part"), F.count("*").alias("whole"))
    return g.select("source", t.percent(F.col("part"), F.col("whole")).alias("english"))
