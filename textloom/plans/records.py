"""Quality reports, review queries, integrity audits and benchmark roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import records as r
from textloom.operators import text as t
from textloom.plans.base import query
from textloom.sources import files
from textloom.sources import views as v
from textloom.sources.tables import read


@query("a01_segments_with_documents", "SELECT s.seg_id, d.n_chars, s.status FROM v_seg_state s JOIN documents d ON d.doc_id = s.doc_id", "v_seg_state")
def _(spark, d):
    return v.segment_state(spark, d).join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("seg_id", "n_chars", "status")


# fields in the order of the record; a null one is left out
_JSON = """'{' || concat_ws(',', '"doc_id":' || doc_id, '"lang":' || CASE WHEN lang IS NOT NULL THEN to_json(lang) END, '"n_chars":' || n_chars,
    '"source":' || CASE WHEN source IS NOT NULL THEN to_json(source) END, '"text":' || CASE WHEN text IS NOT NULL THEN to_json(text) END) || '}'"""


@query("a02_document_json", f"SELECT doc_id, sha256(json) AS checksum, json FROM (SELECT doc_id, {_JSON} AS json FROM documents) q")
def _(spark, d):
    j = F.to_json(F.struct("doc_id", "lang", "n_chars", "source", "text"))
    return read(spark, d, "documents").select("doc_id", F.sha2(j, 256).alias("checksum"), j.alias("json"))


@query("a03_verified_json", "SELECT doc_id, lang, true AS verified FROM documents")
def _(spark, d):
    j = F.to_json(F.struct("doc_id", "lang", "n_chars", "source", "text"))
    kept = read(spark, d, "documents").select("doc_id", j.alias("json"), F.sha2(j, 256).alias("checksum"))
    back = kept.withColumn("x", F.from_json("json", "doc_id long, lang string, n_chars long, source string, text string"))
    same = (F.col("x.doc_id") == F.col("doc_id")) & (F.sha2("json", 256) == F.col("checksum"))
    return back.select("doc_id", "x.lang", same.alias("verified"))


@query("a05_evaluation_cases", "SELECT item_id, ['short', 'medium', 'long'][least(2, len(string_split(text, ' ')) // 20) + 1] AS category, count(*) OVER () AS n_cases FROM benchmark")
def _(spark, d):
    b = read(spark, d, "benchmark")
    n = b.agg(F.count("*").alias("n_cases"), F.lit(0).alias("zero"))  # one row
    return b.select("item_id", v.pick(("short", "medium", "long"), F.least(F.lit(2), F.floor(F.size(F.split("text", " ")) / 20))).alias("category")).join(F.broadcast(n), F.col("item_id") >= F.col("zero")).drop("zero")


@query("a07_file_catalogue")
def _(spark, d):
    return files.digests(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


@query("w01_confidence_warnings", """SELECT doc_id, code FROM (SELECT doc_id, CASE WHEN (doc_id % 7) / 7.0 < 0.5 THEN 'CRITICAL_CONFIDENCE' WHEN (doc_id % 7) / 7.0 < 0.75 THEN 'LOW_CONFIDENCE' END AS code FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 10 >= 8 THEN 'TEXT_IN_IMAGE' END FROM documents) q WHERE code IS NOT NULL""")
def _(spark, d):
    c = (F.col("doc_id") % 7) / 7.0
    codes = F.array_compact(F.array(F.when(c < 0.5, "CRITICAL_CONFIDENCE").when(c < 0.75, "LOW_CONFIDENCE"), F.when(F.col("doc_id") % 10 >= 8, F.lit("TEXT_IN_IMAGE"))))
    return read(spark, d, "documents").select("doc_id", F.explode(codes).alias("code"))


@query("w02_severity_counts", "SELECT severity, count(*) AS n, count(*) FILTER (WHERE status = 'OPEN') AS n_open FROM v_warn GROUP BY 1 UNION ALL SELECT 'BLOCKER', 0, 0", "v_warn")
def _(spark, d):
    every = spark.createDataFrame([(s,) for s in (*v.SEVERITIES, "BLOCKER")], "severity string")
    n = v.warnings(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OPEN").alias("n_open"))
    return every.join(n, "severity", "left").na.fill(0)


_STATUS = "CASE WHEN bool_or(status = 'OPEN' AND severity = 'CRITICAL') THEN 'BLOCKED' WHEN bool_or(status = 'OPEN') THEN 'PASSED_WITH_WARNINGS' ELSE 'PASSED' END"


@query("w03_effective_status", f"SELECT scope_id, {_STATUS} AS report FROM v_warn GROUP BY 1", "v_warn")
def _(spark, d):
    open_ = F.col("status") == "OPEN"
    s = F.when(F.bool_or(open_ & (F.col("severity") == "CRITICAL")), "BLOCKED").when(F.bool_or(open_), "PASSED_WITH_WARNINGS").otherwise("PASSED")
    return v.warnings(spark, d).groupBy("scope_id").agg(s.alias("report"))


@query("w04_blocked_scopes", "SELECT DISTINCT scope_id FROM v_warn w WHERE EXISTS (SELECT 1 FROM v_warn x WHERE x.scope_id = w.scope_id AND x.status = 'OPEN' AND x.severity = 'CRITICAL')", "v_warn")
def _(spark, d):
    w = v.warnings(spark, d)
    return w.select("scope_id").distinct().join(w.filter("status = 'OPEN' AND severity = 'CRITICAL'"), "scope_id", "left_semi")


@query("w05_resolution", """SELECT e.event_id AS warning_id, CASE WHEN w.warning_id IS NULL THEN 'NOT_FOUND' WHEN w.status <> 'OPEN' THEN 'ALREADY_RESOLVED' WHEN w.severity = 'CRITICAL' AND w.kind = 'NUMBER_MISMATCH' THEN 'POLICY' ELSE 'APPLIED' END AS outcome
    FROM events e LEFT JOIN v_warn w ON w.warning_id = e.event_id""", "v_warn")
def _(spark, d):
    asked = read(spark, d, "events").select(F.col("event_id").alias("warning_id"))
    j = asked.join(v.warnings(spark, d), "warning_id", "left")
    o = F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status") != "OPEN", "ALREADY_RESOLVED").when((F.col("severity") == "CRITICAL") & (F.col("kind") == "NUMBER_MISMATCH"), "POLICY").otherwise("APPLIED")
    return j.select("warning_id", o.alias("outcome"))


@query("w06_warning_listing", "SELECT warning_id, severity FROM v_warn WHERE status = 'OPEN' AND kind = 'OVERFLOW' ORDER BY ts DESC, warning_id DESC LIMIT 21", "v_warn")
def _(spark, d):
    w = v.warnings(spark, d).filter("status = 'OPEN' AND kind = 'OVERFLOW'")
    return r.keyset_page(w, [("ts", True), ("warning_id", True)], None, 21).select("warning_id", "severity")


@query("w07_completeness", "SELECT s.seg_id FROM v_segments s JOIN documents d ON d.doc_id = s.doc_id WHERE NOT contains(CASE WHEN d.doc_id % 9 = 0 THEN left(d.text, length(d.text) // 2) ELSE d.text END, s.text)", "v_segments")
def _(spark, d):
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    out = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, half).otherwise(F.col("text")).alias("output"))
    return v.segments(spark, d).join(out, "doc_id").filter(~F.col("output").contains(F.col("text"))).select("seg_id")


@query("w09_active_content", r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<script')) AS n_scripts, len(regexp_extract_all(html, '(?i)<(object|embed|iframe)')) AS n_embeds, len(regexp_extract_all(html, '(?i)\son[a-z]+\s*=')) AS n_handlers FROM pages""")
def _(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return read(spark, d, "pages").select("page_id", n("(?i)<script").alias("n_scripts"), n("(?i)<(?:object|embed|iframe)").alias("n_embeds"), n(r"(?i)\son[a-z]+\s*=").alias("n_handlers"))


@query("r01_review_queue", """SELECT s.seg_id, s.status, w.severity FROM v_seg_state s LEFT JOIN (SELECT scope_id, max(severity) AS severity FROM v_warn WHERE status = 'OPEN' GROUP BY 1) w ON w.scope_id = s.doc_id WHERE s.status IN ('NEEDS_REVIEW', 'TRANSLATION_FAILED') AND s.lang = 'en'""", "v_seg_state", "v_warn")
def _(spark, d):
    w = v.warnings(spark, d).filter("status = 'OPEN'").groupBy(F.col("scope_id").alias("doc_id")).agg(F.max("severity").alias("severity"))
    s = v.segment_state(spark, d).filter("status IN ('NEEDS_REVIEW', 'TRANSLATION_FAILED') AND lang = 'en'")
    return s.join(w, "doc_id", "left").select("seg_id", "status", "severity")


@query("r02_neighbours", "SELECT conv_id, turn, sha256(coalesce(lag(text) OVER w, '')) AS previous, sha256(coalesce(lead(text) OVER w, '')) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return read(spark, d, "conversations").select("conv_id", "turn", text(F.lag("text").over(w)).alias("previous"), text(F.lead("text").over(w)).alias("next"))


@query("r03_offset_page", "SELECT seg_id FROM v_segments ORDER BY seg_id OFFSET 40 LIMIT 21", "v_segments")
def _(spark, d):
    return v.segments(spark, d).select("seg_id").orderBy("seg_id").offset(40).limit(21)


@query("r04_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def _(spark, d):
    return r.keyset_page(read(spark, d, "orders").filter("o_totalprice < 250000"), [("o_totalprice", True), ("o_orderkey", True)], None, 50).select("o_orderkey", "o_totalprice")


@query("r05_status_summary", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 0) AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS progress FROM orders GROUP BY 1")
def _(spark, d):
    s = F.col("o_orderstatus")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if((s == "F") & (F.col("o_totalprice") > 0)).alias("completed"), F.count_if(s == "P").alias("failed"), F.round(F.count_if(s == "F") / F.count("*"), 6).alias("progress"))


@query("r06_countable_segments", "SELECT doc_id, count(*) FILTER (WHERE status <> 'LOCKED') AS countable, count(*) FILTER (WHERE status = 'TRANSLATION_FAILED') AS unresolved FROM v_seg_state GROUP BY 1", "v_seg_state")
def _(spark, d):
    s = F.col("status")
    return v.segment_state(spark, d).groupBy("doc_id").agg(F.count_if(s != "LOCKED").alias("countable"), F.count_if(s == "TRANSLATION_FAILED").alias("unresolved"))


@query("r07_representative_order", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) q WHERE n = 1")
def _(spark, d):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return r.latest(read(spark, d, "orders"), ["o_custkey"], rank.asc(), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("r08_active_jobs", "SELECT DISTINCT job_id FROM v_jobs WHERE status = 'RUNNING' AND json_extract_string(payload, '$.k')::BIGINT > 90", "v_jobs")
def _(spark, d):
    return v.jobs(spark, d).filter((F.col("status") == "RUNNING") & (F.get_json_object("payload", "$.k").cast("long") > 90)).select("job_id").distinct()


@query("r09_readiness_blockers", """SELECT d.doc_id, concat_ws(',', CASE WHEN s.n > 0 THEN 'UNTRANSLATED' END, CASE WHEN w.n > 0 THEN 'CRITICAL_WARNINGS' END) AS blockers FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_seg_state WHERE status = 'READY' GROUP BY 1) s ON s.doc_id = d.doc_id
    LEFT JOIN (SELECT scope_id, count(*) AS n FROM v_warn WHERE status = 'OPEN' AND severity = 'CRITICAL' GROUP BY 1) w ON w.scope_id = d.doc_id""", "v_seg_state", "v_warn")
def _(spark, d):
    s = v.segment_state(spark, d).filter("status = 'READY'").groupBy("doc_id").agg(F.count("*").alias("s"))
    w = v.warnings(spark, d).filter("status = 'OPEN' AND severity = 'CRITICAL'").groupBy(F.col("scope_id").alias("doc_id")).agg(F.count("*").alias("w"))
    j = read(spark, d, "documents").select("doc_id").join(s, "doc_id", "left").join(w, "doc_id", "left")
    return j.select("doc_id", F.concat_ws(",", F.when(F.col("s") > 0, "UNTRANSLATED"), F.when(F.col("w") > 0, "CRITICAL_WARNINGS")).alias("blockers"))


@query("r10_reconstruction_totals", "SELECT l_orderkey, sum(l_linenumber)::BIGINT AS pages, count(*) FILTER (WHERE l_returnflag = 'R') AS n_critical, coalesce(sum(l_quantity), 0) AS total FROM lineitem GROUP BY 1")
def _(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("pages"), F.count_if(F.col("l_returnflag") == "R").alias("n_critical"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("total"))


@query("r12_latest_revision", "SELECT l_orderkey, max(idx) AS revision, arg_max(l_partkey, idx) AS part FROM v_line GROUP BY 1", "v_line")
def _(spark, d):
    return v.lines(spark, d).groupBy("l_orderkey").agg(F.max("idx").alias("revision"), F.max_by("l_partkey", "idx").alias("part"))


@query("r13_optional_exports", "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0)


@query("r15_contiguous_attempts", "SELECT l_orderkey FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) q GROUP BY 1 HAVING bool_or(n <> l_linenumber)")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return read(spark, d, "lineitem").select("l_orderkey", (n != F.col("l_linenumber")).alias("off")).groupBy("l_orderkey").agg(F.bool_or("off").alias("off")).filter("off").select("l_orderkey")


@query("r16_reusable_outputs", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents")
def _(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return x.join(x.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").select("doc_id", "first_id")


@query("r17_bulk_outcomes", """SELECT q.seg_id, CASE WHEN s.seg_id IS NULL THEN 'NOT_FOUND' WHEN s.revision <> q.expected THEN 'CONFLICT' WHEN s.status = 'LOCKED' THEN 'LOCKED' ELSE 'APPLIED' END AS outcome
    FROM (SELECT CASE WHEN seg_id % 10 = 0 THEN -seg_id ELSE seg_id END AS seg_id, CASE WHEN seg_id % 3 = 0 THEN 9 ELSE seg_id % 4 END AS expected FROM v_segments) q LEFT JOIN v_seg_state s ON s.seg_id = q.seg_id""", "v_segments", "v_seg_state")
def _(spark, d):
    k = F.col("seg_id")
    asked = v.segments(spark, d).select(F.when(k % 10 == 0, -k).otherwise(k).alias("seg_id"), F.when(k % 3 == 0, 9).otherwise(k % 4).alias("expected"))
    return r.apply_requests(v.segment_state(spark, d), asked, "seg_id")


@query("r18_state_machine", """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'lock' WHEN 'signup' THEN 'unlock' ELSE 'none' END AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 'NEW' AS state, 0::BIGINT AS revision FROM e UNION ALL SELECT user_id, rn, t, revision + (t <> state)::INT FROM (SELECT w.user_id, e.rn, w.state, w.revision,
      CASE WHEN w.state <> 'LOCKED' AND a = 'edit' THEN 'EDITED' WHEN w.state <> 'LOCKED' AND a = 'approve' THEN 'APPROVED' WHEN a = 'lock' THEN 'LOCKED' WHEN w.state = 'LOCKED' AND a = 'unlock' THEN 'EDITED' ELSE w.state END AS t FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1) q)
    SELECT user_id, arg_max(state, rn) AS state, arg_max(revision, rn) AS revision FROM w GROUP BY 1""")
def _(spark, d):
    acts = F.create_map(*map(F.lit, ("click", "edit", "purchase", "approve", "error", "lock", "signup", "unlock")))
    log = read(spark, d, "events").select("user_id", "ts", "event_id", F.coalesce(F.try_element_at(acts, F.col("event_type")), F.lit("none")).alias("act"))
    return r.fold_changes(log, "user_id", ["ts", "event_id"], "act")


@query("r19_as_of_revision", "SELECT l_orderkey, arg_max(l_partkey, idx) FILTER (WHERE idx <= 2) AS part FROM v_line GROUP BY 1", "v_line")
def _(spark, d):
    return v.lines(spark, d).filter("idx <= 2").groupBy("l_orderkey").agg(F.max_by("l_partkey", "idx").alias("part"))


_COPY = "SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 1000000 ELSE 0 END AS doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents"


def _copy(spark, d):
    k = F.col("doc_id")
    return read(spark, d, "documents").select((k + F.when(k % 50 == 0, 1000000).otherwise(0)).alias("doc_id"), F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))


_VERIFY = f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'MISSING' WHEN a.doc_id IS NULL THEN 'EXTRA' WHEN a.h = b.h THEN 'SAME' ELSE 'CHANGED' END AS outcome FROM (SELECT doc_id, sha256(text) AS h FROM documents) a FULL JOIN ({_COPY}) b ON b.doc_id = a.doc_id"


def _verified(spark, d):
    return r.compare_catalogues(read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), _copy(spark, d), "doc_id", "h")


@query("r20_catalogue_sync", f"SELECT doc_id, CASE outcome WHEN 'MISSING' THEN 'DEACTIVATE' WHEN 'EXTRA' THEN 'INSERT' ELSE 'REFRESH' END AS action FROM ({_VERIFY}) x")
def _(spark, d):
    return _verified(spark, d).select("doc_id", F.when(F.col("outcome") == "MISSING", "DEACTIVATE").when(F.col("outcome") == "EXTRA", "INSERT").otherwise("REFRESH").alias("action"))


@query("k09_manifest_verify", _VERIFY)
def _(spark, d):
    return _verified(spark, d)


@query("r21_reassembled_text", "SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY seg_order)) AS text_sha256, bool_or(seg_id % 11 = 0) AS incomplete FROM v_segments GROUP BY 1", "v_segments")
def _(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("seg_order", "text")))
    return v.segments(spark, d).groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["text"]), "\n"), 256).alias("text_sha256"), F.bool_or(F.col("seg_id") % 11 == 0).alias("incomplete"))


@query("k01_global_ids", "SELECT id, count(*) AS n FROM (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT c_custkey FROM customer) q GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    ids = [read(spark, d, n).select(F.col(c).alias("id")) for n, c in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"))]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


@query("k02_references", """SELECT 'line to order' AS rule, l_orderkey AS value, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 101 <> 7) GROUP BY 2
    UNION ALL SELECT 'label to document', doc_id, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 5) GROUP BY 2
    UNION ALL SELECT 'event to customer', user_id, count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 3) GROUP BY 2""")
def _(spark, d):
    # the supplied tables are sound: some orders, documents and customers are taken for lost
    t_ = lambda n: read(spark, d, n)
    out = r.missing_references(t_("lineitem"), "l_orderkey", t_("orders").filter("o_orderkey % 101 <> 7"), "o_orderkey", "line to order")
    out = out.unionByName(r.missing_references(t_("labels"), "doc_id", t_("documents").filter("doc_id % 13 <> 5"), "doc_id", "label to document"))
    return out.unionByName(r.missing_references(t_("events"), "user_id", t_("customer").filter("c_custkey % 17 <> 3"), "c_custkey", "event to customer"))


@query("k03_field_audit", "SELECT o_orderkey FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey WHERE l.first < o.o_orderdate OR o.o_totalprice <= 0")
def _(spark, d):
    first = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    return read(spark, d, "orders").join(first, "o_orderkey", "left").filter("first < o_orderdate OR o_totalprice <= 0").select("o_orderkey")


@query("k04_ordered_children", "SELECT l_orderkey FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY idx) AS p FROM v_line) q GROUP BY 1 HAVING bool_or(l_linenumber <= p)", "v_line")
def _(spark, d):
    p = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("idx"))
    return v.lines(spark, d).select("l_orderkey", (F.col("l_linenumber") <= p).alias("bad")).groupBy("l_orderkey").agg(F.bool_or("bad").alias("bad")).filter("bad").select("l_orderkey")


@query("k06_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("k07_expired", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    held = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select("o_orderkey").join(held, "o_orderkey", "left_anti")


@query("k08_manifest", "SELECT lang || '/' || source || '/' || doc_id::VARCHAR AS path, strlen(text) AS bytes, sha256(text) AS checksum FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("checksum"))


@query("k10_artifact_state", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NONE' WHEN l.quality = 1 THEN 'VALID_ATOMIC' ELSE 'PRESENT_UNVERIFIED' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    j = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "NONE").when(F.col("quality") == 1, "VALID_ATOMIC").otherwise("PRESENT_UNVERIFIED").alias("state"))


@query("k11_stale_jobs", "SELECT job_id FROM (SELECT job_id, arg_max(status, (heartbeat_at, event_id)) AS status, max(heartbeat_at) AS beat FROM v_jobs GROUP BY 1) q WHERE status = 'RUNNING' AND beat <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE", "v_jobs")
def _(spark, d):
    last = v.jobs(spark, d).groupBy("job_id").agg(F.max_by("status", F.struct("heartbeat_at", "event_id")).alias("status"), F.max("heartbeat_at").alias("beat"))
    now = read(spark, d, "events").agg(F.max("ts").alias("now"))  # one row
    return last.filter("status = 'RUNNING'").join(F.broadcast(now), F.col("beat") <= F.col("now") - F.expr("INTERVAL 5 MINUTES")).select("job_id")


@query("k12_recovered_segments", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'O')")
def _(spark, d):
    line = lambda s: read(spark, d, "lineitem").filter(F.col("l_linestatus") == s).select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(line("F"), "o_orderkey", "left_semi").join(line("O"), "o_orderkey", "left_anti")


@query("k13_import_dedup", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'NEW' ELSE 'NO_OP' END AS outcome FROM documents")
def _(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = x.groupBy("h").agg(F.min("doc_id").alias("first"))
    return x.join(first, "h").select("doc_id", F.when(F.col("doc_id") == F.col("first"), "NEW").otherwise("NO_OP").alias("outcome"))


@query("k14_retry_eligibility", "SELECT job_id, count(*) FILTER (WHERE status = 'FAILED') AS tries FROM v_jobs GROUP BY 1 HAVING count(*) FILTER (WHERE status = 'FAILED') BETWEEN 8 AND 12", "v_jobs")
def _(spark, d):
    return v.jobs(spark, d).groupBy("job_id").agg(F.count_if(F.col("status") == "FAILED").alias("tries")).filter("tries BETWEEN 8 AND 12")


_GRID = "SELECT item_id, rep, [1, 5][(item_id + rep) % 2 + 1] AS batch_size, ['SHORT', 'MEDIUM', 'LONG'][(item_id + rep) % 3 + 1] AS context FROM benchmark, unnest(range(0, 3)) u(rep)"


def _grid(spark, d):
    g = read(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("rep"))
    n = F.col("item_id") + F.col("rep")
    return g.select("item_id", "rep", F.when(n % 2 == 0, 1).otherwise(5).alias("batch_size"), v.pick(("SHORT", "MEDIUM", "LONG"), n % 3).alias("context"))


@query("m01_run_grid", _GRID)
def _(spark, d):
    return _grid(spark, d)


@query("m02_resumed_runs", f"SELECT item_id, rep FROM ({_GRID}) g WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = g.item_id AND g.rep < 2)")
def _(spark, d):
    done = read(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("rep"))
    return _grid(spark, d).select("item_id", "rep").join(done, ["item_id", "rep"], "left_anti")


_SUM = "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < 95) AS good, round(avg(value), 6) AS latency, count(*) FILTER (WHERE value < 95) / count(*) AS success FROM events GROUP BY 1"


@query("m04_summary", f"SELECT event_type, n, good, latency, round(success, 6) AS success FROM ({_SUM}) q")
def _(spark, d):
    good = F.count_if(F.col("value") < 95)
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), good.alias("good"), F.round(F.avg("value"), 6).alias("latency"), F.round(good / F.count("*"), 6).alias("success"))


@query("m05_recommendation", "SELECT user_id, CASE WHEN critical > 0 OR success < 0.5 THEN 'REJECTED' WHEN success >= 0.98 THEN 'DEFAULT' WHEN success >= 0.8 THEN 'EXPERIMENTAL' ELSE 'FALLBACK_ONLY' END AS advice FROM (SELECT user_id, count(*) FILTER (WHERE value > 99.5) AS critical, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS success FROM events GROUP BY 1) q")
def _(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 99.5).alias("c"), (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("s"))
    return g.select("user_id", r.recommendation(F.col("s"), F.col("c")).alias("advice"))


@query("m06_evaluation_batches", "SELECT event_type, count(*) AS n_batches, sum(n)::BIGINT AS attempted, round(sum(latency), 4) AS latency FROM (SELECT event_type, event_id // 10 AS b, count(*) AS n, max(value) AS latency FROM events GROUP BY ALL) q GROUP BY ROLLUP (event_type)")
def _(spark, d):
    b = read(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 10).alias("b")).agg(F.count("*").alias("n"), F.max("value").alias("latency"))
    return b.rollup("event_type").agg(F.count("*").alias("n_batches"), F.sum("n").alias("attempted"), F.round(F.sum("latency"), 4).alias("latency"))
