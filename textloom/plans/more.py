"""Further bindings of the same operators: checks of planted faults, listings and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import batching as b
from textloom.operators import glossary as g
from textloom.operators import layout as y
from textloom.operators import protect as p
from textloom.operators import qa
from textloom.operators import records as r
from textloom.operators import text as t
from textloom.plans.base import query
from textloom.plans.glossary import _CONFLICTS, _GREEDY, _HELD
from textloom.plans.layout import _COMPONENTS
from textloom.plans.translation import _PACK, _TOKEN_SQL, _cited, _coded, _masked, _numbers
from textloom.sources import sinks
from textloom.sources import views as v
from textloom.sources.scratch import materialize, new_path
from textloom.sources.tables import read

def _tokens(text):
    return F.regexp_extract_all(text, F.lit(p.TOKEN), F.lit(0))


def _differing(pairs, found):
    """pair_id of those ``pairs`` (pair_id, source, target) of whose texts ``found`` makes different arrays. Equal texts have
    equal ones, so only others are looked at, both in their row; a pair without one of its texts isn't taken."""
    # an array that is exploded is worked out once, before anything is compared
    both = pairs.filter("source <> target").select("pair_id", F.explode(F.array(F.transform(F.array("source", "target"), found))).alias("f"))
    return both.filter(F.get("f", F.lit(0)) != F.get("f", F.lit(1))).select("pair_id")


@query("q02_placeholder_mismatch", f"SELECT a.pair_id FROM ({_masked('v_pairs', 'pair_id', 'source')}) a JOIN ({_masked('v_pairs', 'pair_id', 'target')}) b USING (pair_id) WHERE a.items <> b.items", "v_pairs")
def _(spark, d):
    # a text that is missing has no placeholders
    return _differing(v.pairs(spark, d).na.fill("", ["source", "target"]), p.placeholders_left)


@query("m03_placeholder_multiset", f"""WITH m AS ({_masked('documents', 'doc_id')}) SELECT doc_id, list_sort(items) = list_sort(regexp_extract_all(array_to_string(list_reverse(string_split(masked, chr(10))), chr(10)), '{_TOKEN_SQL}')) AS turned, list_sort(items) = list_sort(regexp_extract_all(string_split(masked, chr(10))[1], '{_TOKEN_SQL}')) AS first_line FROM m""")
def _(spark, d):
    # lines turned round keep all placeholders; a first line alone keeps its own
    # an array that is exploded is worked out once: a text is masked before anything asks for it
    m = p.mask(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array("masked")).alias("masked"))
    lines = F.split("masked", "\n")
    found = F.transform(F.array(F.col("masked"), F.array_join(F.reverse(lines), "\n"), F.get(lines, F.lit(0))), lambda text: F.array_sort(_tokens(text)))
    m = m.select("doc_id", F.explode(F.array(found)).alias("f"))
    same = lambda i: F.get("f", F.lit(0)) == F.get("f", F.lit(i))
    return m.select("doc_id", same(1).alias("turned"), same(2).alias("first_line"))


@query("q05_code_mismatch", f"SELECT pair_id FROM v_pairs WHERE {_coded('source')} <> {_coded('target')}", "v_pairs")
def _(spark, d):
    return _differing(v.pairs(spark, d), qa.code_inventory)


_CITING = "SELECT pair_id, source || ' [' || (len(string_split(source, ' ')) % 10)::VARCHAR || ']' AS s, target || ' [' || (len(string_split(target, ' ')) % 10)::VARCHAR || ']' AS g FROM v_pairs"


@query("q06_citation_mismatch", f"SELECT pair_id FROM ({_CITING}) c WHERE {_cited('s')} <> {_cited('g')}", "v_pairs")
def _(spark, d):
    # each text cites by its number of words
    cited = lambda c: F.concat(F.col(c), F.lit(" ["), (F.size(F.split(c, " ")) % 10).cast("string"), F.lit("]"))
    return _differing(v.pairs(spark, d).select("pair_id", cited("source").alias("source"), cited("target").alias("target")), qa.citation_inventory)


@query("q15_literal_safe", f"SELECT pair_id FROM v_pairs WHERE {_numbers('source')} = {_numbers('target')}", "v_pairs")
def _(spark, d):
    n = lambda c: qa.number_inventory(t.mask_placeholders(F.col(c)))
    return v.pairs(spark, d).filter(n("source") == n("target")).select("pair_id")


@query("w08_minimum_images", "SELECT page_id, sha256(html) AS checksum, len(regexp_extract_all(html, '(?i)<img')) AS n_images FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("checksum"), F.size(F.regexp_extract_all("html", F.lit("(?i)<img"), F.lit(0))).cast("long").alias("n_images"))


@query("r11_page_view", "SELECT s.doc_id, string_agg(s.seg_id::VARCHAR, ',' ORDER BY s.seg_order) AS segments, max(coalesce(w.n, 0)) AS n_open FROM v_segments s LEFT JOIN (SELECT scope_id, count(*) AS n FROM v_warn WHERE status = 'OPEN' GROUP BY 1) w ON w.scope_id = s.doc_id GROUP BY s.doc_id", "v_segments", "v_warn")
def _(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("seg_order", "seg_id")))
    s = v.segments(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["seg_id"].cast("string")), ",").alias("segments"))
    w = v.warnings(spark, d).filter("status = 'OPEN'").groupBy(F.col("scope_id").alias("doc_id")).agg(F.count("*").alias("n_open"))
    return s.join(w, "doc_id", "left").na.fill(0, ["n_open"])


@query("r14_active_projects", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def _(spark, d):
    return read(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name")


@query("r22_run_counts", "SELECT job_id, arg_max(status, (heartbeat_at, event_id)) AS status, count(*) FILTER (WHERE json_extract_string(payload, '$.k')::BIGINT > 50) AS n_selected FROM v_jobs GROUP BY 1", "v_jobs")
def _(spark, d):
    k = F.coalesce(F.from_json("payload", "k long")["k"], F.lit(0))
    return v.jobs(spark, d).groupBy("job_id").agg(F.max_by("status", F.struct("heartbeat_at", "event_id")).alias("status"), F.count_if(k > 50).alias("n_selected"))


@query("r23_translation_readiness", "SELECT doc_id, concat_ws(',', CASE WHEN count(*) < 3 THEN 'FEW_SEGMENTS' END, CASE WHEN bool_or(status = 'TRANSLATION_FAILED') THEN 'UNRESOLVED_SOURCE' END) AS blockers FROM v_seg_state GROUP BY doc_id", "v_seg_state")
def _(spark, d):
    s = v.segment_state(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "TRANSLATION_FAILED").alias("bad"))
    return s.select("doc_id", F.concat_ws(",", F.when(F.col("n") < 3, "FEW_SEGMENTS"), F.when(F.col("bad"), "UNRESOLVED_SOURCE")).alias("blockers"))


_FILES = ("nation", "orders", "part", "region", "supplier")


_TOUCHED = "SELECT * REPLACE (CASE WHEN n_nationkey = 3 THEN n_name || '!' ELSE n_name END AS n_name) FROM nation"


@query("k05_file_integrity", f"""SELECT coalesce(a.name, b.name) AS name, a.n AS n_stored, b.n AS n_found, CASE WHEN b.n IS NULL THEN 'MISSING' WHEN a.n IS NULL THEN 'EXTRA' WHEN b.other > 0 THEN 'CHANGED' ELSE 'SAME' END AS outcome
    FROM (SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', count(*) FROM region) a
    FULL JOIN (SELECT 'nation' AS name, count(*) AS n, (SELECT count(*) FROM (({_TOUCHED}) EXCEPT ALL SELECT * FROM nation) x) AS other FROM nation
        UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders WHERE o_orderstatus <> 'P') x) FROM orders WHERE o_orderstatus <> 'P'
        UNION ALL SELECT 'region', count(*), 0 FROM region UNION ALL SELECT 'supplier', count(*), 0 FROM supplier) b ON b.name = a.name""")
def _(spark, d):
    # a catalogue is written, then a table goes, one loses rows, one has another value in a row and one is new
    stored = materialize(r.catalogue({x: read(spark, d, x) for x in _FILES[:4]}))
    left = {x: read(spark, d, x) for x in _FILES if x != "part"}
    left["orders"] = left["orders"].filter("o_orderstatus <> 'P'")
    left["nation"] = left["nation"].withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")))
    now = r.catalogue(left)
    n = stored.select("name", F.col("n").alias("n_stored")).join(now.select("name", F.col("n").alias("n_found")), "name", "full")
    return r.compare_catalogues(stored, now, "name", "h").join(n, "name")


@query("t12_conflict_status", f"SELECT CASE WHEN winner IS NULL THEN 'UNRESOLVED' ELSE 'AUTO_RESOLVED' END AS status, count(*) AS n FROM ({_CONFLICTS}) c GROUP BY 1", "v_rules")
def _(spark, d):
    return g.conflicts(v.rules(spark, d)).groupBy(F.when(F.col("winner").isNull(), "UNRESOLVED").otherwise("AUTO_RESOLVED").alias("status")).agg(F.count("*").alias("n"))


@query("t13_dominated_rules", f"SELECT a.rule_id FROM v_rules a WHERE a.active AND EXISTS (SELECT 1 FROM v_rules c WHERE c.active AND c.term = a.term AND c.priority > a.priority AND {_HELD})", "v_rules")
def _(spark, d):
    a = v.rules(spark, d).filter("active").withColumn("held", F.array_sort(F.map_entries("conditions")))
    place = ["term", "scope", "scope_reference_id", "held"]
    best = a.groupBy(*place).agg(F.max("priority").alias("best"), F.collect_list(F.struct("rule_id", "priority")).alias("r"))
    return best.select("best", F.inline("r")).filter("best > priority").select("rule_id")


@query("t30_term_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%e%' ORDER BY p_name, p_partkey LIMIT 100")
def _(spark, d):
    return read(spark, d, "part").filter(F.lower("p_name").like("%e%")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(100)


_ROW = "(p.h > 0 AND q.h > 0 AND (greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) >= 0.35 * least(p.h, q.h) OR abs(p.y + p.h / 2 - q.y - q.h / 2) <= 0.5 * least(p.h, q.h)))"


@query("g20_grid_rows", _COMPONENTS.format(near=_ROW), "v_boxes")
def _(spark, d):
    c = lambda a, n: F.col(f"{a}.{n}")
    low = F.least(c("p", "h"), c("q", "h"))
    shared = y.overlap_1d(c("p", "y"), c("p", "h"), c("q", "y"), c("q", "h"))
    centres = F.abs(c("p", "y") + c("p", "h") / 2 - c("q", "y") - c("q", "h") / 2)
    return y.page_components(v.boxes(spark, d), (c("p", "h") > 0) & (c("q", "h") > 0) & ((shared >= 0.35 * low) | (centres <= 0.5 * low)))


@query("a04_snapshot", "SELECT scope, 1 AS version, count(*) AS n, min(rule_id) AS first_rule FROM v_rules WHERE active GROUP BY scope", "v_rules")
def _(spark, d):
    path = new_path(spark)
    rules = v.rules(spark, d).filter("active").select("scope", F.lit(1).alias("version"), "rule_id", "rule_type", "target", "priority")
    sinks.write_snapshot(rules, path, "scope", "version")
    return spark.read.parquet(path).groupBy("scope", "version").agg(F.count("*").alias("n"), F.min("rule_id").alias("first_rule"))


@query("a06_quality_report", "SELECT severity, status, count(*) AS n FROM v_warn GROUP BY ALL", "v_warn")
def _(spark, d):
    path = new_path(spark)
    sinks.write_report(v.warnings(spark, d).groupBy("severity", "status").agg(F.count("*").alias("n")), path)
    return spark.read.schema("severity string, status string, n bigint").json(path)


@query("a08_revision_log", "SELECT l_orderkey AS entity, count(*) AS revisions, max(idx) AS latest FROM v_line GROUP BY 1", "v_line")
def _(spark, d):
    path = new_path(spark)
    rows = v.lines(spark, d).select(F.col("l_orderkey").alias("entity"), F.col("idx").alias("revision"), F.concat_ws(":", "l_partkey", "l_quantity").alias("payload"))
    for first in (True, False):  # first revisions, then all later ones
        sinks.append_revisions(rows.filter((F.col("revision") == 1) == first), path)
    return spark.read.parquet(path).groupBy("entity").agg(F.count("*").alias("revisions"), F.max("revision").alias("latest"))


def _batches(limit: int, most: int, tokens: str) -> str:
    return _PACK.replace("((strlen(text) + 3) // 4)::BIGINT", tokens).replace("300", str(limit)).replace("w.n >= 20", f"w.n >= {most}") + " SELECT doc_id, seg_id, batch FROM w"


@query("u01_batches_by_words", _batches(300, 20, "len(string_split(text, ' '))::BIGINT"), "v_segments")
def _(spark, d):
    s = v.segments(spark, d).select("doc_id", "seg_order", "seg_id", "text")
    words = lambda text: F.size(F.split(text, " ")).cast("long")
    return b.greedy_batches(s, ["doc_id"], ["seg_order"], b.BatchLimits(20, 300), words).select("doc_id", "seg_id", "batch")


@query("u03_batches_under_other_limits", _batches(120, 5, "((strlen(text) + 3) // 4)::BIGINT"), "v_segments")
def _(spark, d):
    s = v.segments(spark, d).select("doc_id", "seg_order", "seg_id", "text")
    return b.greedy_batches(s, ["doc_id"], ["seg_order"], b.BatchLimits(5, 120)).select("doc_id", "seg_id", "batch")


@query("u02_first_healthy_provider", "SELECT seg_id AS pair_id, 'swap' AS provider, sha256(replace(text, 'e', 'E')) AS target_sha256 FROM v_segments", "v_segments")
def _(spark, d):
    providers = [b.Provider("down", lambda: False, lambda: list), b.Provider("swap", lambda: True, lambda: lambda texts: [x.replace("e", "E") for x in texts])]
    s = v.segments(spark, d).select(F.col("seg_id").alias("pair_id"), F.col("text").alias("source"))
    return b.run_first_healthy(s, providers).select("pair_id", "provider", F.sha2("target", 256).alias("target_sha256"))


_SPANS_SQL = "occ AS (SELECT DISTINCT l_suppkey AS seg_id, l_partkey % 997 AS term_id, (l_partkey * 7 % 400)::BIGINT AS s, (l_partkey * 7 % 400 + 1 + l_linenumber)::BIGINT AS e FROM lineitem)"


@query("u05_longest_wins", f"""WITH RECURSIVE {_SPANS_SQL}{_GREEDY} SELECT seg_id AS supplier, x.t AS id, x.s AS "start", x.e AS "end" FROM kept UNION ALL SELECT seg_id, term_id, s, e FROM occ WHERE seg_id NOT IN (SELECT seg_id FROM clash)""")
def _(spark, d):
    at = F.col("l_partkey") * 7 % 400
    spans = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") % 997).alias("term_id"), at.alias("start"), (at + 1 + F.col("l_linenumber")).cast("long").alias("end"))
    return g.resolve_overlaps(spans, "supplier").withColumnRenamed("term_id", "id")


@query("u06_spans_as_rows", r"""SELECT doc_id, e - length(w) AS "first", e AS "end", w AS value FROM (SELECT doc_id, w[i] AS w, sum(length(g[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS w,
    string_split_regex(text, '[0-9]+') AS g FROM documents) x, unnest(range(1, len(w) + 1)) u(i)) y""")
def _(spark, d):
    from textloom.functions import udtf

    udtf.register(spark)
    docs = read(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, CAST(s.first AS BIGINT) AS first, CAST(s.end AS BIGINT) AS end, s.value FROM {docs}, LATERAL find_spans(text, '[0-9]+') s", docs=docs)
