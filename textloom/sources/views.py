"""Views that give the supplied tables the shape of documents, segments, rules, boxes, warnings and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.tables import read

STATUSES = ("READY", "MACHINE_TRANSLATED", "NEEDS_REVIEW", "TRANSLATION_FAILED", "APPROVED", "LOCKED")
SEVERITIES = ("INFORMATION", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SCOPES = ("SYSTEM", "DOMAIN", "USER", "PROJECT", "DOCUMENT", "SECTION", "PAGE", "SEGMENT")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def pick_sql(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({index}) + 1]"


def segments(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    order = (F.col("pos") + 1).cast("long")
    return docs.filter(F.trim("text") != "").select(
        "doc_id", order.alias("seg_order"), (F.col("doc_id") * 100000 + order).alias("seg_id"), "text", "lang", "source"
    )


def status_of(seg_id: Column) -> Column:
    return pick(STATUSES, seg_id % 6)


def segment_state(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).withColumns({
        "status": status_of(F.col("seg_id")), "section": F.floor(F.col("seg_order") / 10).cast("long"), "revision": (F.col("seg_id") % 4).cast("long"),
    })


#: Lines that a task should sort and group.
TASK_LINES = 250_000


def line_tasks(spark: SparkSession, d: str) -> int:
    """How many tasks order lines are dealt to: more of them the more lines, so that a task's memory doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-read(spark, d, "lineitem").count() // TASK_LINES))


def lines(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    dealt = read(spark, d, "lineitem").repartition(line_tasks(spark, d), "l_orderkey")
    return dealt.withColumn("idx", F.row_number().over(w).cast("long"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("l_partkey") * 13) % 500, (F.col("l_suppkey") * 29 + F.col("idx") * 60) % 700
    b = lines(spark, d).select(
        F.col("l_orderkey").alias("page"), "idx", x.cast("double").alias("x"), y.cast("double").alias("y"),
        F.least(20 + F.col("l_quantity") * 4, 600 - x).cast("double").alias("w"), F.least(8 + F.col("l_partkey") % 12, 800 - y).cast("double").alias("h"),
        F.when(F.col("l_returnflag") == "A", "TEXT").when(F.col("l_returnflag") == "N", "IMAGE").otherwise("TABLE").alias("kind"),
        (8 + F.round(F.col("l_tax") * 100)).cast("double").alias("font"),
    )
    return b


def warnings(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("OCR_LOW_CONFIDENCE", "READING_ORDER", "TABLE_STRUCTURE", "NUMBER_MISMATCH", "PLACEHOLDER_MISMATCH", "OVERFLOW", "COLLISION", "UNRESOLVED_TERM")
    return read(spark, d, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("warning_id"), F.col("user_id").alias("scope_id"), pick(SEVERITIES, F.col("event_id") % 5).alias("severity"),
        pick(kinds, F.col("user_id") % 8).alias("kind"), F.when(F.col("event_id") % 3 == 0, "RESOLVED").otherwise("OPEN").alias("status"), "ts",
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Source and target texts: answers to turns, and copies of segments with planted faults."""
    c = read(spark, d, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answer = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    talk = user.join(answer, ["conv_id", "turn"]).select((-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("pair_id"), "source", "target", F.lit(None).cast("string").alias("lang"))
    s = segments(spark, d)
    k = F.col("seg_id") % 11
    target = (
        F.when(k == 1, F.regexp_replace("text", "[0-9]", "")).when(k == 2, F.regexp_replace("text", "^[^ ]* ", ""))
        .when(k == 3, F.lit("  ")).when(k == 4, F.concat_ws(" ", "text", "text", "text")).otherwise(F.col("text"))
    )
    return talk.unionByName(s.select(F.col("seg_id").alias("pair_id"), F.col("text").alias("source"), target.alias("target"), "lang"))


#: How often a word must be found to be a term.
TERM_COUNT = 20


def glossary(spark: SparkSession, d: str) -> DataFrame:
    """Terms: every line of the benchmark's items, and every lower-case word of four letters or more found often enough."""
    line = F.posexplode(F.split("text", "\n")).alias("pos", "source_term")
    bench = read(spark, d, "benchmark").select("item_id", line).filter("trim(source_term) <> ''").select((F.col("item_id") * 1000 + F.col("pos")).alias("term_id"), "source_term")
    words = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).filter(F.col("w").rlike(r"\A[a-z]{4,}\z"))
    often = words.groupBy("w").count().filter(F.col("count") >= TERM_COUNT)
    number = F.conv(F.substring(F.md5("w"), 1, 12), 16, 10).cast("long")
    return bench.unionByName(often.select((F.lit(1_000_000_000) + number).alias("term_id"), F.col("w").alias("source_term")))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """Four rules a term, in pairs of one scope; every other term's rules have one priority."""
    g = glossary(spark, d)
    r = g.select("term_id", "source_term", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    t, k = F.col("term_id"), F.col("k")
    half = F.floor(k / 2).cast("long")
    n = (t * 7 + half) % 8
    some = (t + k) % 3
    reference = F.when((n == 0) | (n.isin(1, 2) & (some == 0)), F.lit(None)).otherwise(F.concat(F.lit("r"), ((t + half) % 2).cast("string")))
    conditions = F.map_filter(
        F.create_map(
            F.lit("document_type"), F.when(some != 0, pick(("legal", "technical"), (F.floor(t / 2) + half) % 2)),
            F.lit("register"), F.when(t % 5 == 0, pick(("formal", "plain"), k % 2)),
        ), lambda _, v: v.isNotNull(),
    )
    return r.select(
        (t * 4 + k).alias("rule_id"), "term_id", F.lower("source_term").alias("term"), n.cast("long").alias("scope_rank"), pick(SCOPES, n).alias("scope"),
        reference.alias("scope_reference_id"),
        ((t + k * (t % 2)) % 3).alias("priority"), pick(("PREFERRED", "KEEP_SOURCE", "FORBIDDEN"), some).alias("rule_type"),
        F.when(some == 0, F.concat(F.lit("t"), (t % 5 + k % 2).cast("string"))).alias("target"), conditions.alias("conditions"), ((t + k) % 7 != 0).alias("active"),
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.create_map(*map(F.lit, ("click", "RUNNING", "view", "RUNNING", "signup", "QUEUED", "purchase", "COMPLETED", "error", "FAILED")))
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.element_at(status, F.col("event_type")).alias("status"), F.col("ts").alias("heartbeat_at"), F.col("props").alias("payload"))


SQL = {
    "v_segments": """SELECT doc_id, i AS seg_order, doc_id * 100000 + i AS seg_id, s[i] AS text, lang, source
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS s FROM documents) x, unnest(range(1, len(s) + 1)) t(i) WHERE trim(s[i]) <> ''""",
    "v_seg_state": f"SELECT *, {pick_sql(STATUSES, 'seg_id % 6')} AS status, seg_order // 10 AS section, seg_id % 4 AS revision FROM v_segments",
    "v_line": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS idx FROM lineitem",
    "v_boxes": """SELECT l_orderkey AS page, idx, (l_partkey * 13 % 500)::DOUBLE AS x, ((l_suppkey * 29 + idx * 60) % 700)::DOUBLE AS y,
        least(20 + l_quantity * 4, 600 - (l_partkey * 13 % 500))::DOUBLE AS w, least(8 + l_partkey % 12, 800 - (l_suppkey * 29 + idx * 60) % 700)::DOUBLE AS h,
        CASE l_returnflag WHEN 'A' THEN 'TEXT' WHEN 'N' THEN 'IMAGE' ELSE 'TABLE' END AS kind, (8 + round(l_tax * 100))::DOUBLE AS font FROM v_line""",
    "v_warn": f"""SELECT event_id AS warning_id, user_id AS scope_id, {pick_sql(SEVERITIES, 'event_id % 5')} AS severity,
        {pick_sql(("OCR_LOW_CONFIDENCE", "READING_ORDER", "TABLE_STRUCTURE", "NUMBER_MISMATCH", "PLACEHOLDER_MISMATCH", "OVERFLOW", "COLLISION", "UNRESOLVED_TERM"), 'user_id % 8')} AS kind,
        CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, ts FROM events WHERE event_type = 'error'""",
    "v_pairs": """SELECT -(u.conv_id * 1000 + u.turn) - 1 AS pair_id, u.text AS source, a.text AS target, NULL::VARCHAR AS lang
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
        UNION ALL SELECT seg_id, text, CASE seg_id % 11 WHEN 1 THEN regexp_replace(text, '[0-9]', '', 'g') WHEN 2 THEN regexp_replace(text, '^[^ ]* ', '')
        WHEN 3 THEN '  ' WHEN 4 THEN text || ' ' || text || ' ' || text ELSE text END, lang FROM v_segments""",
    "v_glossary": f"""SELECT item_id * 1000 + i - 1 AS term_id, s[i] AS source_term FROM (SELECT item_id, string_split(text, chr(10)) AS s FROM benchmark) x, unnest(range(1, len(s) + 1)) t(i) WHERE trim(s[i]) <> ''
        UNION ALL SELECT 1000000000 + ('0x' || left(md5(w), 12))::BIGINT, w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) q
        WHERE regexp_full_match(w, '[a-z]{{4,}}') GROUP BY w HAVING count(*) >= {TERM_COUNT}""",
    "v_rules": f"""SELECT term_id * 4 + k AS rule_id, term_id, lower(source_term) AS term, n AS scope_rank, {pick_sql(SCOPES, 'n')} AS scope,
        CASE WHEN n <> 0 AND NOT (n IN (1, 2) AND third = 0) THEN 'r' || ((term_id + k // 2) % 2)::VARCHAR END AS scope_reference_id,
        (term_id + k * (term_id % 2)) % 3 AS priority, {pick_sql(("PREFERRED", "KEEP_SOURCE", "FORBIDDEN"), 'third')} AS rule_type,
        CASE WHEN third = 0 THEN 't' || (term_id % 5 + k % 2)::VARCHAR END AS target,
        CASE WHEN third <> 0 THEN {pick_sql(("legal", "technical"), '(term_id // 2 + k // 2) % 2')} END AS document_type, CASE WHEN term_id % 5 = 0 THEN {pick_sql(("formal", "plain"), 'k % 2')} END AS register,
        (term_id + k) % 7 <> 0 AS active FROM (SELECT *, (term_id * 7 + k // 2) % 8 AS n, (term_id + k) % 3 AS third FROM v_glossary, unnest(range(0, 4)) t(k)) q""",
    "v_jobs": """SELECT event_id, user_id AS job_id, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'RUNNING' WHEN 'signup' THEN 'QUEUED'
        WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status, ts AS heartbeat_at, props AS payload FROM events""",
}
