"""Streaming operators' batch twins over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import qa
from textloom.plans.base import query
from textloom.plans.translation import _ISSUES
from textloom.sources.scratch import new_path
from textloom.sources.tables import read
from textloom.streaming import jobs


@query("x01_heartbeat_sessions", """SELECT job_id, min(ts) AS started, max(ts) + INTERVAL 5 MINUTE AS ended, count(*) AS beats FROM (SELECT user_id AS job_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS f FROM events) a) b GROUP BY job_id, s""")
def _(spark, d):
    return jobs.sessions(read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts"))


@query("x02_idempotent_ingest", "SELECT user_id, event_type, count(DISTINCT props) AS n FROM events GROUP BY ALL")
def _(spark, d):
    e = read(spark, d, "events").withColumn("key", F.concat_ws("/", "user_id", "event_type", "props"))
    return jobs.first_of_key(e, "key").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("x03_live_progress", "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return jobs.hourly_progress(read(spark, d, "events"))


@query("x05_open_sessions", """SELECT job_id, max(ts) AS last_beat, max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) AS stale FROM (SELECT user_id AS job_id, ts FROM events) e GROUP BY 1""")
def _(spark, d):
    return jobs.last_beats(read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts"))


_TALK = _ISSUES.replace("FROM v_pairs", "FROM (SELECT * FROM v_pairs WHERE pair_id < 0)")


@query("x04_incremental_checks", _TALK, "v_pairs")
def _(spark, d):
    # turns arrive as a stream; each batch of answered turns is checked and its rows are kept under the batch's number;
    # a stream reads a folder or what a pattern names, so the pattern stands for a table of one file or of many
    turns = spark.readStream.schema(read(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answer = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    answered = user.join(answer, ["conv_id", "turn"]).select((-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("pair_id"), "source", "target")
    path, found = new_path(spark), "pair_id bigint, code string, severity string"
    # a stream without rows has no batch, so its folder begins with one of none
    spark.createDataFrame([], found).write.parquet(f"{path}/batch=-1")
    jobs.each_batch(answered, qa.issues, path, new_path(spark)).awaitTermination()
    return spark.read.schema(f"{found}, batch int").parquet(path).drop("batch")
