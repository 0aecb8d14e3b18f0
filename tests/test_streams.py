"""Streams that are stopped, killed and resumed, against their batch twins; late rows; sessions by timers."""

import datetime

import pytest
from pyspark.sql import functions as F

from textloom.operators import qa
from textloom.streaming import jobs

at = lambda m, s=0: datetime.datetime(2024, 1, 1, m // 60, m % 60, s)
BEATS = "job_id long, ts timestamp"


def arrive(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{n}")


def test_open_sessions_go_on_after_a_stop(spark, tmp_path):
    """Three runs on one checkpoint give what one run gives, and the last state of each job is the table twin's."""
    files = [[(1, at(0)), (2, at(1)), (1, at(3))], [(2, at(4)), (4, at(4))], [(3, at(40))], [(3, at(41)), (2, at(39))], [(1, at(44))], [(5, at(45))]]

    def beats(path):
        return spark.readStream.schema(BEATS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")

    def run(path):
        q = jobs.open_sessions(beats(path)).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").option("path", f"{path}/out").trigger(availableNow=True).start()
        q.awaitTermination()

    whole, parts = tmp_path / "whole", tmp_path / "parts"
    for i, rows in enumerate(files):
        arrive(spark, rows, BEATS, whole, i)
    run(whole)
    for i, rows in enumerate(files):
        arrive(spark, rows, BEATS, parts, i)
        if i % 2:
            run(parts)
    read = lambda p: sorted(map(tuple, spark.read.parquet(f"{p}/out").collect()))
    assert read(parts) == read(whole)
    rows = set(read(parts))
    assert {(1, at(3), True), (2, at(4), True), (4, at(4), True), (3, at(41), False), (1, at(44), False), (5, at(45), False)} <= rows and (3, at(41), True) not in rows
    twin = {r.job_id: (r.last_beat, r.stale) for r in jobs.last_beats(spark.read.schema(BEATS).parquet(*[f"{parts}/in/{i}" for i in range(len(files))])).collect()}
    assert twin == {1: (at(44), False), 2: (at(39), True), 3: (at(41), False), 4: (at(4), True), 5: (at(45), False)}
    for job, (last, _) in twin.items():
        assert max(r[1] for r in rows if r[0] == job) == last


def test_first_of_key_and_counters_resume(spark, tmp_path):
    """Repeats of a key count once over a stop, and rows behind the watermark are counted as late."""
    schema = "key string, event_type string, ts timestamp"
    jobs.keep_state_in_rocksdb(spark)
    files = [[("a", "x", at(0)), ("b", "x", at(1)), ("a", "x", at(2))], [("b", "x", at(3)), ("c", "y", at(4))], [("d", "y", at(200))], [("e", "x", at(201)), ("d", "y", at(202))], [("h", "x", at(203))], [("f", "x", at(5))], [("g", "y", at(400))]]

    def run(name, job):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = job(s).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp-{name}").option("path", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    late = 0
    for i, rows in enumerate(files):
        arrive(spark, rows, schema, tmp_path, i)
        if i in (1, 6):
            late += jobs.late_rows(run("first", lambda s: jobs.first_of_key(s, "key", late="60 minutes")))
            run("hours", lambda s: jobs.hourly_progress(s, late="60 minutes"))
    got = sorted(r.key for r in spark.read.parquet(f"{tmp_path}/first").collect())
    assert got == ["a", "b", "c", "d", "e", "g", "h"] and late == 1
    hours = {(r.started, r.event_type, r.n) for r in spark.read.parquet(f"{tmp_path}/hours").collect()}
    on_time = spark.createDataFrame([r for f in files for r in f if r[0] != "f"], schema)
    twin = {(r.started, r.event_type, r.n) for r in jobs.hourly_progress(on_time).collect() if r.started < at(300)}
    assert hours == twin


def test_checks_of_a_killed_stream_come_once(spark, tmp_path):
    """A query that dies in a batch and is started again has each row once, the batch twin's."""
    schema = "pair_id long, source string, target string"
    pairs = [[(i * 10 + k, f"Total {i} of {k}", f"Total {k}") for k in range(4)] for i in range(4)]
    for i, rows in enumerate(pairs):
        arrive(spark, rows, schema, tmp_path, i)
    died = []

    def job(batch):
        found = qa.issues(batch)
        if batch.filter("pair_id = 20").count() and not died:
            died.append(1)
            # rows are written, then a task fails
            return found.withColumn("pair_id", F.when(F.col("pair_id") < 23, F.col("pair_id")).otherwise(F.raise_error(F.lit("killed")).cast("long")))
        return found

    def start():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return jobs.each_batch(s, job, f"{tmp_path}/out", f"{tmp_path}/cp")

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    assert died
    start().awaitTermination()
    got = sorted((r.pair_id, r.code) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.pair_id, r.code) for r in qa.issues(spark.createDataFrame([r for f in pairs for r in f], schema)).collect())
    assert got == want and want


def test_incremental_checks_of_a_table_of_many_files_and_of_none(spark, tmp_path):
    import __spark_entry__

    run = __spark_entry__.queries()["x04_incremental_checks"]
    turns = [(1, 0, "user", "see 5 and 7"), (1, 1, "assistant", "see 5"), (2, 0, "user", "no"), (2, 1, "assistant", " ")]
    table = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    table.repartition(3, "turn", "conv_id").write.parquet(f"{tmp_path}/many/conversations.parquet")
    assert {(r.pair_id, r.code) for r in run(spark, f"{tmp_path}/many").collect()} >= {(-1001, "NUMBER_MISMATCH"), (-2001, "EMPTY_TRANSLATION")}
    table.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert run(spark, f"{tmp_path}/none").collect() == []
