"""Structured Streaming: sessions of heartbeats, idempotent ingest and live counters, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def sessions(beats: DataFrame, gap: str = "5 minutes", late: str = "30 days") -> DataFrame:
    """(job_id, started, ended, beats): runs of heartbeats (job_id, ts) with no gap as long as ``gap``."""
    if beats.isStreaming:
        beats = beats.withWatermark("ts", late)
    g = beats.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats"))
    return g.select("job_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "beats")


def last_beats(beats: DataFrame) -> DataFrame:
    """(job_id, last_beat, stale) of each job in a table of heartbeats: stale if five minutes or more went by since."""
    now = beats.agg(F.max("ts").alias("now"))
    # a subquery of one value
    late = F.col("last_beat") + F.expr("INTERVAL 5 MINUTES") <= now.scalar()
    return beats.groupBy("job_id").agg(F.max("ts").alias("last_beat")).select("job_id", "last_beat", late.alias("stale"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """From now on streams of this session keep their state in RocksDB, on disk and by changes, not in executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class OpenSessions(StatefulProcessor):
    """A job's last beat, and a timer at the moment from which on it counts as stale."""

    def __init__(self, gap_minutes: int) -> None:
        self.gap_ms = gap_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = max(int(f["ts"].max().value // 1000) for f in rows)
        if self.last.exists():
            (before,) = self.last.get()
            # rows come before timers in a batch: a session whose time was over goes first
            if before // 1000 + self.gap_ms <= timerValues.getCurrentWatermarkInMs():
                yield self.row(key, before, True)
            last = max(last, before)
        self.last.update((last,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        # a job whose beats come after their time is over has its say once more, then goes
        self.handle.registerTimer(max(last // 1000 + self.gap_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.row(key, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get()
        self.last.clear()
        yield self.row(key, last, True)

    def row(self, key, last: int, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "last_beat": [pd.Timestamp(last, unit="us")], "stale": [stale]})

    def close(self) -> None:
        pass


def open_sessions(beats: DataFrame, gap_minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """(job_id, last_beat, stale) from a stream of heartbeats (job_id, ts): a row with stale false whenever a job beats
    while its session is open, and one with stale true when event time passes its last beat by the gap (a timer).

    A job's state is its last beat alone and goes with its session; it lives in RocksDB. Beats later than ``late`` behind
    the newest are dropped (``late_rows`` counts them). A query started again on its checkpoint goes on as if it
    hadn't stopped.
    """
    keep_state_in_rocksdb(beats.sparkSession)
    return beats.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(
        OpenSessions(gap_minutes), outputStructType="job_id long, last_beat timestamp, stale boolean", outputMode="Append", timeMode="EventTime"
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators of ``query`` have left out as too late, over the batches it still reports."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def first_of_key(events: DataFrame, key: str, late: str = "30 days") -> DataFrame:
    """``events`` (with ts) with one row for each key within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def hourly_progress(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "30 days") -> DataFrame:
    """(started, event_type, n): events by window; tumbling, or sliding where ``slide`` is given."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def each_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run ``job`` on every micro-batch of ``stream`` and append its rows under ``path``, once for each batch number."""

    def write(batch: DataFrame, number: int) -> None:
        job(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
