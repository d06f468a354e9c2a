"""Closed sessions by event time, with a table of the requests that came too late.

A micro-batch takes its requests, less the late ones, into sessions (a segmented scan), joins these with the sessions that were open, and
closes what can't grow any more: the watermark, the latest time seen less the lateness allowed, has passed the end of
their timeout. A request is late when the watermark before its batch had passed its own timeout, so that no open session could take it.
Nothing is lost without a trace: requests of closed and open sessions and late ones add up to all.

Open sessions are a row each, whatever their length. Each micro-batch writes its tables whole under its number, so one that is
repeated writes them again; folders of ``open`` before the last two may be deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.operators.segments import by_time, gap_over, scan_sessions
from sessionscope.operators.sessions import client
from sessionscope.operators.staging import stage

SESSIONS = "session_ip string, start_time timestamp, end_time timestamp, n_events bigint, bits double"
MARKS = "latest_us bigint, epoch bigint"


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _batch_sessions(held: DataFrame, timeout_seconds: int) -> DataFrame:
    each = scan_sessions(by_time(held), ["ts", "event_seq"], timeout_seconds).groupBy("session_ip", "session_no")
    return each.agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n_events"), F.sum("bits").alias("bits")).drop("session_no")


def _merged(parts: DataFrame, timeout_seconds: int) -> DataFrame:
    """Sessions of a client that lie within the timeout of each other as one. A row a session and batch, not a request."""
    order = Window.partitionBy("session_ip").orderBy("start_time", "end_time")
    before = F.max("end_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("_new", (before.isNull() | gap_over(before, F.col("start_time"), timeout_seconds)).cast("int"))
    numbered = fresh.withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = numbered.groupBy("session_ip", "_no")
    return each.agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n_events").alias("n_events"), F.sum("bits").alias("bits")).drop("_no")


def close_sessions(out: str, timeout_seconds: int, lateness_seconds: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over scored requests (event_seq, ts, the client's ip, url_bits, status_bits): tables ``closed``, ``open``, ``late`` under ``out``."""
    timeout_us, lateness_us = timeout_seconds * 1_000_000, lateness_seconds * 1_000_000

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = _read(spark, MARKS, f"{out}/marks").where(F.col("epoch") < epoch).orderBy(F.desc("epoch")).first()  # a row a micro-batch
        rows = batch.select(client(batch).alias("session_ip"), "event_seq", "ts", (F.col("url_bits") + F.col("status_bits")).alias("bits"))
        held = stage(rows.where("ts is not null"), "closing")
        passed = None if last is None else last["latest_us"] - lateness_us
        is_late = F.lit(False) if passed is None else F.unix_micros("ts") + timeout_us <= passed
        late = held.where(is_late).select("session_ip", "event_seq", "ts", "bits", ((F.lit(passed) - F.unix_micros("ts")) / 1e6).alias("late_by_seconds"))
        late.write.mode("overwrite").parquet(f"{out}/late/epoch={epoch}")
        still = _read(spark, SESSIONS, f"{out}/open/epoch={last['epoch']}") if last else spark.createDataFrame([], SESSIONS)
        sessions = _merged(_batch_sessions(held.where(~is_late), timeout_seconds).unionByName(still), timeout_seconds)
        newest = held.agg(F.max(F.unix_micros("ts"))).first()[0]
        seen = [x for x in (newest, last and last["latest_us"]) if x is not None]
        latest = max(seen) if seen else None
        over = F.lit(False) if latest is None else F.unix_micros("end_time") + timeout_us <= F.lit(latest - lateness_us)
        sessions.where(over).write.mode("overwrite").parquet(f"{out}/closed/epoch={epoch}")
        sessions.where(~over).write.mode("overwrite").parquet(f"{out}/open/epoch={epoch}")
        if latest is not None:
            spark.range(1).select(F.lit(latest).cast("long").alias("latest_us")).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/epoch={epoch}")

    return each


def closed_sessions(spark: SparkSession, out: str) -> DataFrame:
    """Sessions that can't grow any more, each once: session_ip, start_time, end_time, n_events, information_score."""
    return _scored(_read(spark, SESSIONS, f"{out}/closed"))


def open_sessions(spark: SparkSession, out: str) -> DataFrame:
    """The sessions that were open after the last micro-batch."""
    last = _read(spark, MARKS, f"{out}/marks").agg(F.max("epoch")).first()[0]
    return _scored(spark.createDataFrame([], SESSIONS) if last is None else _read(spark, SESSIONS, f"{out}/open/epoch={last}"))


def late_requests(spark: SparkSession, out: str) -> DataFrame:
    """Requests that no session could take any more, and by how much the watermark had passed them."""
    return spark.read.parquet(f"{out}/late").drop("epoch")


def _scored(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_ip", "start_time", "end_time", "n_events", (F.col("bits") / F.col("n_events")).alias("information_score"))
