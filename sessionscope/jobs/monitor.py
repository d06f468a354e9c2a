"""The live monitor as a job over one log folder.

A first stream follows the growing files, parses each line once and writes it to ``lines``, by outcome. The quarantine and the
counters of every round are views of that table. A second stream scores the kept ones of it: session scores go to ``live``,
and what they change into the table of alerts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sessionscope.operators.categorical import score_requests
from sessionscope.operators.markov import MarkovModel
from sessionscope.operators.staging import stage
from sessionscope.sources.models import Detector, committed_version, load_model
from sessionscope.sources.tail import tail_log_lines
from sessionscope.streaming import live

LINES = (
    "round bigint, event_seq string, source_file string, byte_offset bigint, raw_line string, reason string, ts timestamp, ip string, method string, "
    "normalized_uri string, status_class string, url_group string, status_category string, state_id string, kept boolean"
)
BUCKETS = 64  # of the alert table, by client


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def monitored_lines(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, LINES, f"{out}/lines")


def quarantine(spark: SparkSession, out: str) -> DataFrame:
    """Lines that were not scored: source_file, byte_offset, raw_line, reason."""
    return monitored_lines(spark, out).where("not kept").select(*[c for c in live.QUARANTINE if c != "line_number"])


def counters(spark: SparkSession, out: str) -> DataFrame:
    """A row a round of the monitor: new, malformed, excluded and scored lines."""
    return live.round_counters(monitored_lines(spark, out))


def alert_table(spark: SparkSession, path: str) -> DataFrame:
    """The alert table under ``path``; empty where there is none."""
    return _read(spark, live.ALERTS.format(seq="string") + ", bucket int", path).drop("bucket")


def store_changes(out: str, reference: float | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: its rows go to ``live``, its alert changes into ``alerts``, of which only the buckets of clients with
    changes are written. A batch that runs again writes the same places, and merging the same changes again changes nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        place = f"{out}/live/epoch={epoch}"
        batch.write.mode("overwrite").parquet(place)
        bucket = F.pmod(F.xxhash64("session_ip"), F.lit(BUCKETS)).cast("int")
        changes = spark.read.schema(batch.schema).parquet(place).where("alert_change is not null").withColumn("bucket", bucket)
        touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        held = _read(spark, live.ALERTS.format(seq="string") + ", bucket int", f"{out}/alerts").where(F.col("bucket").isin(touched)).drop("bucket")
        merged = stage(live.merge_alerts(held, changes.drop("bucket"), reference).withColumn("bucket", bucket), "alerts")  # for it is read from where it goes
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/alerts")

    return each


def start_lines(spark: SparkSession, folder: str, out: str, paths: DataFrame, names: DataFrame, fields: tuple[str, ...], once: bool = False, glob: str | None = None) -> StreamingQuery:
    """The stream from the folder to ``lines``. With ``once`` it takes what is there, and ends."""
    judged = live.judge_lines(tail_log_lines(spark, folder, glob=glob), paths, names, fields)
    rows = judged.withColumns({"round": F.substring("event_seq", 1, 17).cast("long"), "kept": F.col("reason").isNull()})
    wanted = [c.split(" ")[0] for c in LINES.split(", ")]
    rows = rows.select(*[c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    writer = rows.writeStream.format("parquet").partitionBy("kept").option("path", f"{out}/lines").outputMode("append").option("checkpointLocation", f"{out}/checkpoints/lines")
    return _start(writer, once)


def start_sessions(spark: SparkSession, detector: Detector, out: str, once: bool = False, state_ttl: str = "1 day") -> StreamingQuery:
    """The stream from ``lines`` to ``live`` and ``alerts``. It can be stopped and started again with another detector of the same
    kind: clients keep their sessions."""
    c, ttl = detector.config, None if once else state_ttl
    kept = spark.readStream.schema(LINES).parquet(f"{out}/lines").where("kept")
    if isinstance(detector.model, MarkovModel):
        scored = live.markov_costs(kept, detector.model, c.timeout_seconds, ttl)
    else:
        scored = score_requests(kept, detector.model, c.mode)
    sessions = live.live_sessions(scored, detector.reference, detector.aep_threshold, c.timeout_seconds, ttl)
    writer = sessions.writeStream.foreachBatch(store_changes(out, detector.reference)).outputMode("append").option("checkpointLocation", f"{out}/checkpoints/live")
    return _start(writer, once)


def _start(writer: DataStreamWriter, once: bool) -> StreamingQuery:
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def start_monitor(
    spark: SparkSession,
    folder: str,
    detector: Detector,
    out: str,
    paths: DataFrame,
    names: DataFrame,
    timeout_seconds: int | None = None,
    once: bool = False,
    glob: str | None = None,
    state_ttl: str = "1 day",
) -> list[StreamingQuery]:
    """Start both streams; tables and checkpoints lie under ``out``. The monitor's timeout must be the model's. ``once`` handles what
    is there and stops."""
    if timeout_seconds not in (None, detector.config.timeout_seconds):
        raise ValueError("the monitor's session timeout differs from the model's")
    lines = start_lines(spark, folder, out, paths, names, detector.config.state_fields, once, glob)
    if not once:
        _await_table(spark, lines, out)
    return [lines, start_sessions(spark, detector, out, once, state_ttl)]


def _await_table(spark: SparkSession, lines: StreamingQuery, out: str) -> None:
    """Until the first stream has made the folder that the second reads."""
    while lines.isActive:
        try:
            spark.read.schema(LINES).parquet(f"{out}/lines")
            return
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            time.sleep(0.2)
    raise RuntimeError(f"the stream of lines has ended: {lines.exception()}")


def keep_monitoring(
    spark: SparkSession, folder: str, model_dir: str, out: str, paths: DataFrame, names: DataFrame, *, poll_seconds: float = 5.0, until: Callable[[], bool] = lambda: False, glob: str | None = None, state_ttl: str = "1 day"
) -> None:
    """Monitor with the last committed model under ``model_dir``; when another version is committed, the scoring stream goes on with it
    between two micro-batches. Runs until ``until`` says so or a stream fails."""
    version = committed_version(spark, model_dir)
    detector = load_model(spark, model_dir, version)
    lines, sessions = start_monitor(spark, folder, detector, out, paths, names, glob=glob, state_ttl=state_ttl)
    try:
        while not until():
            for q in (lines, sessions):
                if not q.isActive:
                    raise RuntimeError(f"a stream of the monitor has ended: {q.exception()}")
            latest = committed_version(spark, model_dir)
            if latest != version:
                detector = load_model(spark, model_dir, latest)
                sessions.stop()
                version, sessions = latest, start_sessions(spark, detector, out, state_ttl=state_ttl)
            time.sleep(poll_seconds)
    finally:
        lines.stop()
        sessions.stop()
