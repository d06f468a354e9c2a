"""Summaries for people: frequent routes, status counts, a timeline, ranked experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOWER_IS_BETTER = ("clean_alert_rate",)


def top_routes(events: DataFrame, n: int = 8) -> DataFrame:
    """The n most frequent paths, ties by first appearance."""
    counts = events.groupBy("normalized_uri").agg(F.count("*").alias("requests"), F.min(F.struct("ts", "event_seq")).alias("first_seen"))
    return counts.orderBy(F.desc("requests"), "first_seen").limit(n).select("normalized_uri", "requests")


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status_class").agg(F.count("*").alias("requests"))


def score_timeline(sessions: DataFrame, n: int = 30) -> DataFrame:
    """The latest n sessions by start, with score, reference and decision."""
    return sessions.orderBy(F.desc("start_time"), F.desc("session_ip"), F.desc("session_no")).limit(n)


def rank_experiments(history: DataFrame, mode: str, metric: str) -> DataFrame:
    """Evaluations with the last build of their model, best first, those without the metric last.

    ``history`` has seq (order of recording), type, model_dir, model_created_at, timestamp, dataset, and parameters and
    result as JSON text. Evaluations without a build stay. A null creation time matches a null one.
    """
    path = f"$.comparisons.{mode}." + ("session_alert_rate" if metric == "clean_alert_rate" else f"metrics.{metric}")
    last = Window.partitionBy("model_dir", "model_created_at").orderBy(F.desc("seq"))
    builds = history.where("type = 'build'").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    builds = builds.select(F.col("model_dir").alias("_dir"), F.col("model_created_at").alias("_at"), F.col("parameters").alias("_parameters"))
    evaluations = history.where("type = 'evaluation'")
    joined = evaluations.join(builds, F.col("model_dir").eqNullSafe(F.col("_dir")) & F.col("model_created_at").eqNullSafe(F.col("_at")), "left")
    score = F.get_json_object("result", path).try_cast("double")
    out = joined.select("seq", score.alias("score"), F.lit(mode).alias("mode"), F.lit(metric).alias("metric"), "model_dir", "model_created_at", F.col("timestamp").alias("evaluated_at"), "dataset", F.coalesce("_parameters", "parameters").alias("parameters"))
    order = F.asc_nulls_last("score") if metric in LOWER_IS_BETTER else F.desc_nulls_last("score")
    return out.orderBy(order, "seq")


def list_alerts(alerts: DataFrame, limit: int = 100, text: str = "") -> DataFrame:
    """Newest first by update (else creation), then id; the limit is held within 1 and 1000; text is looked for in any column, without case."""
    found = alerts
    if text:
        found = alerts.where(F.contains(F.lower(F.to_json(F.struct(*alerts.columns))), F.lit(text.lower())))
    return found.orderBy(F.coalesce("updated_at", "created_at").desc(), F.desc("alert_id")).limit(max(1, min(1000, limit)))


def acknowledge_alerts(alerts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Set acknowledged where the latest acknowledgement of an alert (alert_id, at, acknowledged) is not older than its last update."""
    latest = acknowledgements.groupBy("alert_id").agg(F.max("at").alias("_at"), F.max_by("acknowledged", "at").alias("_ack"))
    joined = alerts.join(latest, "alert_id", "left")
    fresh = F.col("_at") >= F.coalesce("updated_at", "created_at")
    return joined.withColumn("acknowledged", F.when(fresh, F.col("_ack")).otherwise(F.col("acknowledged"))).drop("_at", "_ack")
