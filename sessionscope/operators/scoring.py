"""Reports of scored sessions: decisions in three modes with reasons, and what was never seen in training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.categorical import SESSION_KEY
from sessionscope.operators.thresholds import FusionCalibration, severity

MODES = ("aep", "density", "hybrid")

# Texts of the reasons.
REASON_AEP = "normalized information score deviates from the learned entropy reference"
REASON_DENSITY = "information score lies beyond the validation density threshold"
REASON_HYBRID = "fused normalized AEP/KDE score reached {} severity"


def score_report(scores: DataFrame, density_threshold: float, fusion: FusionCalibration) -> DataFrame:
    """A row for every session and mode. ``scores`` has both component scores, aep_anomalous and hybrid_score.

    One pass: sessions are scored once and the modes are projections of that row.
    """
    rows = scores.withColumns({"density_anomalous": F.col("density_score") > F.lit(density_threshold), "severity": severity(F.col("hybrid_score"), fusion)})
    modes = rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    hybrid = F.col("mode") == "hybrid"
    loud = hybrid & (F.col("severity") != "NORMAL")
    final = F.when(F.col("mode") == "aep", F.col("aep_anomalous")).when(F.col("mode") == "density", F.col("density_anomalous")).otherwise(F.col("severity") != "NORMAL")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("mode").isin("aep", "hybrid") & F.col("aep_anomalous"), REASON_AEP),
            F.when(F.col("mode").isin("density", "hybrid") & F.col("density_anomalous"), REASON_DENSITY),
            F.when(loud, F.format_string(REASON_HYBRID.replace("{}", "%s"), F.lower("severity"))),
        )
    )
    chosen = F.when(F.col("mode") == "aep", F.col("aep_deviation")).when(F.col("mode") == "density", F.col("density_score")).otherwise(F.col("hybrid_score"))
    return modes.withColumns({"anomalous": final, "mode_score": chosen}).withColumns(
        {"reasons": F.when(F.col("anomalous"), reasons).otherwise(F.array().cast("array<string>")), "severity": F.when(hybrid, F.col("severity"))}
    )


def novelty_report(scored_requests: DataFrame) -> DataFrame:
    """Requests with an unseen group or category: their session, position and what was unseen."""
    return scored_requests.where("unknown_url or unknown_status").select(*SESSION_KEY, "pos", "event_seq", "url_group", "status_category", "unknown_url", "unknown_status")


def novelty_counts(scored_requests: DataFrame) -> DataFrame:
    """Per session: requests with something unseen, by kind, and whether there are any."""
    return scored_requests.groupBy(*SESSION_KEY).agg(
        F.count_if(F.col("unknown_url") | F.col("unknown_status")).alias("unknown_events"),
        F.count_if("unknown_url").alias("unknown_urls"),
        F.count_if("unknown_status").alias("unknown_statuses"),
        F.bool_or(F.col("unknown_url") | F.col("unknown_status")).alias("novelty_detected"),
    )


def session_details(scored: DataFrame, least: int = 5) -> DataFrame:
    """What the record of a reported session adds to its scores, from its scored requests; for sessions that are reported, so
    collect after the filter.

    ``unknown_events`` (pos, state_description or what was unseen). Categorical: url_bits and status_bits in order. Markov:
    probabilities of the steps in order and the ``least`` least probable transitions.
    """
    in_order = lambda *cols: F.array_sort(F.collect_list(F.struct("pos", *cols)))
    take = lambda items, c: F.transform(items, lambda x: x[c])
    if "p" in scored.columns:
        known_as = F.struct("pos", F.col("state_id").alias("state"))
        step = F.struct("p", "pos", F.col("previous_state").alias("from_state"), F.col("scored_state").alias("to_state"))
        return scored.groupBy(*SESSION_KEY).agg(
            F.array_sort(F.collect_list(F.when(F.col("unknown_state"), known_as))).alias("unknown_events"),
            take(F.filter(in_order("p", "previous_state"), lambda x: x["previous_state"].isNotNull()), "p").alias("transition_probabilities"),
            F.slice(F.array_sort(F.collect_list(F.when(F.col("previous_state").isNotNull(), step))), 1, least).alias("least_probable_transitions"),
        )
    unseen = F.struct("pos", "url_group", "status_category", "unknown_url", "unknown_status")
    return scored.groupBy(*SESSION_KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("unknown_url") | F.col("unknown_status"), unseen))).alias("unknown_events"),
        take(in_order("url_bits", "status_bits"), "url_bits").alias("url_bits"),
        take(in_order("url_bits", "status_bits"), "status_bits").alias("status_bits"),
    )
