"""Batch jobs: build a detector, score sessions with it, evaluate it, analyse a new log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.config import SessionConfig
from sessionscope.operators import categorical, curate, density, evaluate, markov, scoring, thresholds
from sessionscope.operators.sessions import ip_sessions
from sessionscope.operators.staging import stage
from sessionscope.sources.models import Detector

KEY = list(categorical.SESSION_KEY)
Model = categorical.CategoricalModel | markov.MarkovModel


def fit_model(sessions: DataFrame, config: SessionConfig) -> tuple[Model, float]:
    """The configured model of training sessions and the bits a request that it expects."""
    if config.model == "markov":
        chain = markov.fit_markov(sessions, config.smoothing)
        return chain, markov.entropy_rate(chain, markov.stationary(chain))
    model = categorical.fit_categorical(sessions, config.smoothing)
    return model, model.entropies()[config.mode]


def build(training: DataFrame, validation: DataFrame, config: SessionConfig) -> Detector:
    """Fit on the training events, calibrate every threshold on the validation events (both curated: ts, event_seq, ip, and
    url_group and status_category, or state_id for the Markov model). Both tables are scored once, and all cut-offs come from one pass."""
    train = stage(ip_sessions(training, config.timeout_seconds, config.min_events), "train-sessions")
    model, reference = fit_model(train, config)
    scored_train = stage(session_scores(train, model, config.mode), "train-scores")
    check = ip_sessions(validation, config.timeout_seconds, config.min_events)
    kde = density.kde_fit(scored_train, config.bandwidth, config.epsilon)
    far = F.abs(F.col("information_score") - F.lit(reference))
    both = lambda df: density.kde_score(df.withColumn("aep_deviation", far), kde)
    fusion = thresholds.component_stats(both(scored_train), config.alpha)
    scored_check = thresholds.fusion_score(both(session_scores(check, model, config.mode)), fusion)
    cuts = thresholds.quantiles(
        scored_check,
        {
            "aep": (F.col("aep_deviation"), (config.aep_quantile,)),
            "density": (F.col("density_score"), (config.density_quantile,)),
            "hybrid": (F.col("hybrid_score"), (config.warning_quantile, config.critical_quantile)),
        },
    )
    fusion = thresholds.with_cuts(fusion, *cuts["hybrid"])
    return Detector(config, model, reference, cuts["aep"][0], kde, cuts["density"][0], fusion, datetime.now(timezone.utc).isoformat())


def score_parts(sessions: DataFrame, model: Model, mode: str) -> DataFrame:
    """Every request with what it costs: bits of group and category, or the probability of the step (p)."""
    if isinstance(model, markov.MarkovModel):
        return markov.score_steps(sessions, model)
    return categorical.score_requests(sessions, model, mode)


def session_scores(sessions: DataFrame, model: Model, mode: str) -> DataFrame:
    parts = score_parts(sessions, model, mode)
    return markov.score_sequences(parts) if isinstance(model, markov.MarkovModel) else categorical.score_sessions(parts)


def report_sessions(sessions: DataFrame, detector: Detector) -> DataFrame:
    """The score report of numbered sessions: a row a session and mode."""
    scores = session_scores(sessions, detector.model, detector.config.mode)
    scores = density.kde_score(thresholds.aep_decision(scores, detector.reference, detector.aep_threshold), detector.density)
    return scoring.score_report(thresholds.fusion_score(scores, detector.fusion), detector.density_threshold, detector.fusion)


def detect(events: DataFrame, detector: Detector, min_events: int | None = None) -> DataFrame:
    """The score report of all sessions of ``events``: a row a session and mode."""
    c = detector.config
    return report_sessions(ip_sessions(events, c.timeout_seconds, c.min_events if min_events is None else min_events), detector)


def evaluate_events(events: DataFrame, labels: DataFrame, detector: Detector) -> tuple[DataFrame, DataFrame]:
    """(comparison of the modes, metrics of each) against session labels (session key, label): confusion and areas under the
    ROC and the precision-recall curve."""
    report = stage(detect(events, detector).join(labels, KEY), "evaluation")
    return evaluate.mode_comparison(report), metrics_of(report)


def metrics_of(units: DataFrame) -> DataFrame:
    """Per mode, of units with label, anomalous and mode_score: confusion, ratios, roc_auc, pr_auc (ties in session order)."""
    units = units.withColumn("decision", F.col("anomalous"))
    areas = evaluate.rank_areas(units, "mode", [F.col(c) for c in ("start_time", *KEY)], "mode_score")
    return evaluate.confusion(units, "mode").join(areas, "mode")


def evaluate_requests(events: DataFrame, inventory: DataFrame, names: DataFrame, detector: Detector) -> tuple[DataFrame, DataFrame]:
    """``evaluate_events`` with labels from the inventory: a request is positive outside it, a session with any such request.

    Units of the metrics are sessions or, if the configuration counts requests, requests with their session's score and decision.
    """
    c = detector.config
    sessions = stage(curate.allowlist_flag(ip_sessions(events, c.timeout_seconds, c.min_events), inventory, names), "evaluated")
    labels = evaluate.allowlist_labels(sessions)
    report = stage(report_sessions(sessions, detector).join(labels, KEY), "evaluation")
    comparison = evaluate.mode_comparison(report).join(report.groupBy("mode").agg(F.sum("n_outside").alias("requests_outside")), "mode")
    if c.counting_unit == "session":
        return comparison, metrics_of(report)
    flagged = sessions.select(*KEY, "pos", (~(F.col("by_path") | F.col("by_name"))).alias("label"))
    units = report.drop("label").join(flagged, KEY)
    return comparison, metrics_of(units)


ACTIVITY = ("source_file", "line_number", "event_seq", "ts", "ip", "method", "uri", "normalized_uri", "status", "status_class", "url_group", "status_category", "state_id", "raw_line")


def analyze_log(events: DataFrame, detector: Detector, paths: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """``analyze_requests`` without the activities."""
    return analyze_requests(events, detector, paths, names)[0]


def analyze_requests(events: DataFrame, detector: Detector, paths: DataFrame | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(anomalous sessions, their activities). The anomalous sessions of one new log: the modes that say so, their reasons, what of them was never seen, and each request's
    costs in order; for the Markov model its steps' probabilities and the least probable transitions. Activities are the requests of
    these sessions, a row each with its place (pos) and what of ``ACTIVITY`` the events have.

    Routes in ``paths`` and ``names`` are left out first. Requests are collected per session only here, after the filter.
    """
    sessions, report = reported(_without(events, paths, names), detector)
    return anomalies_of(sessions, report, detector)


def reported(events: DataFrame, detector: Detector) -> tuple[DataFrame, DataFrame]:
    """(requests with their sessions, score report), each written once for all that reads them."""
    c = detector.config
    sessions = stage(ip_sessions(events, c.timeout_seconds, c.min_events), "analyzed")
    return sessions, stage(report_sessions(sessions, detector), "report")


def anomalies_of(sessions: DataFrame, report: DataFrame, detector: Detector) -> tuple[DataFrame, DataFrame]:
    """``analyze_requests`` of what ``reported`` gives."""
    found = report.where("anomalous").groupBy(*KEY).agg(
        F.array_sort(F.collect_list("mode")).alias("modes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        F.first("information_score").alias("information_score"),
        F.first("n_events").alias("n_events"),
    )
    found = stage(found, "anomalies")
    theirs = sessions.join(found.select(*KEY), KEY, "left_semi")
    flagged = score_parts(theirs, detector.model, detector.config.mode)
    return found.join(scoring.session_details(flagged), KEY), theirs.select(*KEY, "pos", *[n for n in ACTIVITY if n in theirs.columns])


def _without(events: DataFrame, paths: DataFrame | None, names: DataFrame | None) -> DataFrame:
    if paths is None or names is None:
        return events
    return curate.exclude_routes(events, paths, names)


def labelled_metrics(events: DataFrame, detector: Detector, paths: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Per mode: sessions, anomalous ones, and, where the log says which are anomalies, metrics over the sessions it says so of.

    Labels stand in the columns is_anomaly, label or ground_truth; a session counts if all its requests have one. Without
    any, the metrics are null.
    """
    return metrics_by_mode(*reported(_without(events, paths, names), detector))


def metrics_by_mode(sessions: DataFrame, report: DataFrame) -> DataFrame:
    """``labelled_metrics`` of what ``reported`` gives."""
    if any(n in sessions.columns for n in evaluate.LABELS):
        report = stage(report.join(evaluate.given_labels(sessions), KEY), "analysis")
    else:  # no request says anything, so none is asked
        report = report.withColumn("label", F.lit(None).cast("boolean"))
    counts = report.groupBy("mode").agg(F.count("*").alias("sessions"), F.count_if("anomalous").alias("anomalous_sessions"))
    return counts.join(metrics_of(report.where("label is not null")), "mode", "left")
