"""Jobs over log folders: prepare, train, evaluate, with a record of every run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.config import SessionConfig
from sessionscope.functions.parse import parse_log_lines, parse_summary
from sessionscope.jobs import detector as jobs
from sessionscope.operators import curate, prepare
from sessionscope.operators.staging import stage
from sessionscope.sources import logs, models


@dataclass
class RouteLists:
    """Routes left out (path; route_name) and the application's own (method, path; route_name)."""

    paths: DataFrame
    route_names: DataFrame
    inventory: DataFrame
    names: DataFrame


def prepare_logs(spark: SparkSession, folder: str, config: SessionConfig, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(prepared events, summary) of a folder's request logs, without the lines' text; lines keep their place in file and folder as event_seq."""
    lines = logs.read_log_lines(spark, folder, "routes", glob, line_numbers=False)
    parsed = stage(parse_log_lines(lines, "routes").drop("raw_line"), "parsed-lines")
    return prepare.preprocess_events(parsed, config.state_fields), prepare.preprocess_summary(parsed)


@dataclass
class Analysis:
    """``parse``: files, ok and bad lines. ``preprocessing``: one row of input, processed and skipped rows by reason, rows without address.
    ``comparison``: per mode sessions, anomalous ones and metrics where labels are given. ``anomalies``: anomalous sessions with
    modes, reasons and details. ``activities``: their requests, each with its file and line."""

    parse: DataFrame
    preprocessing: DataFrame
    comparison: DataFrame
    anomalies: DataFrame
    activities: DataFrame


def analyze_folder(spark: SparkSession, folder: str, model_dir: str, lists: RouteLists, glob: str | None = None) -> Analysis:
    """What a saved detector finds in the request logs of a folder (or in one file), from raw lines to the requests of anomalous sessions."""
    found = models.load_model(spark, model_dir)
    parsed = stage(parse_log_lines(logs.read_log_lines(spark, folder, "routes", glob), "routes"), "parsed-lines")
    flagged = stage(curate.flag_excluded(prepare.preprocess_events(parsed, found.config.state_fields), lists.paths, lists.route_names), "prepared-lines")
    events = flagged.where("not excluded").drop("excluded")
    blank = F.trim(F.coalesce(F.col("ip"), F.lit(""))) == ""
    left_out = flagged.agg(F.count_if("excluded").alias("skipped_excluded_route"), F.count_if(F.col("excluded") & blank).alias("_excluded_blank"))  # one row
    summary = prepare.preprocess_summary(parsed).crossJoin(left_out)
    summary = summary.withColumns(
        {"processed_rows": F.col("processed_rows") - F.col("skipped_excluded_route"), "skipped_rows": F.col("skipped_rows") + F.col("skipped_excluded_route"), "rows_without_ip": F.col("rows_without_ip") - F.col("_excluded_blank")}
    ).drop("_excluded_blank")
    sessions, report = jobs.reported(events, found)
    anomalies, activities = jobs.anomalies_of(sessions, report, found)
    parse = parse_summary(parsed, logs.list_log_files(spark, folder, "routes", glob))
    return Analysis(parse, summary, jobs.metrics_by_mode(sessions, report), anomalies, activities)


def part_of(events: DataFrame, part: str, config: SessionConfig, lists: RouteLists) -> DataFrame:
    return curate.partition_policy(
        events, part, paths=lists.paths, route_names=lists.route_names, inventory=lists.inventory, names=lists.names,
        timeout_seconds=config.timeout_seconds, control=config.session_control, allowlist_in_validation=config.apply_allowlist_to_validation,
    )


def _record(spark: SparkSession, history: str | None, kind: str, model_dir: str, created_at: str, dataset: str | None, config: SessionConfig, result: dict) -> None:
    if history:
        row = (kind, datetime.now(timezone.utc).isoformat(), model_dir, created_at, dataset, json.dumps(asdict(config)), json.dumps(result))
        logs.append_history(spark.createDataFrame([row], logs.HISTORY), history)


# what curation and fitting read of a request; states are made out of the group and the category, for the Markov model alone
ROUTE = ("method", "uri", "normalized_uri", "route_name")
FITTED = ("event_seq", "ts", "ip", "status", "url_group", "status_category")


def _fitted_part(spark: SparkSession, folder: str, part: str, config: SessionConfig, lists: RouteLists, glob: str | None) -> DataFrame:
    state = ("state_id",) if config.model == "markov" else ()
    events = prepare_logs(spark, folder, config, glob)[0].select(*ROUTE, *FITTED, *state)
    return stage(part_of(events, part, config, lists).drop(*ROUTE), f"{part}-events")


def train_from_logs(spark: SparkSession, train_dir: str, validate_dir: str, model_dir: str, config: SessionConfig, lists: RouteLists, *, history: str | None = None, glob: str | None = None) -> models.Detector:
    """Fit on one folder, calibrate on another, save the detector and note the build. Neither folder is split."""
    parts = [_fitted_part(spark, folder, part, config, lists, glob) for folder, part in ((train_dir, "train"), (validate_dir, "validate"))]
    if any(p.isEmpty() for p in parts):
        raise ValueError("both folders must hold valid requests")
    detector = jobs.build(*parts, config)
    models.save_model(detector, model_dir)
    result = {"reference": detector.reference, "aep_threshold": detector.aep_threshold, "density_threshold": detector.density_threshold}
    _record(spark, history, "build", model_dir, detector.created_at, None, config, result)
    return detector


def evaluate_logs(spark: SparkSession, test_dir: str, model_dir: str, lists: RouteLists, *, history: str | None = None, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(comparison, metrics) of a saved detector on a folder, all of whose requests count; labels come from the inventory. Noted in the history."""
    detector = models.load_model(spark, model_dir)
    config = detector.config
    events = stage(part_of(prepare_logs(spark, test_dir, config, glob)[0], "test", config, lists), "test-events")
    comparison, metrics = (stage(df, name) for df, name in zip(jobs.evaluate_requests(events, lists.inventory, lists.names, detector), ("comparison", "metrics"), strict=True))
    rows = {r["mode"]: r.asDict() for r in metrics.collect()}  # a row a mode
    result = {"comparisons": {r["mode"]: {"session_alert_rate": r["alert_rate"], "metrics": rows.get(r["mode"])} for r in comparison.collect()}}
    _record(spark, history, "evaluation", model_dir, detector.created_at, test_dir, config, result)
    return comparison, metrics
