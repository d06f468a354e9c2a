"""Which requests are the application's own: exclusions, inventory, quarantine of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.routes import bound
from sessionscope.operators.sessions import tainted_sessions
from sessionscope.operators.staging import stage

BLANKS = " \t\n\x0b\f\r"


def stripped(c: Column) -> Column:
    """What ``routes.stripped`` gives, without a match; lists are looked up for every request."""
    return F.btrim(c, F.lit(BLANKS))


def clean_path(path: Column) -> Column:
    """A path up to the query, without blanks around it or slashes behind it; '/' if nothing is left."""
    bare = F.rtrim(stripped(F.substring_index(stripped(path), "?", 1)), F.lit("/"))
    return bound(bare, lambda b: F.when(b == "", "/").otherwise(b))


def route_path(df: DataFrame) -> Column:
    """The clean path of normalized_uri, else of uri."""
    names = [F.nullif(F.col(n), F.lit("")) for n in ("normalized_uri", "uri") if n in df.columns]
    return clean_path(F.coalesce(*names, F.lit("")))


def _route_name(df: DataFrame) -> Column:
    return stripped(F.coalesce(F.col("route_name"), F.lit(""))) if "route_name" in df.columns else F.lit("")


def _listed_names(names: DataFrame, mark: str) -> DataFrame:
    return names.select(stripped(F.col("route_name")).alias("_n")).where("_n <> ''").distinct().withColumn(mark, F.lit(True))


def flag_excluded(events: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
    """Add excluded: whether the path or the route name is in a list. ``paths`` has a column path, ``names`` a column route_name;
    blank entries list nothing."""
    bad_paths = paths.where(stripped(F.col("path")) != "").select(clean_path(F.col("path")).alias("_p")).distinct().withColumn("_bad_path", F.lit(True))
    keyed = events.withColumns({"_path": route_path(events), "_name": _route_name(events)})
    joined = keyed.join(bad_paths, F.col("_path") == F.col("_p"), "left").join(_listed_names(names, "_bad_name"), F.col("_name") == F.col("_n"), "left")
    flag = F.coalesce("_bad_path", "_bad_name", F.lit(False))
    return joined.withColumn("excluded", flag).drop("_path", "_name", "_p", "_n", "_bad_path", "_bad_name")


def exclude_routes(events: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose path and route name are in neither list."""
    return flag_excluded(events, paths, names).where("not excluded").drop("excluded")


def allowlist_flag(events: DataFrame, inventory: DataFrame, names: DataFrame) -> DataFrame:
    """Add by_path and by_name: whether (any method or this one, path), or the exact route name, is in the inventory."""
    pairs = inventory.select(F.upper(stripped(F.col("method"))).alias("_m"), clean_path(F.col("path")).alias("_p"))
    pairs = pairs.groupBy("_p").agg(F.collect_set("_m").alias("_methods"))
    keyed = events.withColumns({"_path": route_path(events), "_name": _route_name(events), "_verb": F.upper(stripped(F.coalesce(F.col("method"), F.lit(""))))})
    joined = keyed.join(pairs, F.col("_path") == F.col("_p"), "left").join(_listed_names(names, "_listed"), F.col("_name") == F.col("_n"), "left")
    by_path = F.coalesce(F.array_contains("_methods", F.lit("*")) | F.array_contains("_methods", F.col("_verb")), F.lit(False))
    return joined.withColumns({"by_path": by_path, "by_name": F.coalesce("_listed", F.lit(False))}).drop("_path", "_name", "_verb", "_p", "_methods", "_n", "_listed")


def curate(events: DataFrame, inventory: DataFrame, names: DataFrame, *, enabled: bool = True) -> DataFrame:
    """Add classification (normal or review) and reason. Disabled: everything is normal. Enabled with nothing listed is an error."""
    if not enabled:
        return events.withColumns({"classification": F.lit("normal"), "reason": F.lit("curation_disabled")})
    if inventory.isEmpty() and names.isEmpty():
        raise ValueError("the inventory is empty; list routes or disable curation")
    flagged = allowlist_flag(events, inventory, names)
    reason = F.when(F.col("by_name"), "allowlisted_route_name").when(F.col("by_path"), "allowlisted_method_path").otherwise("endpoint_not_in_application_allowlist")
    label = F.when(F.col("by_name") | F.col("by_path"), "normal").otherwise("review")
    return flagged.withColumns({"classification": label, "reason": reason}).drop("by_path", "by_name")


def session_control(curated: DataFrame, timeout_seconds: int, ip_col: str = "ip") -> DataFrame:
    """A client's whole inactivity session goes to review with any of its requests; rows without a time keep their own class."""
    curated = stage(curated, "curated")  # read several times below
    flagged = tainted_sessions(curated.withColumn("_review", F.col("classification") == "review"), "_review", timeout_seconds, ip_col)
    marked = flagged.withColumns(
        {"classification": F.when(F.col("_tainted"), "review").otherwise(F.col("classification")), "reason": F.when(F.col("_tainted"), "session_contains_unallowlisted_route").otherwise(F.col("reason"))}
    )
    return marked.select(*curated.columns).unionByName(curated.where("ts is null"))


def curation_summary(curated: DataFrame) -> DataFrame:
    return curated.groupBy("classification", "reason").agg(F.count("*").alias("n_requests"))


def partition_policy(events: DataFrame, part: str, *, paths: DataFrame, route_names: DataFrame, inventory: DataFrame, names: DataFrame, timeout_seconds: int, control: bool = True, allowlist_in_validation: bool = True) -> DataFrame:
    """The requests a part may use. train: exclude, curate, keep normal; validate: the same or exclusions only; upload: exclusions only; test, detect: all."""
    if part in ("test", "detect"):
        return events
    kept = exclude_routes(events, paths, route_names)
    if part == "upload" or (part == "validate" and not allowlist_in_validation):
        return kept
    if part not in ("train", "validate"):
        raise ValueError(f"unknown part {part}")
    curated = curate(kept, inventory, names)
    if control:
        curated = session_control(curated, timeout_seconds)
    return curated.where("classification = 'normal'").drop("classification", "reason")


def state_catalog(events: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Every state id with its description and the number of descriptions found (more than one is a conflict). ``allowed`` limits the ids."""
    chosen = events if allowed is None else events.join(allowed.select("state_id").distinct(), "state_id", "left_semi")
    return chosen.groupBy("state_id").agg(F.min("state_description").alias("state_description"), F.countDistinct("state_description").alias("descriptions"))


def check_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog itself; an error when one id has two descriptions."""
    bad = catalog.where("descriptions > 1").limit(1).collect()
    if bad:
        raise ValueError(f"state {bad[0]['state_id']} has more than one description")
    return catalog
