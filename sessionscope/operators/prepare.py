"""Parsed request rows to prepared events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions import routes
from sessionscope.functions.parse import step
from sessionscope.schemas import require_columns


def event_time(text: Column) -> Column:
    """ISO date and time as an instant; without a zone it is UTC; anything else is null."""
    t = routes.stripped(text)
    zoned = t.rlike(r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})\z")
    return F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))))


def with_states(events: DataFrame, fields: tuple[str, ...] = ("url_group", "status_category"), uri_col: str = "uri", status_col: str = "status", method_col: str = "method") -> DataFrame:
    """Add normalized_uri, url_group, status_class, status_category, state_description and state_id."""
    out = events.withColumn("normalized_uri", routes.normalize_uri(F.col(uri_col)))
    out = out.withColumns({"url_group": routes.url_group(F.col("normalized_uri")), "status_class": routes.status_class(F.col(status_col)), "status_category": routes.status_category(F.col(status_col))})
    out = out.withColumn("state_description", routes.describe_state(F.col(method_col), F.col("url_group"), F.col("status_category"), fields))
    return out.withColumn("state_id", routes.state_id(F.col("state_description")))


def _skip_reason(parsed: DataFrame) -> DataFrame:
    require_columns(parsed, "timestamp", "method", "uri", "status", "parse_status")
    bad_status = F.coalesce(F.col("parse_status"), F.lit("")) != "ok"
    timed = step(parsed.drop("ts"), ts=event_time(F.col("timestamp")))
    return timed.withColumn("skip_reason", F.when(bad_status, "parse_status").when(F.col("ts").isNull(), "invalid_timestamp"))


def preprocess_events(parsed: DataFrame, fields: tuple[str, ...] = ("url_group", "status_category")) -> DataFrame:
    """Rows with parse_status ok and a valid time, methods in upper case, with states. Rows keep no order."""
    kept = _skip_reason(parsed).where("skip_reason is null").drop("skip_reason")
    verb = F.upper(routes.stripped(F.coalesce(F.col("method"), F.lit(""))))
    stated = with_states(kept, fields)
    return stated.withColumn("method", F.when(verb == "", "UNKNOWN").otherwise(verb))


def preprocess_summary(parsed: DataFrame) -> DataFrame:
    """One row: input, kept and skipped rows, skipped by reason, kept rows without an address."""
    kept = F.col("skip_reason").isNull()
    blank = F.trim(F.coalesce(F.col("ip"), F.lit(""))) == "" if "ip" in parsed.columns else F.lit(True)
    return _skip_reason(parsed).agg(
        F.count("*").alias("input_rows"),
        F.count_if(kept).alias("processed_rows"),
        F.count_if(~kept).alias("skipped_rows"),
        F.count_if(F.col("skip_reason") == "parse_status").alias("skipped_parse_status"),
        F.count_if(F.col("skip_reason") == "invalid_timestamp").alias("skipped_invalid_timestamp"),
        F.count_if(kept & blank).alias("rows_without_ip"),
    )


def upgrade_states(events: DataFrame, fields: tuple[str, ...] = ("url_group", "status_category")) -> DataFrame:
    """State ids of an older event table: from its description, else its columns, else its URI and status.

    A field that the description lacks comes from the column of that name, else it is 'unknown'.
    """
    have = set(events.columns)
    col = lambda n: F.nullif(F.col(n), F.lit("")) if n in have else F.lit(None).cast("string")
    described = F.from_json(col("state_description"), "map<string,string>")
    has_columns = col("url_group").isNotNull() | col("status_category").isNotNull()
    old = {n: col(n) for n in ("method", "url_group", "status_category")}
    computed = {"method": F.upper(col("method")), "url_group": routes.url_group(routes.normalize_uri(F.coalesce(col("uri"), col("normalized_uri")))), "status_category": routes.status_category(F.coalesce(col("status"), F.lit("")))}
    pick = {}
    for n in ("method", "url_group", "status_category"):
        from_description = F.coalesce(F.try_element_at(described, F.lit(n)), old[n], F.lit(routes.UNKNOWN))
        from_columns = F.coalesce(old[n], F.lit(routes.UNKNOWN))
        pick[n] = F.when(described.isNotNull(), from_description).when(has_columns, from_columns).otherwise(F.coalesce(computed[n], F.lit(routes.UNKNOWN)))
    description = routes.describe_state(pick["method"], pick["url_group"], pick["status_category"], fields)
    keep = [c for c in events.columns if c not in ("state_description", "state_id")]
    return events.select(*keep, description.alias("state_description")).withColumn("state_id", routes.state_id(F.col("state_description")))
