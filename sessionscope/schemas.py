"""Columns of the tables that the jobs hand over."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Message before the payload, and the keys a payload must have.
LOG_TYPES = {
    "routes": (("Route request completed.",), ("method", "route_name", "uri", "status", "ip")),
    "controllers": (("Controller request completed.",), ("controller_action", "status")),
    "services": (("Service operation completed.", "Service entry operation completed."), ("operation",)),
}

PREPARED = ("ts", "event_seq", "ip", "method", "normalized_uri", "status_class", "url_group", "status_category", "state_id")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself; an error names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df
