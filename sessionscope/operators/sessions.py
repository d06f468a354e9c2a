"""Sessions, windows and splits of request events (columns ts, event_seq and the client's ip)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.ordering import with_global_index
from sessionscope.operators.segments import by_time, scan_sessions

MISSING_IP = "missing_ip"


def client(df: DataFrame, ip_col: str = "ip") -> Column:
    names = [n for n in (ip_col, "client_ip") if n in df.columns]
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names]
    return F.coalesce(*found, F.lit(MISSING_IP)) if found else F.lit(MISSING_IP)


ADDED = ("session_ip", "session_no", "pos", "n_events", "session_start")


def _numbered(events: DataFrame, timeout_seconds: int, ip_col: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """The requests that have a time, with what the scan tells of each."""
    timed = events.where("ts is not null").withColumn("session_ip", client(events, ip_col)).drop(*ADDED[1:])
    return scan_sessions(by_time(timed), ["ts", "event_seq"], timeout_seconds, flags=flags)


def number_sessions(events: DataFrame, timeout_seconds: int, ip_col: str = "ip") -> DataFrame:
    """Add session_ip and session_no: a client's gap strictly over the timeout starts its next session. Requests without a time belong to
    no session and are left out. A client may send any share of all requests; see ``segments``."""
    return _numbered(events, timeout_seconds, ip_col).drop("pos", "n_events", "session_start", "first_seq")


def ip_sessions(events: DataFrame, timeout_seconds: int, min_events: int = 1, ip_col: str = "ip") -> DataFrame:
    """``number_sessions`` with pos (from 0), n_events and session_start; sessions under min_events are dropped."""
    return _numbered(events, timeout_seconds, ip_col).where(F.col("n_events") >= min_events).drop("first_seq")


def tainted_sessions(events: DataFrame, flag: str, timeout_seconds: int, ip_col: str = "ip") -> DataFrame:
    """Requests that have a time, with _tainted: whether the boolean column ``flag`` holds anywhere in their session."""
    numbered = _numbered(events, timeout_seconds, ip_col, (flag,))
    return numbered.withColumnRenamed(f"any_{flag}", "_tainted").drop("pos", "n_events", "session_start", "first_seq", "session_no")


def fixed_count_windows(events: DataFrame, size: int, include_partial: bool = False) -> DataFrame:
    """Add window_no and pos: all events in time order cut every ``size``; a short last window only if asked for."""
    indexed = with_global_index(events, [F.col("ts"), F.col("event_seq")], "_idx")
    cut = indexed.withColumns({"window_no": F.floor(F.col("_idx") / size), "pos": (F.col("_idx") % size).cast("int")})
    if not include_partial:
        cut = cut.where(F.col("window_no") < events.count() // size)
    return cut.drop("_idx")


def fixed_time_windows(events: DataFrame, size_seconds: int) -> DataFrame:
    """Add window_no: tumbling windows anchored at the first event. Empty ones don't appear, so numbers may have gaps."""
    start = events.agg(F.min(F.unix_micros("ts")).alias("m")).first()["m"]
    at = F.unix_micros("ts") - F.lit(start or 0)
    return events.withColumn("window_no", F.floor(at / (size_seconds * 1_000_000)))


def session_records(sessions: DataFrame) -> DataFrame:
    """A row a session: start, end, number of events, ordered states. For what is reported, not for what is scored."""
    item = F.struct("ts", "event_seq", "state_id")
    return sessions.groupBy("session_ip", "session_no").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").cast("int").alias("n_events"),
        F.min(F.struct("ts", "event_seq")).alias("first_event"),
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["state_id"]).alias("states"),
    )


def window_records(records: DataFrame) -> DataFrame:
    """Number session records densely from 0 by their first event."""
    order = [F.col("first_event.ts"), F.col("first_event.event_seq")]
    return with_global_index(records, order, "window_id")


def split_bounds(n: int, training: float, validation: float) -> tuple[int, int]:
    """First position of validation and of test; no part may be empty."""
    first, second = int(n * training), int(n * training) + int(n * validation)
    if not 0 < first < second < n:
        raise ValueError(f"{n} rows leave an empty part")
    return first, second


def split_by_position(df: DataFrame, order: list[Column], training: float = 0.65, validation: float = 0.15) -> DataFrame:
    """Add split (training, validation, testing) by position in the given ascending order. For windows and for events alike.

    Only the order's columns are sorted, to find the first key of validation and of test; rows are then told apart by key, where
    they are. Rows of equal keys are in one part, so the order should be total.
    """
    keys = with_global_index(df.select(F.struct(*order).alias("_key")), [F.col("_key")], "_idx")
    first, second = split_bounds(keys.count(), training, validation)
    at = lambda i: F.max(F.when(F.col("_idx") == i, F.col("_key")))
    edges = keys.where(F.col("_idx").isin(first, second)).agg(at(first).alias("_validation"), at(second).alias("_testing"))  # one row
    key = F.struct(*order)
    part = F.when(key < F.col("_validation"), "training").when(key < F.col("_testing"), "validation").otherwise("testing")
    return df.crossJoin(F.broadcast(edges)).withColumn("split", part).drop("_validation", "_testing")
