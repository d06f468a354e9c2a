"""The live monitor's streams: parse lines, keep sessions per client, raise and resolve alerts, quarantine bad lines.

Costs add up, so a session's state is a handful of numbers, however long it runs; it lies in the RocksDB state store. Every stateful
function has a batch twin, which gives the same rows for the same arrivals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionscope.functions.parse import parse_log_lines
from sessionscope.operators.categorical import UNSEEN
from sessionscope.operators.curate import flag_excluded
from sessionscope.operators.markov import MarkovModel
from sessionscope.operators.prepare import event_time, with_states
from sessionscope.operators.scoring import REASON_AEP
from sessionscope.operators.segments import by_range, scan_sessions
from sessionscope.operators.sessions import client
from sessionscope.operators.staging import stage
from sessionscope.sources.logs import log_glob


def live_schema(seq: str = "bigint") -> str:
    """Columns of the live table; ``seq`` is the type of event_seq. (session_ip, session_start, first_seq) names a session for good:
    session_no begins again when a client's state has gone."""
    return (
        f"session_ip string, session_start timestamp, first_seq {seq}, session_no int, event_seq {seq}, ts timestamp, "
        "n_events int, information_score double, anomalous boolean, alert_change string, n_unseen int"
    )


LIVE = live_schema()
SESSION = ("session_ip", "session_start", "first_seq")


STATE = "last_us bigint, last_seq {seq}, start_us bigint, first_seq {seq}, session_no int, n_events int, bits double, alert_open boolean, n_unseen int"


def stream_log_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """Request lines of new files: raw_line, source_file, event_seq. Whole files as they appear; ``sources.tail`` follows files that grow.

    event_seq is text that sorts by file name, block start and place in the block, the order in which lines came. Places are
    counted while a task reads its split; nothing is moved.
    """
    stream = spark.readStream.option("pathGlobFilter", glob or log_glob("routes")).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    lines = stream.select(F.col("value").alias("raw_line"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            names, blocks = b.column(1).to_pylist(), b.column(2).to_pylist()
            seq = [f"{n.lower()}:{k:015d}:{i:012d}" for i, (n, k) in enumerate(zip(names, blocks, strict=True), at)]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seq, pa.string())], names=["raw_line", "source_file", "event_seq"])

    return lines.mapInArrow(number, "raw_line string, source_file string, event_seq string")


def judge_lines(lines: DataFrame, paths: DataFrame, names: DataFrame, fields: tuple[str, ...] = ("url_group", "status_category")) -> DataFrame:
    """Every line of a stream or a batch, parsed, with ``reason``: null where it is kept, else the parse status, invalid_timestamp, or
    excluded_route. The batch functions, line by line."""
    parsed = parse_log_lines(lines, "routes").withColumn("ts", event_time(F.col("timestamp")))
    stated = with_states(parsed, fields)
    reason = F.when(F.col("parse_status") != "ok", F.col("parse_status")).when(F.col("ts").isNull(), "invalid_timestamp")
    marked = flag_excluded(stated.withColumn("reason", reason), paths, names)
    return marked.withColumn("reason", F.coalesce("reason", F.when(F.col("excluded"), "excluded_route"))).drop("excluded")


QUARANTINE = ("source_file", "line_number", "byte_offset", "raw_line", "reason")


def stream_parse(lines: DataFrame, paths: DataFrame, names: DataFrame, fields: tuple[str, ...] = ("url_group", "status_category")) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of a stream or a batch of lines. The quarantine keeps the raw line with its file, its place there (what of
    line_number and byte_offset the lines have) and the reason; one reason decides for both sides."""
    marked = judge_lines(lines, paths, names, fields)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select(*[c for c in QUARANTINE if c in marked.columns])


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store; streams that are started from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


CHUNK = 8192  # rows of a client that are worked on, and given out, at a time


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """A client's arrivals of one trigger by event_seq, a chunk at a time. They are held packed, a few dozen bytes each, for the
    shuffle brings them in any order."""
    tables = [pa.Table.from_pandas(f[columns], preserve_index=False) for f in frames]
    held = pa.concat_tables(tables)
    order = pc.sort_indices(held["event_seq"])
    for at in range(0, held.num_rows, CHUNK):
        part = held.take(order.slice(at, CHUNK))
        yield list(zip(*[part[c].to_pylist() for c in columns], strict=True))


class _PerClient(StatefulProcessor):
    """A client's state as one value, forgotten ``ttl_ms`` after its last arrival by a processing-time timer."""

    state_schema: str

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("client", self.state_schema)

    def _keep(self, state: tuple, now_ms: int) -> None:
        self.value.update(state)
        if self.ttl_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now_ms + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def advance(reference: float, threshold: float, timeout_us: int) -> Callable[[tuple, list[tuple]], tuple[tuple, list[tuple]]]:
    """One client's arrivals (event_seq, microseconds, bits, 1 if something of it was never seen in training else 0) against its state; gives
    the new state and a row an arrival, and a row for every alert resolved."""

    def run(state: tuple, arrivals: list[tuple]) -> tuple[tuple, list[tuple]]:
        last, last_seq, start, first, no, n, bits, alert, unseen = state
        out = []
        for seq, us, cost, new in arrivals:
            if last is not None and us - last > timeout_us:
                if alert:
                    out.append((start, first, no, seq, us, n, None, None, "resolved", unseen))
                no, n, bits, alert, unseen = no + 1, 0, 0.0, False, 0
            if n == 0:
                start, first = us, seq
            n, bits, unseen, last, last_seq = n + 1, bits + cost, unseen + new, us, seq
            score = bits / n
            bad = abs(score - reference) > threshold
            out.append((start, first, no, seq, us, n, score, bad, ("updated" if alert else "inserted") if bad else None, unseen))
            alert = alert or bad
        return (last, last_seq, start, first, no, n, bits, alert, unseen), out

    return run


FRESH = (None, None, None, None, 1, 0, 0.0, False, 0)
_OUT = ["session_start", "first_seq", "session_no", "event_seq", "ts", "n_events", "information_score", "anomalous", "alert_change", "n_unseen"]


def _frame(key: tuple, out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=_OUT)
    for c in ("session_start", "ts"):
        frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="us")
    frame.insert(0, "session_ip", key[0])
    return frame


class LiveScores(_PerClient):
    """Session scores and alert changes; an alert that is open when the client is forgotten is resolved then."""

    def __init__(self, step, seq: str, ttl_ms: int | None):
        super().__init__(ttl_ms)
        self.step, self.state_schema = step, STATE.format(seq=seq)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.value.get()) if self.value.exists() else FRESH
        for chunk in _in_order(rows, ["event_seq", "us", "cost", "unseen"]):
            state, out = self.step(state, chunk)
            yield _frame(key, out)
        self._keep(state, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            last, last_seq, start, first, no, n, _, alert, unseen = self.value.get()
            self.value.clear()
            if alert:
                yield _frame(key, [(start, first, no, last_seq, last, n, None, None, "resolved", unseen)])


class StepsBefore(_PerClient):
    """Every arrival with the state before it in its session (null for the first)."""

    state_schema = "last_us bigint, state string"

    def __init__(self, timeout_us: int, ttl_ms: int | None):
        super().__init__(ttl_ms)
        self.timeout_us = timeout_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, state = tuple(self.value.get()) if self.value.exists() else (None, None)
        for chunk in _in_order(rows, ["event_seq", "us", "state"]):
            before = []
            for _, us, now in chunk:
                before.append(None if last is None or us - last > self.timeout_us else state)
                last, state = us, now
            seq, times, states = zip(*chunk, strict=True)
            yield pd.DataFrame({"session_ip": key[0], "event_seq": seq, "us": np.array(times, np.int64), "state": states, "before": pd.Series(before, dtype=object)})
        self._keep((last, state), timerValues.getCurrentProcessingTimeInMs())


def _ttl_ms(ttl: str | None) -> int | None:
    return int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None


def _stateful(keyed: DataFrame, processor: StatefulProcessor, schema: str, ttl: str | None) -> DataFrame:
    use_rocksdb(keyed.sparkSession)
    return keyed.groupBy("session_ip").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl else "None")


def markov_costs(scored: DataFrame, model: MarkovModel, timeout_seconds: float, state_ttl: str | None) -> DataFrame:
    """A stream of requests with a state_id as a stream (ip, event_seq, ts, cost, unseen): what each Markov step costs, for a chain of any size.

    A first stateful operator tells the state before each request. The counted cell and the row's default come from joins with the
    chain's tables, so no task holds the chain.
    """
    seq = scored.schema["event_seq"].dataType.simpleString()
    bits = lambda p: -F.log2(p)
    known = model.states.select(F.col("state").alias("_known"))
    keyed = scored.select(client(scored).alias("session_ip"), "event_seq", F.unix_micros("ts").alias("us"), "state_id").join(known, F.col("state_id") == F.col("_known"), "left")
    keyed = keyed.select("session_ip", "event_seq", "us", F.coalesce("_known", F.lit(UNSEEN)).alias("state"))
    steps = _stateful(keyed, StepsBefore(int(timeout_seconds * 1_000_000), _ttl_ms(state_ttl)), f"session_ip string, event_seq {seq}, us bigint, state string, before string", state_ttl)
    # the start is a row like any other, named by a state that can't be
    start = "\x00start"
    cells = model.transitions().select(F.col("from_state").alias("_from"), F.col("to_state").alias("_to"), bits(F.col("p")).alias("_cell"))
    cells = cells.unionByName(model.initial().select(F.lit(start).alias("_from"), F.col("state").alias("_to"), bits(F.col("p_initial")).alias("_cell")))
    default = F.lit(model.smoothing) / (F.col("n_from") + model.smoothing * model.k)
    rows = model.states.select(F.col("state").alias("_row"), bits(default).alias("_default"))
    cells, rows = stage(cells, "live-cells"), stage(rows, "live-rows")
    at = F.coalesce("before", F.lit(start))
    priced = steps.join(cells, (at == F.col("_from")) & (F.col("state") == F.col("_to")), "left").join(rows, at == F.col("_row"), "left")
    unseen = F.col("state") == UNSEEN
    return priced.select(F.col("session_ip").alias("ip"), "event_seq", F.timestamp_micros("us").alias("ts"), F.coalesce("_cell", "_default").alias("cost"), unseen.alias("unseen"))


def _unseen(scored: DataFrame) -> Column:
    """Whether something of a request was never seen in training, as far as its columns tell."""
    flags = [F.col(c) for c in ("unseen", "unknown_url", "unknown_status") if c in scored.columns]
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))


def live_sessions(scored: DataFrame, reference: float, threshold: float, timeout_seconds: float, state_ttl: str | None = "1 day") -> DataFrame:
    """A stream of scored requests (url_bits and status_bits, or cost) as a stream of session scores and alert changes, in order of arrival.

    A session ends when its client's next request comes over ``timeout_seconds`` after the last one seen; late requests never
    split. Idle clients' state goes after ``state_ttl``, and an alert still open is resolved then; give None for a run over what is
    there now (availableNow), which would otherwise wait for the clock.
    """
    seq = scored.schema["event_seq"].dataType.simpleString()
    step = advance(reference, threshold, int(timeout_seconds * 1_000_000))
    cost = F.col("cost") if "cost" in scored.columns else F.col("url_bits") + F.col("status_bits")
    keyed = scored.select(client(scored).alias("session_ip"), "event_seq", F.unix_micros("ts").alias("us"), cost.alias("cost"), _unseen(scored).cast("int").alias("unseen"))
    return _stateful(keyed, LiveScores(step, seq, _ttl_ms(state_ttl)), live_schema(seq), state_ttl)


def live_sessions_batch(scored: DataFrame, reference: float, threshold: float, timeout_seconds: float) -> DataFrame:
    """Batch twin of ``live_sessions``' score rows: running numbers of each session, with what every arrival does to the alert."""
    bits = F.col("url_bits") + F.col("status_bits")
    held = scored.select(client(scored).alias("session_ip"), "event_seq", "ts", bits.alias("bits"), _unseen(scored).cast("int").alias("unseen"))
    rows = scan_sessions(by_range(held, ["event_seq"]), ["event_seq"], timeout_seconds, sums=("bits", "unseen"))
    score = F.col("upto_bits") / (F.col("pos") + 1)
    rows = rows.withColumns({"n_events": F.col("pos") + 1, "information_score": score, "anomalous": F.abs(score - F.lit(reference)) > F.lit(threshold)})
    first = rows.where("anomalous").groupBy("session_ip", "session_no").agg(F.min("event_seq").alias("_inserted"))
    both = rows.join(first, ["session_ip", "session_no"], "left")
    change = F.when(F.col("anomalous"), F.when(F.col("event_seq") == F.col("_inserted"), "inserted").otherwise("updated"))
    both = both.withColumns({"alert_change": change, "n_unseen": F.col("upto_unseen").cast("int")})
    return both.select(*SESSION, "session_no", "event_seq", "ts", "n_events", "information_score", "anomalous", "alert_change", "n_unseen")


def alert_lifecycle(live: DataFrame) -> DataFrame:
    """An alert per session that was ever anomalous: first and last anomalous arrival, updates, and whether the client has moved on (resolved, acknowledged)."""
    scores = live.where("information_score is not null")
    per_session = scores.groupBy("session_ip", "session_no").agg(
        F.min("event_seq").alias("first_seq"),
        F.min(F.when(F.col("anomalous"), F.col("event_seq"))).alias("created_seq"),
        F.max(F.when(F.col("anomalous"), F.col("event_seq"))).alias("updated_seq"),
        F.count_if("anomalous").alias("changes"),
        F.max("n_events").alias("n_events"),
    )
    after = F.lead("first_seq").over(Window.partitionBy("session_ip").orderBy("session_no"))
    alerts = per_session.withColumn("resolved_seq", after).where("created_seq is not null")
    return alerts.select("session_ip", "session_no", "created_seq", "updated_seq", "changes", "n_events", "resolved_seq", F.col("resolved_seq").isNotNull().alias("resolved"))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last alert change of each session in a micro-batch: what ``merge_alerts`` brings into the alert table."""
    done = changes.where("alert_change is not null")
    last = F.max_by(F.struct("session_no", "alert_change", "event_seq", "ts"), F.struct(F.col("alert_change") == "resolved", "event_seq"))
    # a resolution has no score of its own and leaves an alert's as they are
    scored = F.when(F.col("information_score").isNotNull(), F.col("event_seq"))
    kept = [F.max_by("information_score", scored).alias("last_score"), F.max_by("n_events", scored).alias("n_events"), F.max_by("n_unseen", scored).alias("n_unseen")]
    first = F.min(F.when(F.col("alert_change") != "resolved", F.col("ts")))
    return done.groupBy(*SESSION).agg(last.alias("c"), *kept, first.alias("first_ts")).select(*SESSION, "c.*", "last_score", "n_events", "n_unseen", "first_ts")


ALERTS = (
    "session_ip string, session_start timestamp, first_seq {seq}, alert_id string, session_no int, created_at timestamp, updated_at timestamp, n_events int, "
    "information_score double, resolved boolean, acknowledged boolean, n_unseen int, aep_deviation double, reasons array<string>"
)


def merge_alerts(alerts: DataFrame, changes: DataFrame, reference: float | None = None) -> DataFrame:
    """The alert table after a micro-batch: new sessions are inserted, open ones updated, closed ones resolved (and so acknowledged).

    A row a session, named by (session_ip, session_start, first_seq). An update makes an alert unacknowledged again; the creation
    time stays. The record has the requests with something unseen, the reasons, and how far the score lies from ``reference``, where that
    is given. Both sides are small beside the requests: sessions with alerts only.
    """
    new = latest_changes(changes).select(*[F.col(c).alias(f"_{c}") if c in SESSION else c for c in (*SESSION, "session_no", "alert_change", "ts", "n_events", "n_unseen", "last_score", "first_ts")])
    old = alerts.select(*SESSION, *[F.col(c).alias(f"o_{c}") for c in alerts.columns if c not in SESSION])
    both = old.join(new, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SESSION], "full")
    changed, closes = F.col("alert_change").isNotNull(), F.coalesce(F.col("alert_change") == "resolved", F.lit(False))
    key = {c: F.coalesce(c, F.col(f"_{c}")) for c in SESSION}
    named = both.select(*[v.alias(c) for c, v in key.items()], *[c for c in both.columns if c not in SESSION and c not in {f"_{x}" for x in SESSION}])
    pick = lambda mine, c: F.when(changed, F.coalesce(F.col(mine), F.col(f"o_{c}"))).otherwise(F.col(f"o_{c}"))
    deviation = F.lit(None).cast("double") if reference is None else F.abs(F.col("last_score") - F.lit(reference))
    return named.withColumn("deviation", deviation).select(
        *SESSION,
        F.coalesce("o_alert_id", F.sha2(F.to_json(F.struct(*SESSION)), 256)).alias("alert_id"),
        pick("session_no", "session_no").alias("session_no"),
        F.coalesce("o_created_at", "first_ts", "ts").alias("created_at"),
        F.when(changed & ~closes, F.col("ts")).otherwise(F.coalesce("o_updated_at", "first_ts", "ts")).alias("updated_at"),
        pick("n_events", "n_events").alias("n_events"),
        pick("last_score", "information_score").alias("information_score"),
        (closes | F.coalesce("o_resolved", F.lit(False))).alias("resolved"),
        F.when(closes, True).when(changed, False).otherwise(F.coalesce("o_acknowledged", F.lit(False))).alias("acknowledged"),
        pick("n_unseen", "n_unseen").alias("n_unseen"),
        pick("deviation", "aep_deviation").alias("aep_deviation"),
        F.array(F.lit(REASON_AEP)).alias("reasons"),  # the score's distance is what raises live alerts
    )


def scan_counters(parsed: DataFrame, excluded_reason: str = "excluded_route") -> DataFrame:
    """One row for a round of lines with a reason column (null when kept): new, malformed, excluded, scored."""
    return parsed.agg(
        F.count("*").alias("new_lines"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != excluded_reason)).alias("malformed_lines"),
        F.count_if(F.col("reason") == excluded_reason).alias("excluded_lines"),
        F.count_if(F.col("reason").isNull()).alias("scored_requests"),
    )


def round_counters(lines: DataFrame) -> DataFrame:
    """``scan_counters`` of every round of judged lines (round, reason), a row a round."""
    return lines.groupBy("round").agg(
        F.count("*").alias("new_lines"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "excluded_route")).alias("malformed_lines"),
        F.count_if(F.col("reason") == "excluded_route").alias("excluded_lines"),
        F.count_if(F.col("reason").isNull()).alias("scored_requests"),
    )


def pending_requests(live: DataFrame) -> DataFrame:
    """Requests held in each client's open session, the last one."""
    return live.groupBy("session_ip").agg(F.max_by("n_events", F.struct("session_no", "n_events")).alias("pending"))


def final_sessions(scored: DataFrame, timeout_seconds: int, lateness: str) -> DataFrame:
    """Closed sessions by event time: a watermark decides what is too late, and a session comes out once, when it can't grow any more.

    A gap of exactly the timeout still belongs to the session, as in the batch rule.
    """
    watched = scored.withColumn("session_ip", client(scored)).withWatermark("ts", lateness)
    window = F.session_window("ts", f"{timeout_seconds} seconds")
    closed = watched.groupBy("session_ip", window).agg(F.count("*").alias("n_events"), F.sum(F.col("url_bits") + F.col("status_bits")).alias("bits"))
    return closed.select("session_ip", F.col("session_window.start").alias("start_time"), "n_events", (F.col("bits") / F.col("n_events")).alias("information_score"))
