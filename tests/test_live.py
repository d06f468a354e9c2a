"""The stream against its batch twin, and the monitor from files to sinks."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from sessionscope.streaming import live

T0 = dt.datetime(2026, 1, 1)


def arrivals(spark, n=400):
    rng = random.Random(6)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.randrange(25)
        late = rng.randrange(200) if rng.random() < 0.1 else 0
        rows.append((i, rng.choice(["a", "b", "c", ""]), T0 + dt.timedelta(seconds=clock - late), rng.random() * 4, rng.random()))
    return spark.createDataFrame(rows, "event_seq bigint, ip string, ts timestamp, url_bits double, status_bits double")


def test_stream_equals_batch_twin(spark, tmp_path):
    df = arrivals(spark)
    for part in range(4):  # four files, a trigger each, in order of arrival
        df.where((F.col("event_seq") >= part * 100) & (F.col("event_seq") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = live.live_sessions(stream, 2.5, 0.8, 60, state_ttl=None).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    job.awaitTermination()
    out = spark.read.schema(live.LIVE).parquet(str(tmp_path / "out"))
    key = lambda r: (r.event_seq, r.session_ip, r.session_no, r.n_events, round(r.information_score, 9), r.anomalous, r.alert_change)
    batch = live.live_sessions_batch(df, 2.5, 0.8, 60)
    assert sorted(map(key, out.where("information_score is not null").collect())) == sorted(map(key, batch.collect()))
    resolved = {(r.session_ip, r.session_no) for r in out.where("alert_change = 'resolved'").collect()}
    alerts = live.alert_lifecycle(batch).collect()
    assert resolved == {(r.session_ip, r.session_no) for r in alerts if r.resolved} and alerts
    last = {(r.session_ip, r.session_no): r.alert_change for r in live.latest_changes(out).collect()}
    assert set(last) == {(r.session_ip, r.session_no) for r in alerts} and {k for k, v in last.items() if v == "resolved"} == resolved


def test_final_sessions_close_by_event_time(spark, tmp_path):
    rows = [(0, "a", 0), (1, "a", 60), (2, "a", 500), (3, "b", 10_000)]
    df = spark.createDataFrame([(i, ip, T0 + dt.timedelta(seconds=s), 1.0, 1.0) for i, ip, s in rows], "event_seq bigint, ip string, ts timestamp, url_bits double, status_bits double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    job = live.final_sessions(stream, 60, "10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    job.awaitTermination()
    got = sorted((r.session_ip, r.n_events) for r in spark.read.schema("session_ip string, start_time timestamp, n_events long, information_score double").parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 2)]  # b may still grow


def test_monitor_job(spark, tmp_path):
    from sessionscope.config import SessionConfig
    from sessionscope.jobs import detector as jobs
    from sessionscope.jobs.monitor import alert_table, counters, quarantine, start_monitor

    rng = random.Random(4)
    rows = [(i, f"c{i % 6}", T0 + dt.timedelta(seconds=20 * i), rng.choice(["a.x", "a.x", "a.y", "b.z"]), rng.choice(["success", "success", "not_found"])) for i in range(600)]
    events = spark.createDataFrame(rows, "event_seq bigint, ip string, ts timestamp, url_group string, status_category string")
    config = SessionConfig(timeout_seconds=1000, min_events=2)
    # clients rest now and then, so that there are several sessions
    events = events.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + F.floor(F.col("event_seq") / 40) * 5000))
    model = jobs.build(events.where("event_seq < 450"), events.where("event_seq >= 450"), config)
    line = '[2026-10-07 10:00:{:02d}] local.INFO: Route request completed. {{"method":"GET","route_name":"","uri":"{}","status":{},"ip":"9.9.9.9"}}'
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/routes-1.log").write_text("\n".join([line.format(i, f"/probe/{i}", 500) for i in range(5)] + ["broken"]) + "\n")
    paths, names = spark.createDataFrame([("/health",)], "path string"), spark.createDataFrame([("gone",)], "route_name string")
    for q in start_monitor(spark, str(tmp_path / "logs"), model, str(tmp_path / "out"), paths, names, once=True):
        q.awaitTermination()
    got = spark.read.schema(live.live_schema("string")).parquet(str(tmp_path / "out/live")).orderBy("event_seq").collect()
    assert [r.n_events for r in got] == [1, 2, 3, 4, 5] and [r.alert_change for r in got] == ["inserted"] + ["updated"] * 4
    assert [(r.source_file, r.raw_line, r.reason, r.byte_offset) for r in quarantine(spark, str(tmp_path / "out")).collect()] == [("routes-1.log", "broken", "malformed_line", sum(len(line.format(i, f"/probe/{i}", 500)) + 1 for i in range(5)))]
    assert [tuple(r)[1:] for r in counters(spark, str(tmp_path / "out")).collect()] == [(6, 1, 0, 5)]
    alerts = alert_table(spark, str(tmp_path / "out/alerts")).collect()
    assert [(r.session_ip, r.n_events, r.resolved, r.acknowledged, r.n_unseen, len(r.reasons)) for r in alerts] == [("9.9.9.9", 5, False, False, 5, 1)]
    assert abs(alerts[0].aep_deviation - abs(alerts[0].information_score - model.reference)) < 1e-12
    try:
        start_monitor(spark, str(tmp_path), model, str(tmp_path), paths, names, timeout_seconds=60)
        raise AssertionError("a differing timeout must be refused")
    except ValueError:
        pass


LINE = '[2026-10-07 10:{:02d}:{:02d}] local.INFO: Route request completed. {{"method":"GET","route_name":"{}","uri":"{}","status":{},"ip":"{}"}}'


def test_excluded_lines_are_quarantined_and_no_others(spark):
    """Listed routes are read alike by both sides: blanks, queries, slashes and blank names."""
    lines = [LINE.format(0, 1, "", "/health", 200, "a"), LINE.format(0, 2, "", "/x/?k=1", 200, "a"), LINE.format(0, 3, " gone ", "/y", 200, "a"), LINE.format(0, 4, "", "/y", 200, "a")]
    df = spark.createDataFrame([("routes-1.log", x) for x in lines], "source_file string, raw_line string")
    paths, names = spark.createDataFrame([("/health/",), (" /x?y",), ("",)], "path string"), spark.createDataFrame([("gone",), ("",), (" ",)], "route_name string")
    kept, quarantine = live.stream_parse(df, paths, names)
    assert [r.raw_line for r in kept.collect()] == [lines[3]]
    assert sorted((r.raw_line, r.reason) for r in quarantine.collect()) == sorted((x, "excluded_route") for x in lines[:3])


def test_lines_keep_file_and_line_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, part in (("routes-2.log", "b"), ("routes-1.log", "a"), ("Routes-3.log", "c")):
        (tmp_path / "in" / name).write_text("".join(f"{part}{i}\n" for i in range(300)) + "same\nsame\n")
    stream = live.stream_log_lines(spark, str(tmp_path / "in"), glob="*outes-*.log")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("event_seq").collect()
    assert [r.raw_line for r in rows] == [x for p in "abc" for x in [*(f"{p}{i}" for i in range(300)), "same", "same"]]
    assert len({r.event_seq for r in rows}) == len(rows)


def test_arrival_order_and_sessions_after_a_timeout_of_state():
    """A late line doesn't split; a client whose state went starts a session of another name; an open alert is resolved then."""
    step = live.advance(1.0, 0.5, 60)
    state, out = step(live.FRESH, [("f:1", 100, 3.0, 1), ("f:2", 30, 3.0, 0), ("f:3", 85, 1.0, 1)])
    assert [(r[0], r[1], r[2], r[5], r[8]) for r in out] == [(100, "f:1", 1, 1, "inserted"), (100, "f:1", 1, 2, "updated"), (100, "f:1", 1, 3, "updated")]
    _, again = step(live.FRESH, [("g:1", 9000, 3.0, 0)])
    assert again[0][:2] == (9000, "g:1") and again[0][2] == 1
    _, after = step(state, [("f:4", 200, 1.0, 0)])
    assert [(r[1], r[8], r[9]) for r in after] == [("f:1", "resolved", 2), ("f:4", None, 0)]


def test_a_client_of_many_rows_comes_out_in_chunks():
    """A client's frames are put in order whole, but worked on and given out in pieces."""
    import pandas as pd

    n = 3 * live.CHUNK + 5
    seq = list(range(n))
    random.Random(1).shuffle(seq)
    frames = [pd.DataFrame({"event_seq": seq[at : at + 1000], "us": seq[at : at + 1000], "cost": 1.0}) for at in range(0, n, 1000)]
    chunks = list(live._in_order(iter(frames), ["event_seq", "us", "cost"]))
    assert [len(c) for c in chunks] == [live.CHUNK] * 3 + [5] and [x[0] for c in chunks for x in c] == list(range(n))


def test_state_that_times_out_resolves_its_alert(spark, tmp_path):
    """A client goes away with an open alert; its next session, after the state's time, has another name and the first one is closed."""
    import time

    schema = "event_seq string, ip string, ts timestamp, url_bits double, status_bits double"
    spark.createDataFrame([("f:1", "a", T0, 5.0, 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df = live.live_sessions(stream, 1.0, 0.5, 60, state_ttl="1 second")
    job = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="1 second").start(str(tmp_path / "out"))

    def wait(first_seq, change):
        until = time.time() + 40
        while time.time() < until:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                rows = spark.read.schema(live.live_schema("string")).parquet(str(tmp_path / "out")).collect()
                if any((r.first_seq, r.alert_change) == (first_seq, change) for r in rows):
                    return

    wait("f:1", "resolved")
    spark.createDataFrame([("f:2", "a", T0 + dt.timedelta(hours=9), 5.0, 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wait("f:2", "inserted")
    job.stop()
    changes = spark.read.schema(live.live_schema("string")).parquet(str(tmp_path / "out"))
    assert {(r.first_seq, r.session_no, r.alert_change) for r in changes.collect()} >= {("f:1", 1, "inserted"), ("f:1", 1, "resolved"), ("f:2", 1, "inserted")}
    alerts = live.merge_alerts(spark.createDataFrame([], live.ALERTS.format(seq="string")), changes.where("first_seq = 'f:1' or alert_change = 'inserted'")).collect()
    assert {(r.first_seq, r.resolved) for r in alerts} == {("f:1", True), ("f:2", False)}


def test_alert_table_keeps_creation_and_acknowledgement(spark):
    def change(seq, kind, ts, n, score=None):
        return ("a", T0, "s", 1, seq, T0 + dt.timedelta(seconds=ts), n, score, score is not None, kind, n // 2)

    batch = lambda *rows: spark.createDataFrame(list(rows), live.live_schema("string"))
    none = spark.createDataFrame([], live.ALERTS.format(seq="string"))
    one = live.merge_alerts(none, batch(change("1", "inserted", 1, 1, 4.0), change("2", "updated", 2, 2, 5.0), change("3", None, 3, 3, 1.0)))
    r = one.first()
    assert (r.created_at, r.updated_at, r.n_events, r.information_score, r.resolved, r.acknowledged) == (T0 + dt.timedelta(seconds=1), T0 + dt.timedelta(seconds=2), 2, 5.0, False, False)
    seen = one.withColumn("acknowledged", F.lit(True))
    assert live.merge_alerts(seen, batch(change("4", None, 4, 4, 1.0))).first().acknowledged
    again = live.merge_alerts(seen, batch(change("5", "updated", 5, 5, 6.0))).first()
    assert not again.acknowledged and again.created_at == r.created_at and again.alert_id == r.alert_id
    done = live.merge_alerts(one, batch(change("9", "resolved", 9, 5)))
    assert (done.first().resolved, done.first().acknowledged, done.first().information_score, done.first().updated_at) == (True, True, 5.0, r.updated_at) and done.count() == 1


def test_markov_monitor_equals_batch(spark, tmp_path):
    """The chain as a table in the stream's state gives the scores of the batch functions."""
    from sessionscope.config import SessionConfig
    from sessionscope.jobs import detector as jobs
    from sessionscope.jobs.monitor import start_monitor
    from sessionscope.operators.prepare import preprocess_events
    from sessionscope.functions.parse import parse_log_lines
    from sessionscope.sources.logs import read_log_lines

    rng = random.Random(11)
    uris = ["/a/x", "/a/y", "/b/z", "/new/one"]
    lines = [LINE.format(i // 60, i % 60, "", rng.choice(uris[:3] if i < 200 else uris), rng.choice([200, 404]), f"c{i % 5}") for i in range(300)]
    for name, part in (("train", lines[:140]), ("check", lines[140:200]), ("live", lines[200:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "routes-1.log").write_text("\n".join(part) + "\n")
    events = {n: preprocess_events(parse_log_lines(read_log_lines(spark, str(tmp_path / n), "routes"), "routes")) for n in ("train", "check", "live")}
    model = jobs.build(events["train"], events["check"], SessionConfig(timeout_seconds=20, min_events=1, model="markov"))
    none = spark.createDataFrame([], "path string"), spark.createDataFrame([], "route_name string")
    for q in start_monitor(spark, str(tmp_path / "live"), model, str(tmp_path / "out"), *none, once=True):
        q.awaitTermination()
    got = spark.read.schema(live.live_schema("string")).parquet(str(tmp_path / "out/live")).where("information_score is not null")
    last = got.groupBy("session_ip", "session_start").agg(F.max("n_events").alias("n"), F.max_by("information_score", "n_events").alias("s")).collect()
    want = jobs.detect(events["live"], model).where("mode = 'aep'").collect()
    assert sorted((r.session_ip, r.n, round(r.s, 9)) for r in last) == sorted((r.session_ip, r.n_events, round(r.information_score, 9)) for r in want)
    found = jobs.analyze_log(events["live"], model).collect()
    assert found and all(len(r.transition_probabilities) == r.n_events - 1 and len(r.least_probable_transitions) <= 5 for r in found)
    assert any(r.unknown_events for r in found)


# ---- files that grow


def tailed(spark, folder, work, glob="*.log", span_bytes=64):
    from sessionscope.sources.tail import tail_log_lines

    stream = tail_log_lines(spark, str(folder), glob=glob, span_bytes=span_bytes)
    stream.writeStream.format("parquet").option("checkpointLocation", str(work / "check")).trigger(availableNow=True).start(str(work / "out")).awaitTermination()
    return [(r.source_file, r.byte_offset, r.raw_line) for r in spark.read.parquet(str(work / "out")).orderBy("event_seq").collect()]


def test_tail_follows_appends_halves_and_truncation(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_bytes(b"one\r\n\ntwo\xff\nhal")
    (logs / "B.log").write_bytes("".join(f"line {i} \u00e9\n" for i in range(40)).encode())
    (logs / "other.txt").write_bytes(b"no\n")
    (logs / "c.log").write_bytes(b"no feed at all")
    size = len("line 1 \u00e9\n".encode())
    places = [0]
    for i in range(39):
        places.append(places[-1] + size + (i > 9))
    want = [("a.log", 0, "one"), ("a.log", 5, ""), ("a.log", 6, "two\ufffd")] + [("B.log", p, f"line {i} \u00e9") for i, p in enumerate(places)]
    assert tailed(spark, logs, tmp_path) == want
    assert tailed(spark, logs, tmp_path) == want  # nothing new
    with (logs / "a.log").open("ab") as f:
        f.write(b"f\nlast\n")
    (logs / "B.log").write_bytes(b"fresh\n")  # shorter than before
    (logs / "c.log").write_bytes(b"no feed at all\n")
    want += [("a.log", 11, "half"), ("a.log", 16, "last"), ("B.log", 0, "fresh"), ("c.log", 0, "no feed at all")]
    assert tailed(spark, logs, tmp_path) == want
    (logs / "B.log").write_bytes(b"other first line, and longer\n")  # another file under the name
    (logs / "a.log").unlink()
    assert tailed(spark, logs, tmp_path) == want + [("B.log", 0, "other first line, and longer")]


def test_tail_spans_cover_every_line_once(tmp_path):
    """Whatever the ranges are, each line is read by one of them, lines longer than a range and than a block too."""
    from sessionscope.sources import tail

    rng = random.Random(2)
    lines = [b"x" * rng.choice([0, 1, 5, 300]) for _ in range(200)] + [b"y" * (2 * tail.BLOCK + 7), b"", b"end"]
    (tmp_path / "f.log").write_bytes(b"\n".join(lines) + b"\npartial")
    for span in (1, 7, 100, 1 << 20, 1 << 24):
        reader = tail.TailReader({"path": str(tmp_path), "glob": "*.log", "spanbytes": str(max(span, 4096 if span < 100 else span))})
        end = reader.latestOffset()
        spans = reader.partitions(reader.initialOffset(), end)
        got = [x for s in spans for b in reader.read(s) for x in b.column(0).to_pylist()]
        assert got == lines and end["files"]["f.log"][0] == sum(len(x) + 1 for x in lines)
        assert reader.partitions(end, end) == []


def test_positions_of_batch_lines(spark, tmp_path):
    """Line numbers over split borders; blank lines count, CRLF ends lines, bytes that are no UTF-8 are replaced."""
    from sessionscope.sources.logs import read_log_lines

    lines = [b"" if i % 7 == 0 else b"l%d" % i for i in range(3000)]
    (tmp_path / "routes-1.log").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "routes-2.log").write_bytes(b"a\r\n\r\nb\xfe\xffc\nlast")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_log_lines(spark, str(tmp_path), "routes").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    got = {(r.source_file, r.line_number): r.raw_line for r in rows}
    assert len(got) == len(rows) and {n: x for (f, n), x in got.items() if f == "routes-1.log"} == {i: x.decode() for i, x in enumerate(lines, 1)}
    assert [got["routes-2.log", n] for n in (1, 2, 3, 4)] == ["a", "", "b\ufffd\ufffdc", "last"]


def test_model_versions(spark, tmp_path):
    """A version counts once it is committed; saving over the loaded path works; a monitor goes on with the next version."""
    import threading
    import time

    import pytest

    from sessionscope.config import SessionConfig
    from sessionscope.jobs import detector as jobs
    from sessionscope.jobs.monitor import keep_monitoring
    from sessionscope.sources import models

    rows = [(i, f"c{i % 5}", T0 + dt.timedelta(seconds=20 * i), ["a.x", "a.y", "b.z"][i % 3], ["success", "not_found"][i % 7 == 0]) for i in range(300)]
    events = spark.createDataFrame(rows, "event_seq bigint, ip string, ts timestamp, url_group string, status_category string")
    model = jobs.build(events.where("event_seq < 200"), events.where("event_seq >= 200"), SessionConfig(timeout_seconds=1000, min_events=1))
    path = str(tmp_path / "model")
    with pytest.raises(ValueError, match="committed"):
        models.load_model(spark, path)
    models._write_version(model, f"{path}/versions/9")  # never committed
    with pytest.raises(ValueError, match="committed"):
        models.load_model(spark, path)
    first = models.save_model(model, path)
    loaded = models.load_model(spark, path)
    model.aep_threshold = loaded.aep_threshold = 1e9  # nothing is anomalous to the second version
    second = models.save_model(loaded, path)
    assert models.committed_version(spark, path) == second > first
    assert models.load_model(spark, path, first).aep_threshold < 1e9 == models.load_model(spark, path).aep_threshold
    model.aep_threshold = -1.0  # everything is to the third
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    none = spark.createDataFrame([], "path string"), spark.createDataFrame([], "route_name string")
    over = threading.Event()
    watch = threading.Thread(target=keep_monitoring, args=(spark, str(logs), path, out, *none), kwargs={"poll_seconds": 0.5, "until": over.is_set})

    def add(second_of, ip):
        with (logs / "routes-1.log").open("a") as f:
            f.write(LINE.format(0, second_of, "", "/a/x", 200, ip) + "\n")

    def scores(n):
        until = time.time() + 90
        while time.time() < until:
            try:
                found = spark.read.schema(live.live_schema("string")).parquet(f"{out}/live").where("information_score is not null").orderBy("event_seq").collect()
            except Exception:
                found = []
            if len(found) >= n:
                return [(r.session_ip, r.n_events, r.anomalous) for r in found]
            time.sleep(0.5)
        raise AssertionError("the monitor gave no scores")

    add(1, "a")
    watch.start()
    try:
        assert scores(1) == [("a", 1, False)]
        models.save_model(model, path)
        time.sleep(6)
        add(2, "a")
        assert scores(2) == [("a", 1, False), ("a", 2, True)]  # the session goes on under the new model
    finally:
        over.set()
        watch.join(60)
    assert not watch.is_alive()


def test_alerts_rewrite_only_buckets_with_changes(spark, tmp_path):
    from sessionscope.jobs.monitor import alert_table, store_changes

    def batch(ip, n):
        return spark.createDataFrame([(ip, T0, f"{ip}1", 1, f"{ip}{n}", T0 + dt.timedelta(seconds=n), n, 5.0, True, "inserted" if n == 1 else "updated", 0)], live.live_schema("string"))

    out = str(tmp_path)
    each = store_changes(out)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "alerts").rglob("*.parquet")}
    each(batch("a", 1), 0)
    first = files()
    each(batch("b", 1), 1)
    assert first.items() <= files().items() and len(files()) == 2
    for _ in range(2):  # a batch that runs again changes nothing
        each(batch("a", 2), 2)
        assert sorted((r.session_ip, r.n_events, r.created_at, r.updated_at) for r in alert_table(spark, f"{out}/alerts").collect()) == [
            ("a", 2, T0 + dt.timedelta(seconds=1), T0 + dt.timedelta(seconds=2)), ("b", 1, T0 + dt.timedelta(seconds=1), T0 + dt.timedelta(seconds=1)),
        ]
    each(spark.createDataFrame([("c", T0, "c1", 1, "c1", T0, 1, 0.1, False, None, 0)], live.live_schema("string")), 3)
    assert alert_table(spark, f"{out}/alerts").count() == 2


# ---- closed, open and late


def plain_closing(batches, timeout, lateness):
    """Batches of (seq, ip, seconds) -> (closed, open, late), a batch after the other."""
    latest, still, closed, late = None, [], [], []
    for batch in batches:
        passed = None if latest is None else latest - lateness
        good = [r for r in batch if passed is None or r[2] + timeout > passed]
        late += [(r[0], passed - r[2]) for r in batch if r not in good]
        parts = sorted([*still, *((ip, at, at, 1) for _, ip, at in good)])
        still = []
        for ip, a, b, n in parts:
            if still and still[-1][0] == ip and a - still[-1][2] <= timeout:
                _, x, y, m = still[-1]
                still[-1] = (ip, x, max(y, b), m + n)
            else:
                still.append((ip, a, b, n))
        if batch:
            latest = max([r[2] for r in batch] + ([] if latest is None else [latest]))
        if latest is not None:
            closed += [s for s in still if s[2] + timeout <= latest - lateness]
            still = [s for s in still if s[2] + timeout > latest - lateness]
    return sorted(closed), sorted(still), sorted(late)


def test_closed_open_and_late_add_up(spark, tmp_path):
    from sessionscope.streaming import closing

    rng = random.Random(12)
    batches, clock, seq = [], 0, 0
    for size in (60, 40, 0, 80, 60):
        rows = []
        for _ in range(size):
            clock += rng.randrange(12)
            rows.append((seq, rng.choice("abc"), clock - (rng.randrange(400) if rng.random() < 0.2 else 0)))
            seq += 1
        batches.append(rows)
    out = str(tmp_path / "out")
    each = closing.close_sessions(out, 30, 60)
    frames = [spark.createDataFrame([(s, ip, T0 + dt.timedelta(seconds=at), 1.0, 0.5) for s, ip, at in rows], "event_seq bigint, ip string, ts timestamp, url_bits double, status_bits double") for rows in batches]
    for epoch, df in enumerate(frames):
        each(df, epoch)
    each(frames[-1], len(frames) - 1)  # the last one again, as after a crash
    closed, still, late = plain_closing(batches, 30, 60)
    second = lambda x: int((x - T0).total_seconds())
    rows = lambda df: sorted((r.session_ip, second(r.start_time), second(r.end_time), r.n_events) for r in df.collect())
    assert rows(closing.closed_sessions(spark, out)) == closed and rows(closing.open_sessions(spark, out)) == still
    assert sorted((r.event_seq, r.late_by_seconds) for r in closing.late_requests(spark, out).collect()) == late and len(late) > 5
    assert sum(s[3] for s in closed + still) + len(late) == seq
    assert {round(r.information_score, 9) for r in closing.closed_sessions(spark, out).collect()} == {1.5}


def test_closing_as_a_stream(spark, tmp_path):
    from sessionscope.streaming import closing

    df = arrivals(spark, 200)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream.writeStream.foreachBatch(closing.close_sessions(out, 60, 10)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    held = closing.closed_sessions(spark, out).unionByName(closing.open_sessions(spark, out))
    assert held.agg(F.sum("n_events")).first()[0] == 200 and closing.late_requests(spark, out).count() == 0


def test_a_large_round_has_a_bounded_number_of_ranges(tmp_path):
    """Each range is a task; together they cover every byte once."""
    from sessionscope.sources import tail

    for name, n in (("routes-1.log", 9_000), ("routes-2.log", 3)):
        (tmp_path / name).write_bytes(b"".join(b"line %d\n" % i for i in range(n)))
    reader = tail.TailReader({"path": str(tmp_path), "spanbytes": "16"})
    spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(spans) <= tail.MOST_SPANS + 2
    for name in ("routes-1.log", "routes-2.log"):
        own = [s for s in spans if s.file == name]
        assert [s.low for s in own] == [0] + [s.high for s in own[:-1]] and own[-1].high == (tmp_path / name).stat().st_size
    rows = [x for s in spans for batch in reader.read(s) for x in zip(batch["source_file"].to_pylist(), batch["raw_line"].to_pylist(), strict=True)]
    assert rows == [("routes-1.log", b"line %d" % i) for i in range(9_000)] + [("routes-2.log", b"line %d" % i) for i in range(3)]
