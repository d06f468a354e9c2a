"""Sessions, windows, splits, order, curation."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionscope.operators import curate, sessions
from sessionscope.operators.ordering import with_global_index

T0 = dt.datetime(2026, 1, 1)
EVENT = "event_seq bigint, ip string, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame([(i, ip, T0 + dt.timedelta(seconds=s)) for i, (ip, s) in enumerate(rows)], EVENT)


def test_gap_of_exactly_the_timeout_stays(spark):
    df = events(spark, [("a", 0), ("a", 60), ("a", 121), ("", 0), (None, 30), ("b", 5), ("b", 5)])
    got = {r.event_seq: (r.session_ip, r.session_no) for r in sessions.number_sessions(df, 60).collect()}
    assert got == {0: ("a", 1), 1: ("a", 1), 2: ("a", 2), 3: ("missing_ip", 1), 4: ("missing_ip", 1), 5: ("b", 1), 6: ("b", 1)}
    assert {r.event_seq for r in sessions.ip_sessions(df, 60, 2).collect()} == {0, 1, 3, 4, 5, 6}


def plain_sessions(rows, timeout):
    """rows: (event_seq, ip, seconds) -> event_seq: (client, session_no, pos, n_events, first second)."""
    by_client = {}
    for seq, ip, at in sorted(rows, key=lambda r: (r[2], r[0])):
        by_client.setdefault((ip or "").strip() or sessions.MISSING_IP, []).append((at, seq))
    out = {}
    for ip, requests in by_client.items():
        runs = []
        for at, seq in requests:
            if not runs or at - runs[-1][-1][0] > timeout:
                runs.append([])
            runs[-1].append((at, seq))
        for no, run in enumerate(runs, 1):
            out |= {seq: (ip, no, pos, len(run), run[0][0]) for pos, (_, seq) in enumerate(run)}
    return out


@pytest.fixture
def partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_sessions_over_any_borders(spark, partitions, parts):
    """Half of all requests from one client, ties, sessions longer and shorter than a segment."""
    rng = random.Random(parts)
    rows, clock = [], 0
    for i in range(600):
        clock += rng.choice([0, 0, 1, 3, 8, 30, 61])
        rows.append((i, None if i % 2 else f"c{i % 9}", clock))
    df = spark.createDataFrame([(i, ip, T0 + dt.timedelta(seconds=s), 1) for i, ip, s in rows], EVENT + ", _n int").repartition(3)
    partitions(parts)
    want = plain_sessions(rows, 60)
    got = {r.event_seq: (r.session_ip, r.session_no, r.pos, r.n_events, int((r.session_start - T0).total_seconds())) for r in sessions.ip_sessions(df, 60).collect()}
    assert got == want
    assert {r.event_seq for r in sessions.ip_sessions(df, 60, 5).collect()} == {i for i, w in want.items() if w[3] >= 5}


def test_a_hot_client_in_one_hour_is_dealt_evenly(spark, partitions):
    """Half of all rows from one client inside an hour: no segment holds more than twice the mean."""
    from sessionscope.operators import segments

    df = spark.range(20_000).selectExpr("id as event_seq", "case when id % 2 = 0 then 'hot' else concat('c', id % 501) end as ip", "timestamp_seconds(1767225600 + cast(id * 0.18 as bigint)) as ts")
    partitions(16)
    placed = segments.by_time(df.withColumn("session_ip", F.col("ip"))).groupBy("session_ip", "_segment").count().collect()
    hot = [r["count"] for r in placed if r["session_ip"] == "hot"]
    assert len(hot) == 16 and max(hot) < 2 * 20_000 / 16 and all(r["_segment"] == 0 for r in placed if r["session_ip"] != "hot")
    ranged = segments.by_range(df.withColumn("session_ip", F.col("ip")), ["event_seq"]).groupBy("_segment").count().collect()
    assert len(ranged) == 16 and max(r["count"] for r in ranged) < 2 * 20_000 / 16
    numbers = sessions.ip_sessions(df, 60)
    assert numbers.where("session_ip = 'hot'").agg(F.max("session_no"), F.max("pos"), F.count("*")).first()[:] == (1, 9_999, 10_000)


def test_requests_without_a_time_and_empty_tables(spark):
    df = events(spark, [("a", 0), ("a", 10)]).union(spark.createDataFrame([(9, "a", None)], EVENT))
    assert {r.event_seq for r in sessions.ip_sessions(df, 60).collect()} == {0, 1}
    assert sessions.ip_sessions(df.limit(0), 60).collect() == [] and sessions.number_sessions(df.limit(0), 60).collect() == []


def test_global_index_and_prefix_sums(spark):
    rng = random.Random(2)
    values = [rng.randrange(100) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    rows = with_global_index(df, [F.col("v"), F.col("i").desc()], "idx", {"v": "upto"}).orderBy("idx").collect()
    want, total = sorted(enumerate(values), key=lambda p: (p[1], -p[0])), 0
    for n, (r, (i, v)) in enumerate(zip(rows, want, strict=True)):
        total += v
        assert (r.idx, r.i, r.upto) == (n, i, total)
    assert with_global_index(df.limit(0), [F.col("v")]).count() == 0


def test_windows_and_splits(spark):
    df = events(spark, [("a", i) for i in range(20)])
    assert sessions.fixed_count_windows(df, 2).select("window_no").distinct().count() == 10
    assert sessions.fixed_count_windows(df, 6).count() == 18
    assert sessions.fixed_count_windows(df, 6, include_partial=True).count() == 20
    split = sessions.split_by_position(sessions.fixed_count_windows(df, 2).groupBy("window_no").count(), [F.col("window_no")])
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"training": 6, "validation": 1, "testing": 3}
    assert {r.window_no for r in sessions.fixed_time_windows(events(spark, [("a", 5), ("a", 14), ("a", 15), ("b", 99)]), 10).collect()} == {0, 1, 9}
    with pytest.raises(ValueError):
        sessions.split_bounds(3, 0.65, 0.15)


def test_records_are_numbered_by_first_event(spark):
    df = events(spark, [("b", 10), ("a", 11), ("b", 12), ("a", 500)]).withColumn("state_id", F.concat(F.lit("s"), "event_seq"))
    rows = sessions.window_records(sessions.session_records(sessions.ip_sessions(df, 60))).orderBy("window_id").collect()
    assert [(r.window_id, r.session_ip, r.n_events, r.states) for r in rows] == [(0, "b", 2, ["s0", "s2"]), (1, "a", 1, ["s1"]), (2, "a", 1, ["s3"])]


def routes(spark, rows):
    df = spark.createDataFrame(rows, "event_seq bigint, ip string, s int, method string, uri string, route_name string")
    return df.withColumn("ts", F.when(F.col("s").isNotNull(), F.timestamp_seconds(F.col("s")))).withColumn("normalized_uri", F.lit(None).cast("string"))


def test_curation(spark):
    df = routes(spark, [(0, "a", 0, "get", "/ok/?x=1", None), (1, "a", 10, "POST", "/ok", ""), (2, "a", 500, "GET", "/x", "home"), (3, "b", 0, "GET", "/any/", ""), (4, "b", None, "GET", "/bad", None), (5, "c", 0, "GET", "/gone/", "")])
    inventory = spark.createDataFrame([("GET", "/ok"), ("*", "/any/"), ("*", "/any")], "method string, path string")
    names = spark.createDataFrame([("home",), ("",)], "route_name string")
    kept = curate.exclude_routes(df, spark.createDataFrame([("/gone?x",), (" ",)], "path string"), spark.createDataFrame([("nope",)], "route_name string"))
    assert kept.count() == 5
    curated = curate.curate(kept, inventory, names)
    got = {r.event_seq: (r.classification, r.reason) for r in curated.collect()}
    review = ("review", "endpoint_not_in_application_allowlist")
    assert got == {0: ("normal", "allowlisted_method_path"), 1: review, 2: ("normal", "allowlisted_route_name"), 3: ("normal", "allowlisted_method_path"), 4: review}
    controlled = {r.event_seq: (r.classification, r.reason) for r in curate.session_control(curated, 60).collect()}
    tainted = ("review", "session_contains_unallowlisted_route")
    assert controlled == got | {0: tainted, 1: tainted}
    assert {r.classification for r in curate.curate(df, inventory, names, enabled=False).collect()} == {"normal"}
    with pytest.raises(ValueError):
        curate.curate(df, inventory.limit(0), names.limit(0))
    args = {"paths": spark.createDataFrame([("/gone",)], "path string"), "route_names": names.limit(0), "inventory": inventory, "names": names, "timeout_seconds": 60}
    counts = {p: curate.partition_policy(df, p, **args).count() for p in ("train", "validate", "test", "upload", "detect")}
    assert counts == {"train": 2, "validate": 2, "test": 6, "upload": 5, "detect": 6}
    assert curate.partition_policy(df, "validate", allowlist_in_validation=False, **args).count() == 5
    with pytest.raises(ValueError):
        curate.partition_policy(df, "other", **args)


def test_paths_are_cleaned_as_by_matches(spark):
    """Trimming and cutting give what the matches gave, and a path is cleaned once a row."""
    from sessionscope.functions import routes

    odd = ["", " ", "/", "//", "/a", "/a/", "/a//?x=/y/", " /a \t", "\u00a0/a\u00a0", "?", "/?", "/a ?b", "/a/ ?b?c", "/a\n", "/a/\x0b\f\r", "/a/ ", "a?\n/b", "/\u00e9/?", "/ /", None]
    df = spark.createDataFrame([(x,) for x in odd], "p string")
    bare = F.regexp_replace(routes.stripped(F.regexp_replace(routes.stripped(F.col("p")), r"(?s)\?.*\z", "")), r"/+\z", "")
    rows = df.select("p", curate.clean_path(F.col("p")).alias("got"), F.when(bare == "", "/").otherwise(bare).alias("want")).collect()
    assert [(r.p, r.got) for r in rows] == [(r.p, r.want) for r in rows]
    plan = df.select(curate.clean_path(F.col("p")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index(") == 1 and "regexp" not in plan


def test_sessions_move_requests_once(spark, sf_dir, partitions):
    """Without clients to be cut, the scan deals the rows once and joins nothing; with one, they still stand where the join needs them."""
    from sessionscope.operators import segments
    from sessionscope.queries import tables

    partitions(4)
    df = spark.range(1000).selectExpr("id as event_seq", "concat('c', id % 100) as session_ip", "timestamp_seconds(1767225600 + id) as ts", "0 as _segment")
    plan = lambda d: segments.scan_sessions(d, ["ts", "event_seq"], 60)._jdf.queryExecution().executedPlan().toString()
    assert plan(df).count("Exchange") == 1 and "Join" not in plan(df)
    cut = plan(df.withColumn("_segment", F.when(F.col("session_ip") == "c1", F.col("event_seq").cast("int") % 4 + 1).otherwise(0)))
    assert "_run#" not in "".join(line for line in cut.splitlines() if "Exchange hashpartitioning" in line)
    lists = [f(spark, sf_dir) for f in (tables.inventory, tables.listed_names, tables.excluded_paths, tables.excluded_names)]
    assert not any("events.parquet" in f for x in lists for f in x.inputFiles())


def test_catalog_conflicts(spark):
    good = spark.createDataFrame([("s", "d"), ("s", "d"), ("t", "e")], "state_id string, state_description string")
    assert curate.check_catalog(curate.state_catalog(good)).count() == 2
    assert curate.state_catalog(good, good.where("state_id = 't'")).count() == 1
    with pytest.raises(ValueError):
        curate.check_catalog(curate.state_catalog(good.union(spark.createDataFrame([("s", "x")], "a string, b string"))))


def test_control_reaches_over_borders(spark, partitions):
    rng = random.Random(17)
    rows = [(i, None if i % 2 else f"c{i % 9}", 7 * i if i < 250 else 90 * i, rng.random() < 0.05) for i in range(500)]
    df = spark.createDataFrame([(i, ip, T0 + dt.timedelta(seconds=s), "review" if bad else "normal", "r") for i, ip, s, bad in rows], EVENT + ", classification string, reason string")
    numbers = plain_sessions([r[:3] for r in rows], 60)
    tainted = {numbers[i][:2] for i, *_, bad in rows if bad}
    partitions(11)
    got = {r.event_seq: (r.classification, r.reason) for r in curate.session_control(df, 60).collect()}
    assert got == {i: ("review", "session_contains_unallowlisted_route") if numbers[i][:2] in tainted else ("normal", "r") for i, *_ in rows}


def test_staging_needs_a_shared_folder_on_a_cluster():
    import types

    from sessionscope.operators import staging

    def session(master, folder=None):
        conf = types.SimpleNamespace(get=lambda k, d=None: folder or d)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert staging.shared_dir(session("spark://x:7077", "hdfs://a/b/")) == "hdfs://a/b"
    assert staging.shared_dir(session("local[4]"))
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            staging.shared_dir(session(master))
