"""Line parsing, route normalisation and states: the small cases, with their edges."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sessionscope.functions import routes
from sessionscope.functions.parse import parse_log_lines, parse_summary
from sessionscope.operators.prepare import event_time, preprocess_events, preprocess_summary, upgrade_states
from sessionscope.sources.logs import list_log_files, read_events, read_log_lines

OK = '[2026-10-07 10:00:01] local.INFO: Route request completed. {"method":"get","route_name":null,"uri":"/users/123456","status":404,"ip":"10.0.0.1"}'


def parse(spark, *lines, log_type="routes"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw_line string")
    return [r.asDict() for r in parse_log_lines(df, log_type).orderBy("i").collect()]


def test_good_lines(spark):
    r = parse(spark, OK)[0]
    assert (r["parse_status"], r["timestamp"], r["log_level"], r["method"], r["route_name"], r["uri"], r["status"], r["ip"]) == ("ok", "2026-10-07 10:00:01", "INFO", "get", "", "/users/123456", "404", "10.0.0.1")
    r = parse(spark, '[2026-10-07 10:00:01] local.INFO: Controller request completed. {"controller_action":"A@b","status":200}', log_type="controllers")[0]
    assert (r["parse_status"], r["controller_action"], r["status"]) == ("ok", "A@b", "200")
    rows = parse(spark, *[f'[2026-10-07 10:00:01] local.INFO: Service {x}operation completed. {{"operation":"x"}}' for x in ("", "entry ")], log_type="services")
    assert [r["parse_status"] for r in rows] == ["ok", "ok"] and rows[0]["operation"] == "x"


@pytest.mark.parametrize(
    ("line", "status", "stamp"),
    [
        ("not a valid log line", "malformed_line", ""),
        ("x [2026-01-02 03:04:05] y", "malformed_line", "2026-01-02 03:04:05"),
        ("[2026-10-07 10:00:01] local.INFO: Route request completed.", "malformed_line", "2026-10-07 10:00:01"),
        ("[2026-10-07 10:00:01] local.INFO: Other {}", "unexpected_message", "2026-10-07 10:00:01"),
        ("[2026-10-07 10:00:01] local.INFO: Route request completed. {}", "missing_fields", "2026-10-07 10:00:01"),
        ("[2026-10-07 10:00:01] local.INFO: Route request completed. {'a':1}", "invalid_json", "2026-10-07 10:00:01"),
        (OK + " trailing", "invalid_json", "2026-10-07 10:00:01"),
        ("", "malformed_line", ""),
        (None, "malformed_line", ""),
    ],
)
def test_bad_lines(spark, line, status, stamp):
    r = parse(spark, line)[0]
    assert (r["parse_status"], r["timestamp"], r["method"], r["raw_line"]) == (status, stamp, "", line)


def test_folder_of_logs(spark, tmp_path):
    (tmp_path / "routes-a.log").write_text(OK + "\nnot a valid log line\n")
    (tmp_path / "routes-b.log").write_text("")
    (tmp_path / "services-a.log").write_text("x\n")
    lines = read_log_lines(spark, str(tmp_path), "routes")
    files = list_log_files(spark, str(tmp_path), "routes")
    r = parse_summary(parse_log_lines(lines, "routes"), files).collect()
    assert [(x.log_type, x.files, x.ok_rows, x.bad_rows) for x in r] == [("routes", 2, 1, 1)]
    assert [x.raw_line for x in lines.orderBy("event_seq").collect()] == [OK, "not a valid log line"]
    (tmp_path / "e.csv").write_text("﻿timestamp,method\n1,GET\n")
    assert read_events(spark, str(tmp_path / "e.csv"), ("timestamp", "method"), "csv").collect()[0].method == "GET"
    with pytest.raises(ValueError, match="uri"):
        read_events(spark, str(tmp_path / "e.csv"), ("uri",), "csv")


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    cases = {
        "/Shops/{shopKey}/0F8FAD5B-d9cb-469f-a165-70867728950e/9876543210?page=2&n=3#reviews": "/Shops/:id/:id/:id",
        "Depot/42/Open": "/Depot/42/Open",
        "/99999/a.b-c/x_y.json": "/99999/a.b-c/x_y.json",
        None: "unknown",
        "  ": "unknown",
        "?a=b": "unknown",
        "https://h.example/a//b/#x": "/a//b/",
        "https://h.example": "unknown",
        "http://[bad/a/1234567?q": "/http://[bad/a/:id",
        "//host/a": "/a",
        "/a/12345/123456": "/a/12345/:id",
        "/{}/{a}{b}/{a}": "/{}/{a}{b}/:id",
    }
    assert values(spark, routes.normalize_uri, cases) == list(cases.values())


def test_group_class_and_category(spark):
    groups = {"/users/:id": "route.users", "/": "root", "/:id/:id": "root", "/API/v1/Users/x": "api.v1.users", "/api/v1": "api.v1", "/A/b/c": "a.b", "unknown": "unknown", None: "unknown", "": "unknown"}
    assert values(spark, routes.url_group, groups) == list(groups.values())
    codes = {"200": "success", " 302 ": "redirect", "401": "auth_failure", "403": "auth_failure", "404": "not_found", "429": "rate_limited", "418": "client_error", "500": "server_error", "100": "informational", "99": "unknown", "600": "unknown", "2000": "unknown", "abc": "unknown", None: "unknown", "٢٠٠": "unknown"}
    assert values(spark, routes.status_category, codes) == list(codes.values())
    assert values(spark, routes.status_class, ["200", "99", None, "503\n"]) == ["2xx", "unknown", "unknown", "5xx"]


def test_state_is_sha_of_sorted_compact_json(spark):
    df = spark.createDataFrame([("get", "a.é", "success")], "m string, u string, s string")
    r = df.select(routes.describe_state(F.col("m"), F.col("u"), F.col("s"), ("url_group", "method", "status_category")).alias("d")).withColumn("i", routes.state_id(F.col("d"))).first()
    assert r.d == '{"method":"GET","status_category":"success","url_group":"a.é"}'
    assert r.i == "state-v5:" + hashlib.sha256(r.d.encode()).hexdigest()
    with pytest.raises(ValueError):
        routes.describe_state(F.col("m"), F.col("u"), F.col("s"), ("url_group", "url_group"))


def test_preprocess(spark):
    rows = [
        ("2026-10-07 10:00:02", "get", "/users/123456", "200", "ok", "1.1.1.1"),
        ("2026-10-07 10:00:01", " ", "/x", "200", "ok", " "),
        ("2026-10-07 10:00:01", "GET", "/x", "200", "invalid_json", ""),
        ("not-a-time", "GET", "/x", "200", "ok", ""),
    ]
    df = spark.createDataFrame(rows, "timestamp string, method string, uri string, status string, parse_status string, ip string")
    kept = preprocess_events(df).orderBy("ts").collect()
    assert [(r.method, r.normalized_uri, r.status_class) for r in kept] == [("UNKNOWN", "/x", "2xx"), ("GET", "/users/:id", "2xx")]
    s = preprocess_summary(df).first()
    assert tuple(s) == (4, 2, 2, 1, 1, 1)
    with pytest.raises(ValueError, match="parse_status"):
        preprocess_events(df.drop("parse_status"))


def test_event_time(spark):
    got = values(spark, lambda c: F.unix_seconds(event_time(c)), ["1970-01-01 00:00:10", "1970-01-01T00:00:10Z", "1970-01-01T02:00:10+02:00", "2026-02-30 00:00:00", None, ""])
    assert got == [10, 10, 10, None, None, None]


def test_upgrade_states(spark):
    rows = [('{"url_group":"a"}', "b", "success", "/x/y", "200"), ("", "b", "", "/x/y", "200"), ("", "", "", "/x/y", "404")]
    df = spark.createDataFrame(rows, "state_description string, url_group string, status_category string, uri string, status string")
    got = [r.state_description for r in upgrade_states(df).collect()]
    assert got == ['{"status_category":"success","url_group":"a"}', '{"status_category":"unknown","url_group":"b"}', '{"status_category":"not_found","url_group":"x.y"}']


def test_a_filter_on_parsed_lines_repeats_no_match(spark):
    """Every match and payload is read once a line, whatever of the result a filter names."""
    lines = spark.range(3).selectExpr("concat('[2026-01-02 03:04:05] local.INFO: x {', id) as raw_line")
    for wanted in ("parse_status = 'malformed_line'", "uri = ''"):
        plan = parse_log_lines(lines, "routes").where(wanted)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1 and plan.count("from_json(") == 1


def test_route_functions_repeat_no_match(spark):
    """A path is matched a fixed few times, however many branches look at it."""
    df = spark.range(3).selectExpr("concat('/a/', id) as uri", "cast(200 + id as string) as status")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(routes.normalize_uri(F.col("uri"))).count("regexp_replace(") <= 3
    assert plan(routes.status_category(F.col("status"))).count("regexp_replace(") == 1
