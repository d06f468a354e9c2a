"""Models, thresholds, density, reports and metrics with closed-form answers."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionscope.config import SessionConfig
from sessionscope.operators import categorical, curate, density, evaluate, markov, reports, scoring, thresholds
from sessionscope.operators.staging import stage
from sessionscope.queries.session_queries import QUERIES


def sequences(spark, *words):
    return spark.createDataFrame([(i, p, c) for i, w in enumerate(words) for p, c in enumerate(w)], "q int, pos int, state_id string")


def fit(spark, smoothing, *words):
    return markov.fit_markov(sequences(spark, *words), smoothing, ("q",))


def test_markov_closed_forms(spark):
    chain = fit(spark, 1e-6, "ABAB")
    assert markov.entropy_rate(chain, markov.stationary(chain)) == pytest.approx(3.4e-5, abs=1e-5)
    uniform = fit(spark, 0.5, "AA", "AB", "BA", "BB")
    pi = {r.state: r.pi for r in markov.stationary(uniform).collect()}
    assert pi == pytest.approx({"A": 0.4117647, "B": 0.4117647, "__UNK__": 0.1764706}, abs=1e-6)
    assert markov.entropy_rate(uniform, markov.stationary(uniform)) == pytest.approx(1.47284, abs=1e-5)
    sparse = {r.state: r.pi for r in markov.stationary(uniform, dense_limit=0, tolerance=1e-10).collect()}
    assert sparse == pytest.approx(pi, abs=1e-6)
    with pytest.raises(ValueError):
        fit(spark, 0.5, "")


def test_markov_scores(spark):
    model = fit(spark, 0.1, "AAABAA")
    steps = markov.score_steps(sequences(spark, "ABB", "AAA", "AXA"), model, ("q",))
    got = {r.q: r for r in markov.score_sequences(steps, ("q",)).collect()}
    assert got[0].information_score > got[1].information_score
    assert [got[i].n_unknown_states for i in range(3)] == [0, 0, 1]
    # A is followed by A 3 times and by B once; three states with the reserved one
    want = -(math.log2(1.1 / 1.3) + math.log2(1.1 / 4.3) + math.log2(0.1 / 1.3)) / 3
    assert got[0].information_score == pytest.approx(want)
    unseen = -(math.log2(1.1 / 1.3) + math.log2(0.1 / 4.3) + math.log2(0.1 / 0.3)) / 3
    assert got[2].information_score == pytest.approx(unseen)
    low = markov.least_probable_transitions(steps, 1, ("q",)).orderBy("q").collect()
    assert [(r.q, r.from_state, r.to_state) for r in low] == [(0, "B", "B"), (1, "A", "A"), (2, "A", "__UNK__")]


def requests(spark, rows):
    return spark.createDataFrame([(ip, 1, i, i, *r) for i, (ip, *r) in enumerate(rows)], "session_ip string, session_no int, pos int, event_seq int, url_group string, status_category string, status string").withColumn("ts", F.timestamp_seconds("event_seq"))


def test_categorical_model(spark):
    train = requests(spark, [("c", "a", "success", "200")] * 3 + [("c", "b", "", "404"), ("c", " ", None, "x")])
    m = categorical.fit_categorical(train, 0.5)
    p = {r.url_group: r.p for r in m.marginal("url_group").collect()}
    assert p == pytest.approx({"a": 3.5 / 7, "b": 1.5 / 7, "unknown": 1.5 / 7, "__UNK__": 0.5 / 7})
    cells = {(r.url_group, r.status_category): r for r in m.cells().collect()}
    assert len(cells) == 16 and sum(c.p_joint for c in cells.values()) == pytest.approx(1)
    assert cells["a", "success"].p_cond == pytest.approx(3.5 / 5) and cells["__UNK__", "success"].p_cond == pytest.approx(0.25)
    h = m.entropies()
    h_url = -sum(x * math.log2(x) for x in p.values())
    given = lambda n: -sum(x * math.log2(x) for x in [(n + 0.5) / (n + 2)] + [0.5 / (n + 2)] * 3)
    assert h["status_given_url"] == pytest.approx(h_url + 3 / 5 * given(3) + 2 / 5 * given(1))
    test = requests(spark, [("d", "a", "success", "200"), ("d", "new", "success", "200"), ("e", "b", "odd", "200"), ("e", "__UNK__", "not_found", "")])
    got = categorical.score_requests(test, m, "status_given_url").orderBy("event_seq").collect()
    assert [(r.unknown_url, r.unknown_status) for r in got] == [(False, False), (True, False), (False, True), (True, False)]
    assert got[0].url_bits == pytest.approx(1) and got[0].status_bits == pytest.approx(-math.log2(0.7))
    assert got[1].url_bits == pytest.approx(-math.log2(0.5 / 7)) and got[1].status_bits == pytest.approx(2)
    joint = categorical.score_requests(test, m, "joint").orderBy("event_seq").first()
    assert (joint.url_bits, joint.status_bits) == pytest.approx((-math.log2(3.5 / 13), 0.0))
    s = {r.session_ip: r for r in categorical.score_sessions(categorical.score_requests(test, m, "independent")).collect()}
    assert s["d"].n_unknown_urls == 1 and s["d"].first_bits == pytest.approx(1 - math.log2(3.5 / 7))
    novel = scoring.novelty_counts(categorical.score_requests(test, m, "joint")).where("novelty_detected").collect()
    assert sorted((r.session_ip, r.unknown_events) for r in novel) == [("d", 1), ("e", 2)]
    with pytest.raises(ValueError):
        categorical.fit_categorical(train.limit(0), 0.5)
    with pytest.raises(ValueError):
        categorical.score_requests(test, m, "other")


def scores(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "information_score double")


def test_aep_threshold(spark):
    assert thresholds.aep_threshold(scores(spark, 1, 2, 3), 2.0, 0.5) == 1.0
    got = thresholds.aep_decision(scores(spark, 2.5, 4, 3), 2.0, 1.0).orderBy("information_score").collect()
    assert [r.aep_anomalous for r in got] == [False, False, True]
    assert thresholds.aep_threshold(scores(spark, 0, 1, 2, 3, 4), 0.0, 0.5) == 2.0  # a whole position
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=999), 2)
    got = thresholds.quantiles(scores(spark, *x).repartition(5), {"a": (F.col("information_score"), (0.0, 0.1, 0.5, 0.99, 1.0)), "b": (-F.col("information_score"), (0.25,))})
    assert got["a"] == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.99, 1.0]).tolist()) and got["b"] == pytest.approx([np.quantile(-x, 0.25)])
    for bad in ([float("inf")], [float("nan")], []):
        with pytest.raises(ValueError):
            thresholds.aep_threshold(scores(spark, *bad), 0.0, 0.5)


def test_density(spark):
    train = scores(spark, -1, -0.5, 0, 0.5, 1, 1)
    m = density.kde_fit(train)
    values = np.array([-1, -0.5, 0, 0.5, 1, 1])
    h = 6 ** (-0.2) * values.std(ddof=1)
    want = lambda x: np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (6 * h * math.sqrt(2 * math.pi))
    got = density.kde_score(scores(spark, 0, 5), m).orderBy("information_score").collect()
    assert got[0].density == pytest.approx(want(0)) and got[1].density == pytest.approx(want(5))
    assert got[1].density_score > got[0].density_score
    assert density.bandwidth_factor("silverman", 6) == pytest.approx(4.5 ** (-0.2)) and density.bandwidth_factor(2, 6) == 2.0
    rng = np.random.default_rng(3)  # more scores than any table of points should hold, and one far away
    many = np.append(rng.gamma(3.0, size=150_000), 400.0)
    m = density.kde_fit(spark.createDataFrame(many.tolist(), "double").toDF("information_score"))
    h = len(many) ** (-0.2) * many.std(ddof=1)
    x = np.array([-1.0, 0.0, 0.3, 2.0, 9.5, 31.0, 399.0, 400.0, 500.0])
    plain = np.array([np.exp(-0.5 * ((v - many) / h) ** 2).sum() for v in x]) / (len(many) * h * math.sqrt(2 * math.pi))
    assert np.abs(m.density(x) - plain).max() < 1e-13 and len(m.cells) < 1000
    for bad in ([1.0], [1.0, 1.0]):
        with pytest.raises(ValueError):
            density.kde_fit(scores(spark, *bad))


def test_fusion_and_report(spark):
    train = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "aep_deviation double, density_score double")
    c = thresholds.component_stats(train, 0.5)
    assert (c.aep_mean, c.aep_sd, c.density_sd) == (2.0, 1.0, 0.0)
    c = thresholds.fusion_thresholds(train, c, 0.5, 1.0)
    assert (c.warning, c.critical) == (0.0, 0.5)
    rows = spark.createDataFrame([("a", 1, 2.0, 9.0, True), ("b", 1, 3.0, 1.0, False), ("c", 1, 0.0, 1.0, False)], "session_ip string, session_no int, aep_deviation double, density_score double, aep_anomalous boolean")
    report = {(r.session_ip, r.mode): r for r in scoring.score_report(thresholds.fusion_score(rows, c), 5.0, c).collect()}
    assert [report[s, "hybrid"].severity for s in "abc"] == ["WARNING", "CRITICAL", "NORMAL"]
    assert report["a", "hybrid"].reasons == [scoring.REASON_AEP, scoring.REASON_DENSITY, "fused normalized AEP/KDE score reached warning severity"]
    assert report["a", "aep"].reasons == [scoring.REASON_AEP] and report["a", "aep"].severity is None
    assert report["c", "aep"].reasons == [] and not report["c", "density"].anomalous


def units(spark, rows):
    return spark.createDataFrame([(i, float(s), bool(y), bool(d)) for i, (s, y, d) in enumerate(rows)], "i int, score double, label boolean, decision boolean")


def test_metrics(spark):
    rows = [(3, 1, 1), (2, 0, 1), (2, 1, 0), (1, 0, 0), (2, 1, 1)]
    df = units(spark, rows)
    r = evaluate.confusion(df).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (2, 1, 1, 1)
    assert (r.precision, r.recall, r.f1, r.final_score, r.false_positive_rate) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 0.5, 0.5))
    pairs = [(a, b) for a, y, _ in rows if y for b, z, _ in rows if not z]
    assert evaluate.roc_auc(df) == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert evaluate.pr_auc(df, [F.col("i")]) == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    none = units(spark, [(1, 0, 0)])
    assert evaluate.roc_auc(none) is None and evaluate.pr_auc(none, [F.col("i")]) is None
    r = evaluate.confusion(none).first()
    assert (r.precision, r.recall, r.f1, r.final_score, r.false_positive_rate, r.false_negative_rate) == (0, 0, 0, 0, 0, None)
    labels = spark.createDataFrame([("a", 1, "", "Yes", None), ("a", 1, "0", "1", ""), ("b", 1, None, None, "x"), ("b", 1, "", "", "")], "session_ip string, session_no int, is_anomaly string, label string, ground_truth string")
    assert {r.session_ip: r.label for r in evaluate.given_labels(labels).collect()} == {"a": True, "b": None}


def test_rank_and_alerts(spark):
    rows = [
        (1, "build", "m", "t", "b1", None, '{"k":1}'), (2, "build", "m", "t", "b2", None, '{"k":2}'), (3, "evaluation", "m", "t", "e1", '{"comparisons":{"aep":{"session_alert_rate":0.2,"metrics":{"f1":0.5}}}}', None),
        (4, "evaluation", "m", None, "e2", '{"comparisons":{"aep":{"session_alert_rate":0.1,"metrics":{"f1":0.7}}}}', '{"own":1}'), (5, "evaluation", "x", "t", "e3", "{}", None),
    ]
    df = spark.createDataFrame(rows, "seq long, type string, model_dir string, model_created_at string, timestamp string, result string, parameters string").withColumn("dataset", F.lit("d"))
    best = reports.rank_experiments(df, "aep", "f1").collect()
    assert [(r.seq, r.score, r.parameters) for r in best] == [(4, 0.7, '{"own":1}'), (3, 0.5, '{"k":2}'), (5, None, None)]
    assert [r.seq for r in reports.rank_experiments(df, "aep", "clean_alert_rate").collect()] == [4, 3, 5]
    alerts = spark.createDataFrame([(1, 10, None, "Alpha", False), (2, 5, 30, "beta", False)], "alert_id long, created_at long, updated_at long, ip string, acknowledged boolean")
    assert [r.alert_id for r in reports.list_alerts(alerts, 0).collect()] == [2]
    assert [r.alert_id for r in reports.list_alerts(alerts, 10, "ALPHA").collect()] == [1]
    acks = spark.createDataFrame([(1, 11, True), (1, 10, False), (2, 29, True)], "alert_id long, at long, acknowledged boolean")
    assert {r.alert_id: r.acknowledged for r in reports.acknowledge_alerts(alerts, acks).collect()} == {1: True, 2: False}


def test_config_is_checked():
    SessionConfig()
    for bad in ({"mode": "x"}, {"smoothing": 0}, {"state_fields": ()}, {"training_ratio": 0.9}, {"bandwidth": "x"}, {"bandwidth": -1.0}, {"aep_quantile": 2}, {"warning_quantile": 0.999}, {"timeout_seconds": 0}, {"alpha": 2}, {"epsilon": 0}):
        with pytest.raises(ValueError):
            SessionConfig(**bad)


def test_markov_queries_take_every_conversation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    roles, scored = defaultdict(list), defaultdict(list)
    for r in rows:
        roles[r.conv_id].append(r.role)
        scored[r.conv_id].append("tool" if r.turn % 7 == 6 else r.role)
    first = Counter(x[0] for x in roles.values())
    steps = Counter(p for x in roles.values() for p in zip(x, x[1:]))  # noqa: B905
    total = Counter()
    for (a, _), n in steps.items():
        total[a] += n
    known = {r.role for r in rows}
    k = len(known | {"__UNK__"})
    p_first = lambda s: (first[s] + 0.5) / (len(roles) + 0.5 * k)
    p_step = lambda a, b: (steps[a, b] + 0.5) / (total[a] + 0.5 * k)
    assert {(r.from_state, r.to_state): r.n for r in QUERIES["transition_probabilities"](spark, sf_dir).collect()} == steps
    initial = {r.state: r.p_initial for r in QUERIES["initial_probabilities"](spark, sf_dir).collect()}
    assert initial == pytest.approx({s: p_first(s) for s in known | {"__UNK__"}}, abs=1e-6)
    got = {r.conv_id: r for r in QUERIES["score_sequences"](spark, sf_dir).collect()}
    assert set(got) == set(roles)
    least = Counter(r.conv_id for r in QUERIES["least_probable_transitions"](spark, sf_dir).collect())
    for c, raw in scored.items():
        states = [s if s in known else "__UNK__" for s in raw]
        bits = math.log2(p_first(states[0])) + sum(math.log2(p_step(a, b)) for a, b in zip(states, states[1:]))  # noqa: B905
        assert (got[c].n_events, got[c].n_unknown_states) == (len(raw), states.count("__UNK__"))
        assert got[c].log_probability == pytest.approx(bits, abs=1e-5)
        assert least[c] == min(5, len(raw) - 1)


def test_stationary_of_a_large_nearly_periodic_chain(spark):
    """5,000 states in three classes that follow each other: within 60 rounds, by what the driver sees of it."""
    import numpy as np

    k, rng = 5000, np.random.default_rng(3)
    to = {}
    for i in range(k):
        for j in rng.integers(0, k // 3, 4).tolist():
            cell = (i, (i + 1) % 3 + 3 * j) if (i + 1) % 3 + 3 * j < k else (i, (i + 1) % 3)
            to[cell] = to.get(cell, 0) + int(rng.integers(1, 9))
    n_from = np.zeros(k)
    for (i, _), n in to.items():
        n_from[i] += n
    states = spark.createDataFrame([(f"s{i:04d}", 0, int(n)) for i, n in enumerate(n_from)], "state string, n_first bigint, n_from bigint")
    steps = spark.createDataFrame([(f"s{i:04d}", f"s{j:04d}", n) for (i, j), n in to.items()], "from_state string, to_state string, n bigint")
    a = 1e-6
    model = markov.MarkovModel(states, steps, a, k, 1)
    pi = np.array([r.pi for r in markov.stationary(model, tolerance=1e-12, most_rounds=60).orderBy("state").collect()])
    row = n_from + a * k
    moved = np.full(k, (pi * a / row).sum())
    for (i, j), n in to.items():
        moved[j] += pi[i] * n / row[i]
    assert len(pi) == k and abs(pi.sum() - 1) < 1e-9 and (pi > 0).all() and np.abs(moved - pi).max() < 1e-9


def test_analysis_of_a_folder(spark, tmp_path):
    """From raw lines to the requests of anomalous sessions, with what was left out and why."""
    from sessionscope.jobs import workflow

    line = '[2026-10-07 10:{:02d}:{:02d}] local.INFO: Route request completed. {{"method":"GET","route_name":"","uri":"{}","status":{},"ip":"{}"}}'
    rng = random.Random(5)
    good = [line.format(i // 60, i % 60, rng.choice(["/a/x", "/a/y", "/b/z"]), rng.choice([200, 200, 404]), f"c{i % 4}") for i in range(400)]
    odd = [line.format(i, i, f"/never/seen{i}/q", 500, "bad") for i in range(3)]
    upload = [*good[:50], "broken", "", line.format(61, 0, "/a/x", 200, "c1"), line.format(1, 1, "/health", 200, ""), line.format(1, 2, "/a/x", 200, ""), *odd]
    for name, part in (("train", good[:300]), ("check", good[300:]), ("live", upload)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "routes-1.log").write_text("\n".join(part) + "\n")
    (tmp_path / "live" / "routes-empty.log").write_text("")
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    lists = workflow.RouteLists(frame([("/health",)], "path string"), frame([], "route_name string"), frame([("*", "/a/x"), ("*", "/a/y"), ("*", "/b/z")], "method string, path string"), frame([], "route_name string"))
    config = SessionConfig(timeout_seconds=100, min_events=1)
    workflow.train_from_logs(spark, str(tmp_path / "train"), str(tmp_path / "check"), str(tmp_path / "model"), config, lists)
    found = workflow.analyze_folder(spark, str(tmp_path / "live"), str(tmp_path / "model"), lists)
    assert found.parse.select("files", "ok_rows", "bad_rows").first()[:] == (2, 56, 2)
    s = found.preprocessing.first()
    assert (s.input_rows, s.processed_rows, s.skipped_rows, s.skipped_parse_status, s.skipped_invalid_timestamp, s.skipped_excluded_route, s.rows_without_ip) == (58, 54, 4, 2, 1, 1, 1)
    bad = found.activities.where("session_ip = 'bad'").orderBy("pos").collect()
    assert [(r.source_file, r.line_number, r.raw_line, r.normalized_uri) for r in bad] == [("routes-1.log", 56 + i, x, f"/never/seen{i}/q") for i, x in enumerate(odd)]
    keys = {(r.session_ip, r.session_no) for r in found.anomalies.collect()}
    assert ("bad", 1) in keys and {(r.session_ip, r.session_no) for r in found.activities.collect()} == keys
    assert {r.mode for r in found.comparison.collect()} == {"aep", "density", "hybrid"}


def test_folder_jobs_write_once_what_they_read(spark, tmp_path, monkeypatch):
    """Training writes no column that it doesn't read; an analysis builds and scores its sessions once."""
    from sessionscope.jobs import detector as jobs
    from sessionscope.jobs import workflow

    line = '[2026-10-07 10:{:02d}:{:02d}] local.INFO: Route request completed. {{"method":"GET","route_name":"","uri":"{}","status":{},"ip":"{}"}}'
    good = [line.format(i // 60, i % 60, ("/a/x", "/a/y")[i % 7 % 2], (200, 404)[i % 5 % 2], f"c{i % 4}") for i in range(200)]
    for name, part in (("train", good[:120]), ("check", good[120:]), ("live", good[:50])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "routes-1.log").write_text("\n".join(part) + "\n")
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    lists = workflow.RouteLists(frame([], "path string"), frame([], "route_name string"), frame([("*", "/a/x"), ("*", "/a/y")], "method string, path string"), frame([], "route_name string"))
    written = []

    def noting(df, name):
        written.append((name, set(df.columns)))
        return stage(df, name)

    for module in (workflow, jobs, curate):
        monkeypatch.setattr(module, "stage", noting)
    workflow.train_from_logs(spark, str(tmp_path / "train"), str(tmp_path / "check"), str(tmp_path / "model"), SessionConfig(timeout_seconds=10, min_events=1), lists)
    assert written and not any(columns & {"raw_line", "state_id", "state_description"} for _, columns in written)
    written.clear()
    workflow.analyze_folder(spark, str(tmp_path / "live"), str(tmp_path / "model"), lists)
    assert sum({"pos", "n_events", "method"} <= columns for _, columns in written) == 1 and sum("reasons" in columns and "mode_score" in columns and "label" not in columns for _, columns in written) == 1


def test_without_labels_no_request_is_asked(spark, monkeypatch):
    """A log without labels: the counts of the modes follow from the report alone, and a request's time is read once."""
    from sessionscope.jobs import detector as jobs
    from sessionscope.operators import prepare

    sessions = spark.sql("select 'a' as session_ip, 1 as session_no")
    report = spark.sql("select 'a' as session_ip, 1 as session_no, 'aep' as mode, true as anomalous, 0.5d as mode_score, timestamp'2026-01-01 00:00:00' as start_time")
    monkeypatch.setattr(jobs, "stage", lambda *_: pytest.fail("requests were asked"))
    rows = jobs.metrics_by_mode(sessions, report).collect()
    assert [(r["mode"], r.sessions, r.anomalous_sessions, r.f1, r.roc_auc) for r in rows] == [("aep", 1, 1, None, None)]
    parsed = spark.range(2).selectExpr("concat('2026-01-01 00:00:0', id) as timestamp", "'GET' as method", "'/a' as uri", "'200' as status", "'ok' as parse_status")
    plan = prepare.preprocess_events(parsed).select("ts")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lower().count("[+-][0-9]{2}") for line in plan.splitlines()) == 1


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    """The counts of the blocks go to the lines, whatever size is guessed for them."""
    from sessionscope.sources import logs

    (tmp_path / "routes-1.log").write_text("a\nb\n")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = logs.read_log_lines(spark, str(tmp_path), "routes")
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.line_number, r.raw_line) for r in df.collect()) == [(1, "a"), (2, "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_equal_scores_count_once(monkeypatch):
    """A density at equal places is summed up once, and is the same at each."""
    model = density.DensityModel(np.array([-2, 0, 3]), np.ones((3, density.ORDER)), 3, 0.7, 1e-12)
    places = np.array([0.3, -1.0, 0.3, 2.5] * 500)
    rows, exp = [], np.exp
    monkeypatch.setattr(density.np, "exp", lambda x: rows.append(len(x)) or exp(x))
    got = model.density(places)
    assert sum(rows) == 3 and (got.reshape(500, 4) == got[:4]).all() and got[0] == got[2] != got[1]
    assert len(model.density(np.array([]))) == 0


def test_counts_of_a_model_are_written_once(spark):
    """The model's tables follow from a written table, not from the requests, which are read once."""
    model = categorical.fit_categorical(spark.createDataFrame([("a", "success"), ("a", "redirect")], "url_group string, status_category string"), 0.5)
    assert model.pairs.inputFiles() and (model.n_events, model.n_urls, model.n_statuses) == (2, 2, 3)
