"""The registered queries of the session jobs: each operator applied to whole test tables, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.functions import routes
from sessionscope.functions.parse import parse_log_lines, parse_summary
from sessionscope.jobs import detector as jobs
from sessionscope.jobs import monitor, workflow
from sessionscope.operators import categorical, curate, density, evaluate, markov, prepare, reports, scoring, sessions, thresholds
from sessionscope.operators.ordering import with_global_index
from sessionscope.operators.staging import shared_dir, stage
from sessionscope.queries import tables as t
from sessionscope.sources import logs, models, tail
from sessionscope.streaming import closing, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]
KEY = ("session_ip", "session_no")


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _rq(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources, parsing, preparation


@query(f"with {t.LINES} select raw_line, row_number() over (partition by event_seq % 8 order by event_seq) as line_number from lines")
def read_log_lines(spark, sf_dir):
    path = _folder(spark, "log-lines")
    lines = t.log_lines(spark, sf_dir).withColumn("file", F.col("event_seq") % 8)  # a file each
    lines.repartition("file").sortWithinPartitions("file", "event_seq").select("file", "raw_line").write.partitionBy("file").text(path)
    return logs.read_log_lines(spark, path, "routes", glob="*.txt").select("raw_line", "line_number")


@query("select event_id, user_id, event_type from events")
def read_events(spark, sf_dir):
    return logs.read_events(spark, f"{sf_dir}/events.parquet", ("event_id", "ts", "user_id", "event_type")).select("event_id", "user_id", "event_type")


@query(f"with {t.PARSED} select parse_status, count(*) as n, count(distinct raw_line) as lines from parsed group by 1")
def write_tables(spark, sf_dir):
    path = _folder(spark, "parsed")
    logs.write_tables(parse_log_lines(t.log_lines(spark, sf_dir), "routes"), path, "parse_status")
    return spark.read.parquet(path).groupBy("parse_status").agg(F.count("*").alias("n"), F.countDistinct("raw_line").alias("lines"))


@query(f"with {t.PARSED} select * from parsed", "parse_log_lines")
def parse_lines(spark, sf_dir):
    return parse_log_lines(t.log_lines(spark, sf_dir), "routes")


@query(f"with {t.PARSED} select 'routes' as log_type, count(*) filter (parse_status = 'ok') as ok_rows, count(*) filter (parse_status <> 'ok') as bad_rows from parsed", "parse_summary")
def parse_counts(spark, sf_dir):
    return parse_summary(parse_log_lines(t.log_lines(spark, sf_dir), "routes").withColumn("log_type", F.lit("routes")))


@query(f"with {t.PARSED} select event_seq, parse_status from parsed")
def parse_status(spark, sf_dir):
    return parse_log_lines(t.log_lines(spark, sf_dir), "routes").select("event_seq", "parse_status")


@query(f"with {t.PARSED} select event_seq, \"timestamp\" from parsed where parse_status = 'malformed_line'")
def fallback_timestamp(spark, sf_dir):
    return parse_log_lines(t.log_lines(spark, sf_dir), "routes").where("parse_status = 'malformed_line'").select("event_seq", "timestamp")


_PAGE_URI = "concat(regexp_replace(url, '[?#].*$', ''), '/', cast(page_id as {t}), '0000/', case when page_id % 3 = 0 then '{{ref}}' when page_id % 3 = 1 then '550E8400-e29b-41d4-a716-446655440000' else 'A b' end, '?q=', cast(page_id as {t}))"


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{_PAGE_URI.format(t='string')} as uri")


_PAGES_SQL = f"""pg as (select page_id, {_PAGE_URI.format(t='varchar')} as uri from pages),
norm as (select page_id, array_to_string(list_transform(string_split({t._PATH}, '/'), lambda s: {t._SEGMENT}), '/') as normalized_uri from pg),
grp as (select *, list_filter(string_split(lower(normalized_uri), '/'), lambda s: s <> '' and s <> ':id') as g from norm)"""


@query(f"with {_PAGES_SQL} select * from norm")
def normalize_uri(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", routes.normalize_uri(F.col("uri")).alias("normalized_uri"))


@query(f"with {_PAGES_SQL} select page_id, case when len(g) = 0 then 'root' when g[1] = 'api' and len(g) >= 3 then concat(g[1], '.', g[2], '.', g[3]) when len(g) >= 2 then concat(g[1], '.', g[2]) else concat('route.', g[1]) end as url_group from grp")
def url_group(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", routes.url_group(routes.normalize_uri(F.col("uri"))).alias("url_group"))


@query(f"with {t.PREP} select event_seq, status_class from prep")
def status_class(spark, sf_dir):
    return t.requests(spark, sf_dir).select("event_seq", routes.status_class(F.col("status")).alias("status_class"))


@query(f"with {t.PREP} select event_seq, status_category from prep")
def status_category(spark, sf_dir):
    return t.requests(spark, sf_dir).select("event_seq", routes.status_category(F.col("status")).alias("status_category"))


_STATE = """concat('{"status_category":"', status_category, '","url_group":"', url_group, '"}')"""


@query(f"with {t.PREP} select event_seq, {_STATE} as state_description, concat('state-v5:', sha256({_STATE})) as state_id from prep")
def encode_state(spark, sf_dir):
    return t.prepared(spark, sf_dir).select("event_seq", "state_description", "state_id")


@query(f"with {t.PARSED} select event_seq, method, uri, status, ip, case when event_seq % 3 < 3 then cast(\"timestamp\" as timestamp) end as ts from parsed where parse_status = 'ok'")
def preprocess_events(spark, sf_dir):
    return prepare.preprocess_events(parse_log_lines(t.log_lines(spark, sf_dir), "routes")).select("event_seq", "method", "uri", "status", "ip", F.col("ts").cast("timestamp_ntz").alias("ts"))


#: some lines' months are 13, some addresses are blank
_SPOILT_LINE = "case when event_id % 23 = 0 then regexp_replace(raw_line, '-[0-9][0-9]-', '-13-') when event_id % 29 = 0 then regexp_replace(raw_line, '\"ip\":\"[^\"]*\"', '\"ip\":\" \"') else raw_line end"


@query(
    f"""with {t.PARSED}, x as (select *, parse_status = 'ok' as ok, event_seq % 23 = 0 as late, event_seq % 29 = 0 as blank from parsed)
    select count(*) as input_rows, count(*) filter (ok and not late) as processed_rows, count(*) filter (not ok or late) as skipped_rows,
    count(*) filter (not ok) as skipped_parse_status, count(*) filter (ok and late) as skipped_invalid_timestamp, count(*) filter (ok and not late and blank) as rows_without_ip from x"""
)
def preprocess_summary(spark, sf_dir):
    lines = t.log_lines(spark, sf_dir).withColumn("event_id", F.col("event_seq")).withColumn("raw_line", F.expr(_SPOILT_LINE)).drop("event_id")
    return prepare.preprocess_summary(parse_log_lines(lines, "routes"))


@query(
    f"""with {t.PREP}, old as (select event_seq, case when event_seq % 4 = 0 then concat('{{"url_group":"', url_group, '"}}') end as d, case when event_seq % 4 < 2 then url_group else '' end as ug, case when event_seq % 4 = 1 then status_category else '' end as sc, url_group, status_category from prep),
    up as (select event_seq, case when d is not null or ug <> '' or sc <> '' then case when ug <> '' then ug else 'unknown' end else url_group end as u, case when d is not null or ug <> '' or sc <> '' then case when sc <> '' then sc else 'unknown' end else status_category end as s from old)
    select event_seq, concat('{{"status_category":"', s, '","url_group":"', u, '"}}') as state_description from up"""
)
def upgrade_states(spark, sf_dir):
    p = t.prepared(spark, sf_dir)
    k = F.col("event_seq") % 4
    old = p.select(
        "event_seq", "method", "uri", "status",
        F.when(k == 0, F.concat(F.lit('{"url_group":"'), "url_group", F.lit('"}'))).otherwise("").alias("state_description"),
        F.when(k < 2, F.col("url_group")).otherwise("").alias("url_group"),
        F.when(k == 1, F.col("status_category")).otherwise("").alias("status_category"),
    )
    return prepare.upgrade_states(old).select("event_seq", "state_description")


# ---- curation


def _kept(spark, sf_dir):
    return curate.exclude_routes(t.prepared(spark, sf_dir), t.excluded_paths(spark, sf_dir), t.excluded_names(spark, sf_dir))


def _curated(spark, sf_dir):
    return curate.curate(_kept(spark, sf_dir), t.inventory(spark, sf_dir), t.listed_names(spark, sf_dir))


@query(f"with {t.PREP}, {t.EXCLUDED} select event_seq from kept")
def exclude_routes(spark, sf_dir):
    return _kept(spark, sf_dir).select("event_seq")


@query(f"with {t.PREP}, {t.flagged_sql('prep')} select event_seq, by_path, by_name from flagged")
def allowlist_flag(spark, sf_dir):
    return curate.allowlist_flag(t.prepared(spark, sf_dir), t.inventory(spark, sf_dir), t.listed_names(spark, sf_dir)).select("event_seq", "by_path", "by_name")


_CURATED = f"{t.PREP}, {t.EXCLUDED}, {t.curated_sql('kept')}"
#: a shorter timeout, so that sessions stay short enough for some to be clean
_CONTROLLED = f"{_CURATED},{t.sessions_sql('curated', 'cs', timeout=600, min_events=1)}, ctl as (select event_seq, case when bool_or(classification = 'review') over w then 'review' else classification end as classification, case when bool_or(classification = 'review') over w then 'session_contains_unallowlisted_route' else reason end as reason from cs window w as (partition by session_ip, session_no))"


@query(f"with {_CURATED} select event_seq, classification, reason from curated", "curate")
def curate_events(spark, sf_dir):
    return _curated(spark, sf_dir).select("event_seq", "classification", "reason")


@query(f"with {_CONTROLLED} select * from ctl")
def session_control(spark, sf_dir):
    curated = _curated(spark, sf_dir).select("event_seq", "ts", "ip", "classification", "reason")  # written once, so without states
    return curate.session_control(curated, 600).select("event_seq", "classification", "reason")


@query(
    f"""with {t.PREP}, hotp as (select * replace (case when event_seq % 2 = 1 then '' else ip end as ip) from prep), {t.curated_sql("hotp")},{t.sessions_sql("curated", "cs", timeout=20, min_events=1)}
    select event_seq, case when bool_or(classification = 'review') over w then 'review' else classification end as classification, case when bool_or(classification = 'review') over w then 'session_contains_unallowlisted_route' else reason end as reason from cs window w as (partition by session_ip, session_no)"""
)
def session_control_hot(spark, sf_dir):
    curated = curate.curate(_hot(spark, sf_dir), t.inventory(spark, sf_dir), t.listed_names(spark, sf_dir))
    return curate.session_control(curated, 20).select("event_seq", "classification", "reason")


@query(f"with {_CONTROLLED} select classification, reason, count(*) as n_requests from ctl group by 1, 2")
def curation_summary(spark, sf_dir):
    return curate.curation_summary(curate.session_control(_curated(spark, sf_dir), 600))


@query(
    f"""with {_CONTROLLED} select part, count(*) as n, sum(event_seq) as total from ctl cross join (values ('train'), ('validate')) p(part) where classification = 'normal' group by 1 union all select part, count(*), sum(event_seq) from kept cross join (values ('upload'), ('validate_loose')) p(part) group by 1
    union all select part, count(*), sum(event_seq) from prep cross join (values ('test'), ('detect')) p(part) group by 1"""
)
def partition_policy(spark, sf_dir):
    p = t.prepared(spark, sf_dir)
    args = {"paths": t.excluded_paths(spark, sf_dir), "route_names": t.excluded_names(spark, sf_dir), "inventory": t.inventory(spark, sf_dir), "names": t.listed_names(spark, sf_dir), "timeout_seconds": 600}
    parts = {part: curate.partition_policy(p, part, **args) for part in ("train", "validate", "upload", "test", "detect")}
    parts["validate_loose"] = curate.partition_policy(p, "validate", **args, allowlist_in_validation=False)
    sums = [rows.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("event_seq").alias("total")) for part, rows in parts.items()]
    return reduce(DataFrame.unionByName, sums)


@query(f"with {t.PREP} select concat('state-v5:', sha256({_STATE})) as state_id, any_value({_STATE}) as state_description, 1 as descriptions from prep group by 1")
def state_catalog(spark, sf_dir):
    return curate.check_catalog(curate.state_catalog(t.prepared(spark, sf_dir)))


# ---- sessions, windows, splits


def _sessions(spark, sf_dir):
    return sessions.ip_sessions(t.prepared(spark, sf_dir), t.CONFIG.timeout_seconds, t.CONFIG.min_events)


@query(f"with {t.SESSIONS} select event_seq, session_ip, session_no, pos, n_events from sess")
def ip_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("event_seq", "session_ip", "session_no", "pos", "n_events")


@query(f"with {t.REQ},{t.sessions_sql('req', 'sess', min_events=1)} select event_seq, session_ip, session_no from sess")
def sliced_sessions(spark, sf_dir):
    return sessions.number_sessions(t.requests(spark, sf_dir), 21_600).select("event_seq", "session_ip", "session_no")


#: half of all requests from one client: those of odd numbers have no address
_HOT_REQ = "hot as (select * replace (case when event_seq % 2 = 1 then '' else ip end as ip) from prep)"


def _hot(spark, sf_dir):
    return t.prepared(spark, sf_dir).withColumn("ip", F.when(F.col("event_seq") % 2 == 1, "").otherwise(F.col("ip")))


@query(f"with {t.PREP},{_HOT_REQ},{t.sessions_sql('hot', 'sess', timeout=600, min_events=2)} select event_seq, session_ip, session_no, pos, n_events, cast(epoch_us(session_start) as bigint) as start_us from sess")
def ip_sessions_hot(spark, sf_dir):
    rows = sessions.ip_sessions(_hot(spark, sf_dir), 600, 2)
    return rows.select("event_seq", "session_ip", "session_no", "pos", "n_events", F.unix_micros("session_start").alias("start_us"))


_ORDERS = "select o_orderkey as event_seq, o_orderdate as ts, cast(o_custkey as {t}) as ip from orders"


def _orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_orderkey as event_seq", "cast(o_orderdate as timestamp) as ts", "cast(o_custkey as string) as ip", "o_orderstatus as state_id")


@query(f"with ord as ({_ORDERS.format(t='varchar')}),{t.sessions_sql('ord', 'sess', timeout=60 * 86_400, min_events=2)} select event_seq, session_ip, session_no, pos, n_events from sess")
def ip_sessions_orders(spark, sf_dir):
    return sessions.ip_sessions(_orders(spark, sf_dir), 60 * 86_400, 2).select("event_seq", "session_ip", "session_no", "pos", "n_events")


@query("with x as (select o_orderkey as event_seq, row_number() over (order by o_orderdate, o_orderkey) - 1 as i, count(*) over () as n from orders) select event_seq, cast(i // 7 as bigint) as window_no, cast(i % 7 as integer) as pos from x where i // 7 < n // 7")
def fixed_count_windows(spark, sf_dir):
    return sessions.fixed_count_windows(_orders(spark, sf_dir), 7).select("event_seq", "window_no", "pos")


@query("select event_id as event_seq, cast((epoch_us(ts) - min(epoch_us(ts)) over ()) // 3600000000 as bigint) as window_no from events")
def fixed_time_windows(spark, sf_dir):
    return sessions.fixed_time_windows(t.requests(spark, sf_dir), 3600).select("event_seq", "window_no")


@query(
    f"""with {t.SESSIONS}, rec as (select session_ip, session_no, min(ts) as start_time, min(event_seq) filter (pos = 0) as first_seq, cast(count(*) as integer) as n_events, string_agg(concat('state-v5:', sha256({_STATE})), ',' order by pos) as states from sess group by 1, 2)
    select row_number() over (order by start_time, first_seq) - 1 as window_id, session_ip, session_no, n_events, md5(states) as states_md5 from rec"""
)
def window_records(spark, sf_dir):
    records = sessions.window_records(sessions.session_records(_sessions(spark, sf_dir)))
    return records.select("window_id", "session_ip", "session_no", "n_events", F.md5(F.array_join("states", ",").cast("binary")).alias("states_md5"))


@query(
    f"""with {t.SESSIONS}, rec as (select session_ip, session_no, min(ts) as start_time, min(event_seq) filter (pos = 0) as first_seq from sess group by 1, 2),
    i as (select *, row_number() over (order by start_time, first_seq) - 1 as i, count(*) over () as n from rec)
    select session_ip, session_no, case when i < floor(n * 0.65::double) then 'training' when i < floor(n * 0.65::double) + floor(n * 0.15::double) then 'validation' else 'testing' end as split from i"""
)
def split_windows(spark, sf_dir):
    records = sessions.session_records(_sessions(spark, sf_dir))
    split = sessions.split_by_position(records, [F.col("first_event.ts"), F.col("first_event.event_seq")])
    return split.select("session_ip", "session_no", "split")


@query(f"with {t.SPLIT} select event_seq, split from parts")
def split_events(spark, sf_dir):
    return t.split_requests(spark, sf_dir).select("event_seq", "split")


# ---- categorical model


def _parts(spark, sf_dir):
    rows = t.split_requests(spark, sf_dir)
    return tuple(rows.where(F.col("split") == s) for s in ("training", "validation", "testing"))


def _model(spark, sf_dir):
    """(model, test sessions scored by request)"""
    train, _, test = _parts(spark, sf_dir)
    model = categorical.fit_categorical(sessions.ip_sessions(train, t.CONFIG.timeout_seconds, t.CONFIG.min_events), t.CONFIG.smoothing)
    return model, sessions.ip_sessions(test, t.CONFIG.timeout_seconds, t.CONFIG.min_events)


@query(f"with {t.MODEL} select url_group, cast(n as bigint) as n, {_rq('p')} from url_p")
def url_marginals(spark, sf_dir):
    return _model(spark, sf_dir)[0].marginal("url_group").select("url_group", "n", *_r("p"))


@query(f"with {t.MODEL} select status_category, cast(n as bigint) as n, {_rq('p')} from kind_p")
def status_marginals(spark, sf_dir):
    return _model(spark, sf_dir)[0].marginal("status_category").select("status_category", "n", *_r("p"))


@query(f"with {t.MODEL} select url_group, status_category, round(p_joint, 9) as p_joint from cells")
def joint_probabilities(spark, sf_dir):
    return _model(spark, sf_dir)[0].cells().select("url_group", "status_category", F.round("p_joint", 9).alias("p_joint"))


@query(f"with {t.MODEL} select url_group, status_category, {_rq('p_cond')} from cells")
def conditional_probabilities(spark, sf_dir):
    return _model(spark, sf_dir)[0].cells().select("url_group", "status_category", *_r("p_cond"))


@query(f"with {t.MODEL} select round(h_url, 6) as h_url, round(h_status, 6) as h_status, round(h_pair, 6) as joint, round(h_url + h_given, 6) as status_given_url, round(h_url + h_status, 6) as independent from ent")
def entropy_reference(spark, sf_dir):
    h = _model(spark, sf_dir)[0].entropies()
    row = spark.range(1).select(*[F.lit(h[k]).alias(n) for n, k in (("h_url", "url"), ("h_status", "status"), ("joint", "joint"), ("status_given_url", "status_given_url"), ("independent", "independent"))])
    return row.select(*_r(*row.columns))


@query(f"with {t.MODEL} select event_seq, {_rq('url_bits', 'status_bits')}, unknown_url, unknown_status from bits where split = 'testing'")
def score_requests(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    return categorical.score_requests(test, model, "status_given_url").select("event_seq", *_r("url_bits", "status_bits"), "unknown_url", "unknown_status")


@query(
    f"""with {t.MODEL} select x.event_seq, round(-log2((coalesce(c.n, 0) + 0.5) / (n_events + 0.5 * n_u * n_s)), 6) as joint_bits, round(-log2((coalesce(b.n, 0) + 0.5) / (tot.n_events + 0.5 * n_s)), 6) as status_bits
    from sess x cross join (select n_events as ne, * from tot) tot left join kinds b on b.s = x.status_category left join pairs c on c.u = x.url_group and c.s = x.status_category where split = 'testing'""".replace("(n_events + 0.5 * n_u * n_s)", "(ne + 0.5 * n_u * n_s)").replace("tot.n_events", "ne")
)
def score_requests_other_modes(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    joint = categorical.score_requests(test, model, "joint").select("event_seq", F.round("url_bits", 6).alias("joint_bits"))
    alone = categorical.score_requests(test, model, "independent").select("event_seq", *_r("status_bits"))
    return joint.join(alone, "event_seq")


@query(f"with {t.MODEL} select session_ip, session_no, n_events, {_rq('log_probability', 'information_score')}, round(power(2, -first_bits), 6) as p_first, n_unknown_urls, n_unknown_statuses from scores where split = 'testing'")
def score_sessions(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    scored = jobs.session_scores(test, model, "status_given_url")
    return scored.select(*KEY, "n_events", *_r("log_probability", "information_score"), F.round(categorical.first_probability(F.col("first_bits")), 6).alias("p_first"), "n_unknown_urls", "n_unknown_statuses")


# ---- Markov model: roles of conversations

_CONV = """nxt as (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as nx, row_number() over (partition by conv_id order by turn) as rn from conversations),
st as (select role as state, count(*) filter (rn = 1) as n_first, count(nx) as n_from from nxt group by 1 union all select '__UNK__', 0, 0),
step as (select role as f, nx as t, count(*) as n from nxt where nx is not null group by 1, 2),
k as (select count(*)::double as k, sum(n_first)::double as ns from st)"""
_CONV_SCORED = f"""{_CONV},
tst as (select conv_id, turn, coalesce(st.state, '__UNK__') as state, st.state is null as unknown from (select conv_id, turn, case when turn % 7 = 6 then 'tool' else role end as role from conversations) x left join st on st.state = x.role),
prv as (select *, lag(state) over (partition by conv_id order by turn) as prev from tst),
sc as (select p.*, case when prev is null then (a.n_first + 0.5) / (ns + 0.5 * k) else (coalesce(step.n, 0) + 0.5) / (b.n_from + 0.5 * k) end as p from prv p cross join k join st a on a.state = p.state left join st b on b.state = p.prev left join step on step.f = p.prev and step.t = p.state)"""


def _markov(spark, sf_dir):
    """The model of all conversations, and all of them to be scored, every seventh turn replaced by another role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("state_id"))
    scored = c.withColumn("state_id", F.when(F.col("pos") % 7 == 6, "tool").otherwise(F.col("state_id")))
    return markov.fit_markov(c, 0.5, ("conv_id",)), scored


@query(f"with {_CONV} select state, round((n_first + 0.5) / (ns + 0.5 * k), 6) as p_initial from st, k")
def initial_probabilities(spark, sf_dir):
    return _markov(spark, sf_dir)[0].initial().select("state", *_r("p_initial"))


@query(f"with {_CONV} select f as from_state, t as to_state, n, round((n + 0.5) / (n_from + 0.5 * k), 6) as p, round(0.5 / (n_from + 0.5 * k), 6) as p_default from step join st on st.state = f, k")
def transition_probabilities(spark, sf_dir):
    return _markov(spark, sf_dir)[0].transitions().select("from_state", "to_state", "n", *_r("p", "p_default"))


_POWER = f"""{_CONV},
cell as (select a.state as f, b.state as t, (coalesce(s.n, 0) + 0.5) / (a.n_from + 0.5 * k) as p from st a cross join st b cross join k left join step s on s.f = a.state and s.t = b.state)"""
_STATIONARY = (
    _POWER
    + ", m0 as (select f, t, 0.5 * p + case when f = t then 0.5 else 0 end as p from cell)"
    + "".join(f", m{i + 1} as (select a.f, b.t, sum(a.p * b.p) as p from m{i} a join m{i} b on a.t = b.f group by 1, 2)" for i in range(14))
    + ", pi as (select t as state, avg(p) as pi from m14 group by 1)"
)


@query(f"with {_STATIONARY} select state, round(pi, 6) as pi from pi", "stationary_distribution")
def stationary_distribution(spark, sf_dir):
    return markov.stationary(_markov(spark, sf_dir)[0]).select("state", *_r("pi"))


@query(f"with {_STATIONARY} select state, round(pi, 6) as pi from pi")
def stationary_sparse(spark, sf_dir):
    return markov.stationary_sparse(_markov(spark, sf_dir)[0]).select("state", *_r("pi"))


@query(f"with {_STATIONARY} select round(sum(pi * -p * log2(p)), 6) as entropy_rate from pi join cell on cell.f = pi.state")
def entropy_rate(spark, sf_dir):
    model, _ = _markov(spark, sf_dir)
    return spark.range(1).select(F.round(F.lit(markov.entropy_rate(model, markov.stationary(model))), 6).alias("entropy_rate"))


@query(f"with {_CONV_SCORED} select conv_id, cast(count(*) as integer) as n_events, round(sum(log2(p)), 6) as log_probability, round(-avg(log2(p)), 6) as information_score, cast(count(*) filter (unknown) as integer) as n_unknown_states from sc group by 1")
def score_sequences(spark, sf_dir):
    model, test = _markov(spark, sf_dir)
    scored = markov.score_sequences(markov.score_steps(test, model, ("conv_id",)), ("conv_id",))
    return scored.select("conv_id", "n_events", *_r("log_probability", "information_score"), "n_unknown_states")


@query(f"with {_CONV_SCORED}, rk as (select *, row_number() over (partition by conv_id order by p, turn) as r from sc where prev is not null) select conv_id, cast(r as integer) as \"rank\", turn as pos, prev as from_state, state as to_state, round(p, 6) as p from rk where r <= 5")
def least_probable_transitions(spark, sf_dir):
    model, test = _markov(spark, sf_dir)
    return markov.least_probable_transitions(markov.score_steps(test, model, ("conv_id",)), 5, ("conv_id",)).withColumn("p", F.round("p", 6))


# ---- thresholds, density, fusion, reports


def _detector(spark, sf_dir):
    train, check, test = _parts(spark, sf_dir)
    return jobs.build(train, check, t.CONFIG), test


def _row(spark, **values):
    return spark.range(1).select(*[F.round(F.lit(float(v)), 6).alias(k) for k, v in values.items()])


@query(f"with {t.DETECT} select round(reference, 6) as reference, round(aep_threshold, 6) as aep_threshold from ref, aep")
def aep_threshold(spark, sf_dir):
    d, _ = _detector(spark, sf_dir)
    return _row(spark, reference=d.reference, aep_threshold=d.aep_threshold)


@query(f"with {t.DETECT} select session_ip, session_no, {_rq('information_score', 'aep_deviation')}, aep_anomalous from comp where split = 'testing'")
def aep_decision(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    scores = jobs.session_scores(sessions.ip_sessions(test, t.CONFIG.timeout_seconds, t.CONFIG.min_events), d.model, t.CONFIG.mode)
    return thresholds.aep_decision(scores, d.reference, d.aep_threshold).select(*KEY, *_r("information_score", "aep_deviation"), "aep_anomalous")


@query(f"with {t.DETECT} select round(h, 6) as bandwidth, round(density_threshold, 6) as density_threshold from kde, dlim")
def kde_fit(spark, sf_dir):
    d, _ = _detector(spark, sf_dir)
    return _row(spark, bandwidth=d.density.bandwidth, density_threshold=d.density_threshold)


@query(f"with {t.DETECT} select session_ip, session_no, {_rq('density', 'density_score')} from comp where split = 'testing'")
def kde_score(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    scores = jobs.session_scores(sessions.ip_sessions(test, t.CONFIG.timeout_seconds, t.CONFIG.min_events), d.model, t.CONFIG.mode)
    return density.kde_score(scores, d.density).select(*KEY, *_r("density", "density_score"))


@query(f"with {t.DETECT} select round(am, 6) as aep_mean, round(asd, 6) as aep_sd, round(dm, 6) as density_mean, round(dsd, 6) as density_sd, round(warning, 6) as warning, round(critical, 6) as critical from cal, cuts")
def fusion_calibration(spark, sf_dir):
    f = _detector(spark, sf_dir)[0].fusion
    return _row(spark, aep_mean=f.aep_mean, aep_sd=f.aep_sd, density_mean=f.density_mean, density_sd=f.density_sd, warning=f.warning, critical=f.critical)


@query(f"with {t.DETECT} select round(density_threshold, 6) as density_threshold from dlim")
def kde_threshold(spark, sf_dir):
    return _row(spark, density_threshold=_detector(spark, sf_dir)[0].density_threshold)


@query(f"with {t.DETECT} select round(am, 6) as aep_mean, round(asd, 6) as aep_sd, round(dm, 6) as density_mean, round(dsd, 6) as density_sd from cal")
def component_stats(spark, sf_dir):
    f = _detector(spark, sf_dir)[0].fusion
    return _row(spark, aep_mean=f.aep_mean, aep_sd=f.aep_sd, density_mean=f.density_mean, density_sd=f.density_sd)


@query(f"with {t.DETECT} select round(warning, 6) as warning, round(critical, 6) as critical from cuts")
def fusion_thresholds(spark, sf_dir):
    f = _detector(spark, sf_dir)[0].fusion
    return _row(spark, warning=f.warning, critical=f.critical)


@query(f"with {t.DETECT} select session_ip, session_no, round(hybrid_score, 6) as hybrid_score from report where mode = 'hybrid'")
def fusion_score(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    return jobs.detect(test, d).where("mode = 'hybrid'").select(*KEY, *_r("hybrid_score"))


@query(f"with {t.DETECT} select session_ip, session_no, sev as severity from report where mode = 'hybrid'")
def severity(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    return jobs.detect(test, d).where("mode = 'hybrid'").select(*KEY, "severity")


@query(
    f"""with {t.DETECT} select session_ip, session_no, mode, round(mode_score, 6) as mode_score, anomalous, severity,
    case when not anomalous then '' else concat_ws('; ', case when mode in ('aep', 'hybrid') and aep_anomalous then '{scoring.REASON_AEP}' end, case when mode in ('density', 'hybrid') and density_anomalous then '{scoring.REASON_DENSITY}' end,
      case when mode = 'hybrid' and sev <> 'NORMAL' then concat('fused normalized AEP/KDE score reached ', lower(sev), ' severity') end) end as reasons from report"""
)
def score_report(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    return jobs.detect(test, d).select(*KEY, "mode", *_r("mode_score"), "anomalous", "severity", F.array_join("reasons", "; ").alias("reasons"))


@query(f"with {t.DETECT} select session_ip, session_no, mode, round(mode_score, 6) as mode_score, anomalous from report")
def save_load_model(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    path = _folder(spark, "detector")
    models.save_model(d, path)
    return jobs.detect(test, models.load_model(spark, path)).select(*KEY, "mode", *_r("mode_score"), "anomalous")


@query(f"with {t.DETECT} select session_ip, session_no, mode, round(mode_score, 6) as mode_score from report")
def write_scores(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    path = _folder(spark, "scores")
    logs.write_scores(jobs.detect(test, d).select(*KEY, "mode", *_r("mode_score")), path)
    return spark.read.schema("session_ip string, session_no int, mode string, mode_score double").json(path)


def _markov_detector(spark, sf_dir):
    train, check, test = _parts(spark, sf_dir)
    return jobs.build(train, check, t.MARKOV_CONFIG), test


@query(f"with {t.DETECT_MARKOV} select round(reference, 6) as reference, round(aep_threshold, 6) as aep_threshold, round(density_threshold, 6) as density_threshold, round(warning, 6) as warning, round(critical, 6) as critical from ref, aep, dlim, cuts")
def markov_threshold(spark, sf_dir):
    d, _ = _markov_detector(spark, sf_dir)
    return _row(spark, reference=d.reference, aep_threshold=d.aep_threshold, density_threshold=d.density_threshold, warning=d.fusion.warning, critical=d.fusion.critical)


_MARKOV_REPORT = f"with {t.DETECT_MARKOV} select session_ip, session_no, mode, round(mode_score, 6) as mode_score, anomalous, severity, n_unknown_states, n_events from report"


def _markov_rows(report):
    return report.select(*KEY, "mode", *_r("mode_score"), "anomalous", "severity", "n_unknown_states", "n_events")


@query(_MARKOV_REPORT)
def markov_score_report(spark, sf_dir):
    d, test = _markov_detector(spark, sf_dir)
    return _markov_rows(jobs.detect(test, d))


@query(_MARKOV_REPORT)
def markov_save_load(spark, sf_dir):
    d, test = _markov_detector(spark, sf_dir)
    path = _folder(spark, "detector")
    models.save_model(d, path)
    return _markov_rows(jobs.detect(test, models.load_model(spark, path)))


@query(f"with {t.MODEL} select session_ip, session_no, pos, event_seq, url_group, status_category, unknown_url, unknown_status from bits where split = 'testing' and (unknown_url or unknown_status)")
def novelty_report(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    return scoring.novelty_report(categorical.score_requests(test, model, "status_given_url"))


@query(f"with {t.MODEL} select session_ip, session_no, count(*) filter (unknown_url or unknown_status) as unknown_events, count(*) filter (unknown_url) as unknown_urls, count(*) filter (unknown_status) as unknown_statuses, bool_or(unknown_url or unknown_status) as novelty_detected from bits where split = 'testing' group by 1, 2")
def novelty_counts(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    return scoring.novelty_counts(categorical.score_requests(test, model, "status_given_url"))


# ---- evaluation


def _labels(spark, sf_dir, test):
    flagged = curate.allowlist_flag(sessions.ip_sessions(test, t.CONFIG.timeout_seconds, t.CONFIG.min_events), t.inventory(spark, sf_dir), t.listed_names(spark, sf_dir))
    return evaluate.allowlist_labels(flagged)


#: a session is positive with any request to a probe path, so that both classes occur
_PROBED = "probed as (select session_ip, session_no, bool_or(url_group like 'probe.%') as label, count(*) filter (url_group like 'probe.%') as n_probes from sess where split = 'testing' group by 1, 2)"


def _probed(test):
    rows = sessions.ip_sessions(test, t.CONFIG.timeout_seconds, t.CONFIG.min_events)
    return rows.groupBy(*KEY).agg(F.bool_or(F.startswith("url_group", F.lit("probe."))).alias("label"))


_LABELLED = f"""{t.DETECT}, {_PROBED}, lab as (select r.*, label from report r join probed using (session_ip, session_no))"""


@query(f"with {t.PARTS}, tst as (select * from sess where split = 'testing'), {t.flagged_sql('tst')} select session_ip, session_no, bool_or(not (by_path or by_name)) as label, count(*) filter (not (by_path or by_name)) as n_outside from flagged group by 1, 2")
def allowlist_labels(spark, sf_dir):
    return _labels(spark, sf_dir, _parts(spark, sf_dir)[2])


_GIVEN = "case when event_seq % 40 = 1 then '' when event_seq % 9 = 0 then ' Anomaly' else 'no' end"


@query(f"with {t.SESSIONS} select session_ip, session_no, case when count(*) filter (event_seq % 40 = 1) = 0 then bool_or(event_seq % 9 = 0) end as label from sess group by 1, 2")
def given_labels(spark, sf_dir):
    rows = _sessions(spark, sf_dir).select(*KEY, F.lit("").alias("is_anomaly"), F.expr(_GIVEN).alias("label"))
    return evaluate.given_labels(rows)


_RATIOS = """coalesce(round(tp / nullif(tp + fp, 0), 6), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) as recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) as f1,
  round(fp / nullif(fp + tn, 0), 6) as false_positive_rate, round(fn / nullif(tp + fn, 0), 6) as false_negative_rate, coalesce(round(tp / nullif(tp + fn + fp, 0), 6), 0) as final_score"""
_COUNTS = "count(*) as units, count(*) filter (label and decision) as tp, count(*) filter (not label and not decision) as tn, count(*) filter (not label and decision) as fp, count(*) filter (label and not decision) as fn"
_RATIO_COLUMNS = ("precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "final_score")


_AREAS = """lv as (select mode, mode_score, count(*) filter (label) as p, count(*) filter (not label) as n from lab group by 1, 2), cu as (select *, sum(n) over (partition by mode order by mode_score) - n as below from lv),
roc as (select mode, sum(p * (below + n / 2)) / (sum(p) * sum(n)) as roc_auc from cu group by 1),
rk as (select mode, label, row_number() over w as i, sum(cast(label as integer)) over w as hits from lab window w as (partition by mode order by mode_score desc, start_time, session_ip, session_no rows unbounded preceding)),
pr as (select mode, sum(hits / i) filter (label) / count(*) filter (label) as pr_auc from rk group by 1)"""


@query(f"with {_LABELLED}, {_AREAS} select mode, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc from roc join pr using (mode)")
def rank_areas(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    _, metrics = jobs.evaluate_events(test, _probed(test), d)
    return metrics.select("mode", *_r("roc_auc", "pr_auc"))


@query(f"with {_LABELLED}, c as (select mode, {_COUNTS} from (select *, anomalous as decision from lab) group by 1) select mode, units, tp, tn, fp, fn, {_RATIOS} from c")
def binary_metrics(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    _, metrics = jobs.evaluate_events(test, _probed(test), d)
    return metrics.select("mode", "units", "tp", "tn", "fp", "fn", *_r(*_RATIO_COLUMNS))


@query(f"with {_LABELLED} select mode, count(*) as sessions, count(*) filter (label) as positives, count(*) filter (anomalous) as alerts, count(*) filter (label and anomalous) as detected, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'WARNING') as warning, round(count(*) filter (anomalous) / count(*), 6) as alert_rate from lab group by 1")
def mode_comparison(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    comparison, _ = jobs.evaluate_events(test, _probed(test), d)
    return comparison.withColumn("alert_rate", F.round("alert_rate", 6))


@query(
    f"""with {t.MODEL}, {_PROBED}, sd as (select s.session_ip, s.session_no, n_unknown_urls > 0 as decision from scores s where split = 'testing'),
    req_u as (select x.event_seq, x.url_group like 'probe.%' as label, decision from sess x join sd using (session_ip, session_no) where split = 'testing'), c as (select {_COUNTS} from req_u) select units, tp, tn, fp, fn, {_RATIOS} from c"""
)
def request_units(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    requests = categorical.score_requests(test, model, "status_given_url").withColumn("label", F.startswith("url_group", F.lit("probe.")))
    scores = categorical.score_sessions(requests).select(*KEY, F.col("information_score").alias("score"), (F.col("n_unknown_urls") > 0).alias("decision"))
    metrics = evaluate.confusion(evaluate.request_units(requests, scores))
    return metrics.select("units", "tp", "tn", "fp", "fn", *_r(*_RATIO_COLUMNS))


# ---- folder jobs


def _log_folders(spark, sf_dir):
    lines = stage(t.request_lines(spark, sf_dir), "request-lines")
    folders = {}
    for part in ("training", "validation", "testing"):
        folders[part] = _folder(spark, f"logs-{part}")
        t.write_lines(lines.where(F.col("split") == part), folders[part], ["ts", "event_seq"])
    lists = workflow.RouteLists(t.excluded_paths(spark, sf_dir), t.excluded_names(spark, sf_dir), t.inventory(spark, sf_dir), t.listed_names(spark, sf_dir))
    return folders, lists


def _trained(spark, sf_dir):
    folders, lists = _log_folders(spark, sf_dir)
    model_dir, history = _folder(spark, "detector"), _folder(spark, "history")
    d = workflow.train_from_logs(spark, folders["training"], folders["validation"], model_dir, t.WORKFLOW_CONFIG, lists, history=history, glob="*.txt")
    return d, folders, lists, model_dir, history


@query(f"with {t.WORKFLOW} select round(reference, 6) as reference, round(aep_threshold, 6) as aep_threshold, round(density_threshold, 6) as density_threshold, round(warning, 6) as warning, round(critical, 6) as critical, cast((select n_events from tot) as bigint) as n_events from ref, aep, dlim, cuts")
def train_from_logs(spark, sf_dir):
    d, *_ = _trained(spark, sf_dir)
    row = _row(spark, reference=d.reference, aep_threshold=d.aep_threshold, density_threshold=d.density_threshold, warning=d.fusion.warning, critical=d.fusion.critical)
    return row.withColumn("n_events", F.lit(d.model.n_events))


_OUTSIDE = "outside as (select session_ip, session_no, bool_or(not (by_path or by_name)) as label, count(*) filter (not (by_path or by_name)) as n_outside from sess where split = 'testing' group by 1, 2), lab as (select r.*, label, n_outside from report r join outside using (session_ip, session_no))"


@query(
    f"""with {t.WORKFLOW}, {_OUTSIDE}, {_AREAS}, c as (select mode, {_COUNTS}, cast(sum(n_outside) as bigint) as requests_outside from (select *, anomalous as decision from lab) group by 1)
    select mode, units, tp, tn, fp, fn, requests_outside, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc, 'build,evaluation' as records from c join roc using (mode) join pr using (mode)"""
)
def evaluate_logs(spark, sf_dir):
    _, folders, lists, model_dir, history = _trained(spark, sf_dir)
    comparison, metrics = workflow.evaluate_logs(spark, folders["testing"], model_dir, lists, history=history, glob="*.txt")
    records = logs.read_history(spark, history).agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("records"))  # two rows
    found = metrics.join(comparison.select("mode", "requests_outside"), "mode").crossJoin(records)
    return found.select("mode", "units", "tp", "tn", "fp", "fn", "requests_outside", *_r("roc_auc", "pr_auc"), "records")


_FOUND = "fnd as (select session_ip, session_no, string_agg(mode, ',' order by mode) as modes, any_value(n_events) as n_events from report where anomalous group by 1, 2)"


@query(f"with {t.ANALYSIS}, {_FOUND} select session_ip, session_no, modes, f.n_events, pos, normalized_uri, status_class from fnd f join (select * exclude (n_events) from sess where split = 'testing') x using (session_ip, session_no)")
def analyze_folder(spark, sf_dir):
    _, folders, lists, model_dir, _ = _trained(spark, sf_dir)
    found = workflow.analyze_folder(spark, folders["testing"], model_dir, lists, glob="*.txt")
    sessions_found = found.anomalies.select(*KEY, F.array_join("modes", ",").alias("modes"), "n_events")
    return sessions_found.join(found.activities, list(KEY)).select(*KEY, "modes", "n_events", "pos", "normalized_uri", "status_class")


@query(
    f"""with {t.ANALYSIS}, w as (select count(*) as n from parts where split = 'testing'), kept as (select count(*) as k, count(*) filter (trim(coalesce(ip, '')) = '') as blank from left_in where split = 'testing'), m as (select mode, count(*) as sessions, count(*) filter (anomalous) as anomalous_sessions from report group by 1)
    select mode, sessions, anomalous_sessions, n as ok_rows, 0 as bad_rows, n as input_rows, k as processed_rows, n - k as skipped_rows, n - k as skipped_excluded_route, blank as rows_without_ip from m, w, kept"""
)
def analyze_folder_counts(spark, sf_dir):
    _, folders, lists, model_dir, _ = _trained(spark, sf_dir)
    found = workflow.analyze_folder(spark, folders["testing"], model_dir, lists, glob="*.txt")
    counts = found.comparison.select("mode", "sessions", "anomalous_sessions").crossJoin(F.broadcast(found.parse.select("ok_rows", "bad_rows"))).crossJoin(F.broadcast(found.preprocessing))  # one row each
    return counts.select("mode", "sessions", "anomalous_sessions", "ok_rows", "bad_rows", "input_rows", "processed_rows", "skipped_rows", "skipped_excluded_route", "rows_without_ip")


_DOC_SCORES = "ds as (select d.doc_id, cast(d.n_chars % 97 as double) as score, l.toxic = 1 as label from documents d join labels l using (doc_id))"


def _doc_scores(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("n_chars") % 97).cast("double").alias("score"))
    y = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("toxic") == 1).alias("label"))
    return d.join(y, "doc_id")


@query(f"with {_DOC_SCORES}, lv as (select score, count(*) filter (label) as p, count(*) filter (not label) as n from ds group by 1), cu as (select *, sum(n) over (order by score) - n as below from lv) select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as roc_auc from cu")
def roc_auc(spark, sf_dir):
    return _row(spark, roc_auc=evaluate.roc_auc(_doc_scores(spark, sf_dir)))


@query(f"with {_DOC_SCORES}, rk as (select *, row_number() over (order by score desc, doc_id) as i, sum(cast(label as integer)) over (order by score desc, doc_id) as hits from ds) select round(sum(hits / i) filter (label) / count(*) filter (label), 6) as pr_auc from rk")
def pr_auc(spark, sf_dir):
    return _row(spark, pr_auc=evaluate.pr_auc(_doc_scores(spark, sf_dir), [F.col("doc_id")]))


@query(f"with {t.DETECT} select session_ip, session_no, string_agg(mode, ',' order by mode) as modes, any_value(n_events) as n_events, round(any_value(information_score), 6) as information_score, round(any_value(-log_probability), 6) as total_bits from report where anomalous group by 1, 2")
def analyze_log(spark, sf_dir):
    d, test = _detector(spark, sf_dir)
    found = jobs.analyze_log(test, d)
    total = F.aggregate(F.concat("url_bits", "status_bits"), F.lit(0.0), lambda a, x: a + x)
    return found.select(*KEY, F.array_join("modes", ",").alias("modes"), "n_events", *_r("information_score"), F.round(total, 6).alias("total_bits"))


# ---- reports


@query(f"with {t.PREP}, c as (select normalized_uri, count(*) as requests, min(ts) as f, arg_min(event_seq, (ts, event_seq)) as s from prep group by 1) select normalized_uri, requests from c order by requests desc, f, s limit 8")
def top_routes(spark, sf_dir):
    return reports.top_routes(t.prepared(spark, sf_dir))


@query(f"with {t.PREP} select status_class, count(*) as requests from prep group by 1")
def status_counts(spark, sf_dir):
    return reports.status_counts(t.prepared(spark, sf_dir))


@query(f"with {t.MODEL} select session_ip, session_no, n_events, {_rq('information_score')} from scores where split = 'testing' order by start_time desc, session_ip desc, session_no desc limit 30")
def score_timeline(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    return reports.score_timeline(jobs.session_scores(test, model, "status_given_url")).select(*KEY, "n_events", *_r("information_score"))


@query(
    f"""with {t.HISTORY}, b as (select * from hist where type = 'build' qualify row_number() over (partition by model_dir, model_created_at order by seq desc) = 1)
    select e.seq, cast(json_extract_string(e.result, '$.comparisons.aep.metrics.f1') as double) as score, e.model_dir, e.model_created_at, b.parameters from hist e left join b on e.model_dir = b.model_dir and e.model_created_at is not distinct from b.model_created_at where e.type = 'evaluation'"""
)
def rank_experiments(spark, sf_dir):
    path = _folder(spark, "history")
    columns = ("type", "timestamp", "model_dir", "model_created_at", "dataset", "parameters", "result")
    logs.append_history(t.history(spark, sf_dir).select(*columns), path)
    history = logs.read_history(spark, path).withColumn("seq", F.col("timestamp").cast("long"))
    return reports.rank_experiments(history, "aep", "f1").select("seq", "score", "model_dir", "model_created_at", "parameters")


@query(f"with {t.HISTORY} select seq, type, model_dir, dataset from hist")
def experiment_history(spark, sf_dir):
    path = _folder(spark, "history")
    rows = t.history(spark, sf_dir).select("type", "timestamp", "model_dir", "model_created_at", "dataset", "parameters", "result")
    for kind in ("build", "evaluation"):  # two appends
        logs.append_history(rows.where(F.col("type") == kind), path)
    return logs.read_history(spark, path).select(F.col("timestamp").cast("long").alias("seq"), "type", "model_dir", "dataset")


# ---- live monitor: batch twins, and the stream itself

_LIVE = f"""{t.MODEL},
arr as (select event_seq, session_ip, ts, url_bits + status_bits as b, case when ts - lag(ts) over (partition by session_ip order by event_seq) <= interval 21600 seconds then 0 else 1 end as fresh from bits where split = 'testing'),
arn as (select *, cast(sum(fresh) over (partition by session_ip order by event_seq) as integer) as session_no from arr),
live as (select *, cast(count(*) over w as integer) as n_events, avg(b) over w as information_score from arn window w as (partition by session_ip, session_no order by event_seq)),
liv as (select l.*, abs(information_score - reference) > 1.0 as anomalous from live l, ref),
alerts as (select *, count(*) filter (anomalous) over (partition by session_ip, session_no order by event_seq) as nth from liv),
life as (select session_ip, session_no, min(event_seq) as first_seq, min(event_seq) filter (anomalous) as created_seq, max(event_seq) filter (anomalous) as updated_seq, count(*) filter (anomalous) as changes, max(n_events) as n_events from liv group by 1, 2),
alert as (select *, lead(first_seq) over (partition by session_ip order by session_no) as resolved_seq from life)"""
_LIVE_SELECT = "select event_seq, session_ip, session_no, n_events, round(information_score, 6) as information_score, anomalous, case when anomalous then case when nth = 1 then 'inserted' else 'updated' end end as alert_change from alerts"


def _scored_arrivals(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    return stage(categorical.score_requests(test, model, "status_given_url").select("session_ip", F.col("session_ip").alias("ip"), "event_seq", "ts", "url_bits", "status_bits"), "arrivals"), model.entropies()["status_given_url"]


@query(f"with {_LIVE} {_LIVE_SELECT}")
def live_sessions(spark, sf_dir):
    rows, reference = _scored_arrivals(spark, sf_dir)
    return live.live_sessions_batch(rows, reference, 1.0, 21_600).select("event_seq", *KEY, "n_events", *_r("information_score"), "anomalous", "alert_change")


@query(f"with {_LIVE} {_LIVE_SELECT}")
def stream_live_sessions(spark, sf_dir):
    rows, reference = _scored_arrivals(spark, sf_dir)
    source, out, check = (_folder(spark, n) for n in ("arrivals-in", "live-out", "live-check"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    job = live.live_sessions(stream, reference, 1.0, 21_600, state_ttl=None).writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out)
    job.awaitTermination()
    found = spark.read.schema(live.LIVE).parquet(out).where("information_score is not null")
    return found.select("event_seq", *KEY, "n_events", *_r("information_score"), "anomalous", "alert_change")


_ALERTS = "select session_ip, session_no, created_seq, updated_seq, changes, n_events, resolved_seq, resolved_seq is not null as resolved from alert where created_seq is not null"


def _alerts(spark, sf_dir):
    rows, reference = _scored_arrivals(spark, sf_dir)
    return live.alert_lifecycle(live.live_sessions_batch(rows, reference, 1.0, 21_600))


@query(f"with {_LIVE} {_ALERTS}")
def alert_lifecycle(spark, sf_dir):
    return _alerts(spark, sf_dir)


def _alert_table(spark, sf_dir):
    return _alerts(spark, sf_dir).select(F.col("created_seq").alias("alert_id"), "session_ip", F.col("created_seq").alias("created_at"), F.col("updated_seq").alias("updated_at"), F.col("resolved").alias("acknowledged"))


@query(f"with {_LIVE}, a as ({_ALERTS}) select created_seq as alert_id, session_ip, updated_seq as updated_at from a where session_ip like '%1%' or cast(created_seq as varchar) like '%1%' or cast(updated_seq as varchar) like '%1%' order by updated_seq desc, created_seq desc limit 50")
def list_alerts(spark, sf_dir):
    return reports.list_alerts(_alert_table(spark, sf_dir), 50, "1").select("alert_id", "session_ip", "updated_at")


@query(f"with {_LIVE}, a as ({_ALERTS}) select created_seq as alert_id, case when created_seq % 3 = 0 then true else resolved end as acknowledged from a")
def acknowledge_alerts(spark, sf_dir):
    alerts = _alert_table(spark, sf_dir)
    acks = alerts.where("alert_id % 3 = 0").select("alert_id", (F.col("updated_at") + 1).alias("at"), F.lit(True).alias("acknowledged"))
    old = alerts.where("alert_id % 3 = 1").select("alert_id", (F.col("created_at") - 1).alias("at"), F.lit(True).alias("acknowledged"))
    return reports.acknowledge_alerts(alerts, acks.unionByName(old)).select("alert_id", "acknowledged")


@query(f"with {_LIVE}, l as (select session_ip, arg_max(n_events, event_seq) as pending from liv group by 1) select session_ip, pending from l")
def pending_requests(spark, sf_dir):
    rows, reference = _scored_arrivals(spark, sf_dir)
    return live.pending_requests(live.live_sessions_batch(rows, reference, 1.0, 21_600))


_EXCLUDED_LINE = "(uri = (select concat('/', max(event_type), '/0') from events) or route_name = (select concat(max(event_type), '.show') from events))"


def _monitored(spark, sf_dir):
    lines = t.log_lines(spark, sf_dir).withColumn("source_file", F.lit("routes-live.log"))
    return live.stream_parse(lines, t.excluded_paths(spark, sf_dir), t.excluded_names(spark, sf_dir))


def _streamed(spark, df):
    """The rows that a stream over what is there now gives."""
    out, check = _folder(spark, "stream-out"), _folder(spark, "stream-check")
    df.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _line_stream(spark, sf_dir):
    path = _folder(spark, "live-lines")
    t.write_lines(t.log_lines(spark, sf_dir), path, ["event_seq"])
    return live.stream_log_lines(spark, path, glob="*.txt")


@query(f"with {t.LINES} select raw_line, row_number() over (order by event_seq) - 1 as line_no from lines")
def stream_log_lines(spark, sf_dir):
    found = with_global_index(_streamed(spark, _line_stream(spark, sf_dir)), [F.col("event_seq")], "line_no")
    return found.select("raw_line", "line_no")


@query(f"with {t.PARSED} select raw_line, case when parse_status <> 'ok' then parse_status when {_EXCLUDED_LINE} then 'excluded_route' else 'kept' end as outcome, case when parse_status = 'ok' and not {_EXCLUDED_LINE} then status end as status from parsed")
def stream_parse(spark, sf_dir):
    kept, quarantine = live.stream_parse(_line_stream(spark, sf_dir), t.excluded_paths(spark, sf_dir), t.excluded_names(spark, sf_dir))
    kept = _streamed(spark, kept.select("raw_line", F.lit("kept").alias("outcome"), "status"))
    return kept.unionByName(_streamed(spark, quarantine.select("raw_line", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("status"))))


# ---- files that grow: appended to, half-written and truncated between three rounds


def _rounds(spark, sf_dir, start):
    """Grow the files and run a stream over what is there, three times."""
    folder = _folder(spark, "growing")
    for r in range(3):
        t.grow_files(t.log_lines(spark, sf_dir), folder, r)
        start(folder).awaitTermination()


@query(f"with {t.LINES},{t.GROWN} select concat('routes-', f, '.log') as source_file, byte_offset, raw_line, cast(seen as integer) as round from grown")
def tail_log_lines(spark, sf_dir):
    out, check = _folder(spark, "tailed"), _folder(spark, "tail-check")

    def start(folder):
        lines = tail.tail_log_lines(spark, folder, span_bytes=40_000)
        return lines.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)

    _rounds(spark, sf_dir, start)
    found = spark.read.parquet(out).withColumn("at", F.substring("event_seq", 1, 17))
    rounds = found.select("at").distinct().withColumn("round", (F.row_number().over(Window.orderBy("at")) - 1).cast("int"))  # three rows
    return found.join(rounds, "at").select("source_file", "byte_offset", "raw_line", "round")


def _monitored_rounds(spark, sf_dir):
    out = _folder(spark, "monitor")
    lists = t.excluded_paths(spark, sf_dir), t.excluded_names(spark, sf_dir)
    _rounds(spark, sf_dir, lambda folder: monitor.start_lines(spark, folder, out, *lists, t.CONFIG.state_fields, once=True))
    return out


@query(f"with {t.PARSED},{t.GROWN} select concat('routes-', f, '.log') as source_file, byte_offset, p.raw_line, case when parse_status <> 'ok' then parse_status else 'excluded_route' end as reason from parsed p join grown using (event_seq) where parse_status <> 'ok' or {_EXCLUDED_LINE}")
def monitor_quarantine(spark, sf_dir):
    return monitor.quarantine(spark, _monitored_rounds(spark, sf_dir))


@query(f"with {t.PARSED},{t.GROWN} select cast(seen as integer) as round, count(*) as new_lines, count(*) filter (parse_status <> 'ok') as malformed_lines, count(*) filter (parse_status = 'ok' and {_EXCLUDED_LINE}) as excluded_lines, count(*) filter (parse_status = 'ok' and not {_EXCLUDED_LINE}) as scored_requests from parsed p join grown using (event_seq) group by 1")
def monitor_counters(spark, sf_dir):
    found = monitor.counters(spark, _monitored_rounds(spark, sf_dir))
    return found.withColumn("round", (F.row_number().over(Window.orderBy("round")) - 1).cast("int"))  # a row a round


#: three micro-batches merged one after the other give the alerts that all changes at once do
@query(f"with {_LIVE}, a as ({_ALERTS}) select created_seq as first_alert, session_ip, n_alerted, resolved, resolved as acknowledged from (select a.*, (select n_events from liv where liv.event_seq = a.updated_seq) as n_alerted from a)")
def merge_alerts(spark, sf_dir):
    rows, reference = _scored_arrivals(spark, sf_dir)
    changes = live.live_sessions_batch(rows, reference, 1.0, 21_600)
    ends = changes.select(*live.SESSION, "session_no").distinct()
    nxt = ends.select(F.col("session_ip").alias("i"), (F.col("session_no") - 1).alias("before"), F.col("first_seq").alias("seq"))
    closed = ends.join(nxt, (F.col("session_ip") == F.col("i")) & (F.col("session_no") == F.col("before")))
    raised = changes.where("alert_change is not null")
    closed = closed.join(raised.select(*live.SESSION).distinct(), list(live.SESSION), "left_semi")
    end = closed.select(*live.SESSION, "session_no", F.col("seq").alias("event_seq"), F.lit("resolved").alias("alert_change"))
    all_changes = stage(changes.unionByName(end, allowMissingColumns=True), "changes")
    # event_seq follows time here, so thirds of it are batches in order of arrival
    low, high = all_changes.agg(F.min("event_seq"), F.max("event_seq")).first()
    third = F.floor((F.col("event_seq") - F.lit(low)) * 3 / F.lit(high - low + 1))
    alerts = spark.createDataFrame([], live.ALERTS.format(seq="bigint"))
    for part in range(3):
        alerts = stage(live.merge_alerts(alerts, all_changes.where(third == part)), "alerts")
    created = raised.groupBy(*live.SESSION).agg(F.min("event_seq").alias("first_alert"))
    return alerts.join(created, list(live.SESSION)).select("first_alert", "session_ip", F.col("n_events").alias("n_alerted"), "resolved", "acknowledged")


@query(f"with {t.PARSED} select raw_line, case when parse_status <> 'ok' then parse_status else 'excluded_route' end as reason from parsed where parse_status <> 'ok' or {_EXCLUDED_LINE}")
def quarantine_lines(spark, sf_dir):
    return _monitored(spark, sf_dir)[1].select("raw_line", "reason")


@query(f"with {t.PARSED} select count(*) as new_lines, count(*) filter (parse_status <> 'ok') as malformed_lines, count(*) filter (parse_status = 'ok' and {_EXCLUDED_LINE}) as excluded_lines, count(*) filter (parse_status = 'ok' and not {_EXCLUDED_LINE}) as scored_requests from parsed")
def scan_counters(spark, sf_dir):
    kept, quarantine = _monitored(spark, sf_dir)
    rows = kept.select(F.lit(None).cast("string").alias("reason")).unionByName(quarantine.select("reason"))
    return live.scan_counters(rows)


@query(f"with {t.MODEL} select session_ip, cast(count(*) as bigint) as n_events, round(avg(url_bits + status_bits), 6) as information_score from (select b.*, 0 as z from bits b where split = 'testing') group by session_ip, session_no")
def final_sessions(spark, sf_dir):
    rows, _ = _scored_arrivals(spark, sf_dir)
    closed = live.final_sessions(rows, 21_600, "1 hour")
    return closed.select("session_ip", "n_events", *_r("information_score"))


#: batches that mix old and new: every third request, so most of the second and third batch is late
_LATE = """b as (select *, event_seq % 3 as part from bits where split = 'testing'), seen as (select part, max(ts) as latest from b group by 1),
judged as (select b.*, (select max(latest) from seen where seen.part < b.part) - interval 1 hour as passed from b)"""


def _closing(spark, sf_dir):
    rows, _ = _scored_arrivals(spark, sf_dir)
    out = _folder(spark, "closing")
    each = closing.close_sessions(out, 21_600, 3600)
    for part in range(3):
        each(rows.where(F.col("event_seq") % 3 == part), part)
    return out


@query(f"with {t.MODEL}, {_LATE} select session_ip, event_seq, round((epoch_us(passed) - epoch_us(ts)) / 1e6, 6) as late_by_seconds from judged where ts + interval 6 hour <= passed")
def late_requests(spark, sf_dir):
    return closing.late_requests(spark, _closing(spark, sf_dir)).select("session_ip", "event_seq", *_r("late_by_seconds"))


@query(f"with {t.MODEL}, {_LATE} select cast(count(*) as bigint) as requests, count(*) filter (ts + interval 6 hour <= passed) as late, count(*) filter (passed is null or ts + interval 6 hour > passed) as in_sessions from judged")
def closing_totals(spark, sf_dir):
    out = _closing(spark, sf_dir)
    held = closing.closed_sessions(spark, out).unionByName(closing.open_sessions(spark, out)).agg(F.sum("n_events").alias("in_sessions"))
    late = closing.late_requests(spark, out).agg(F.count("*").alias("late"))
    return held.crossJoin(F.broadcast(late)).select((F.col("in_sessions") + F.col("late")).alias("requests"), "late", "in_sessions")  # one row each


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to flagged sessions: split, sessions, model, scores, threshold, decision."""
    d, test = _detector(spark, sf_dir)
    return jobs.detect(test, d).where("anomalous").select(*KEY, "mode", "n_events", *_r("information_score", "mode_score"), F.array_join("reasons", "; ").alias("reasons"))

