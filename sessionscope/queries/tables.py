"""Requests, log lines, inventories and histories as views of the test tables, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.config import SessionConfig
from sessionscope.operators.prepare import with_states
from sessionscope.operators.sessions import split_by_position
from sessionscope.operators.staging import stage
from sessionscope.sources.tail import opened

CONFIG = SessionConfig(timeout_seconds=21_600, min_events=3, smoothing=0.5)
MARKOV_CONFIG = replace(CONFIG, model="markov")

_STATUS = "case event_id % 10 when 0 then '200' when 1 then '201' when 2 then '302' when 3 then '401' when 4 then '404' when 5 then '429' when 6 then '422' when 7 then '500' when 8 then '99' else '200' end"
_METHOD = "case event_id % 3 when 0 then 'GET' when 1 then 'POST' else 'DELETE' end"


def _request_columns(text: str) -> list[str]:
    """Expressions that both engines read; ``text`` is the name of the string type."""
    eid = f"cast(event_id as {text})"
    uri = (
        f"case when event_id % 101 = 0 then concat('/probe/p', {eid})"
        f" when event_id % 4 = 0 then concat('/api/v2/', event_type, '/', cast(1000000 + event_id as {text}), '?k=', cast(event_id % 5 as {text}))"
        " when event_id % 4 = 1 then concat('/', event_type, '/list')"
        " when event_id % 4 = 2 then concat('/', event_type, '/{ref}/')"
        f" else concat('https://app.example.org/', upper(event_type), '/Items/', cast(500000 + event_id as {text}), '#top') end"
    )
    return [
        "event_id as event_seq",
        "ts",
        f"case when event_id % 50 = 0 then '' else cast(user_id as {text}) end as ip",
        f"{_METHOD} as method",
        f"{uri} as uri",
        f"{_STATUS} as status",
        "case when event_id % 7 = 0 then concat(event_type, '.show') else '' end as route_name",
        "event_type",
    ]


REQ = f"req as (select {', '.join(_request_columns('varchar'))} from events)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_request_columns("string"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_states(requests(spark, sf_dir))


_SEGMENT = r"case when regexp_full_match(s, '\{[^{}]+\}|[0-9]{6,}|(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})') then ':id' else s end"
_PATH = "regexp_replace(regexp_replace(uri, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"
PREP = f"""{REQ},
paths as (select *, array_to_string(list_transform(string_split({_PATH}, '/'), lambda s: {_SEGMENT}), '/') as normalized_uri from req),
named as (select *, list_filter(string_split(lower(normalized_uri), '/'), lambda s: s <> '' and s <> ':id') as g from paths),
prep as (select * exclude (g),
  case when len(g) = 0 then 'root' when g[1] = 'api' and len(g) >= 3 then concat(g[1], '.', g[2], '.', g[3]) when len(g) >= 2 then concat(g[1], '.', g[2]) else concat('route.', g[1]) end as url_group,
  case when length(status) = 3 then concat(status[1], 'xx') else 'unknown' end as status_class,
  case when length(status) <> 3 then 'unknown' when status[1] = '2' then 'success' when status[1] = '3' then 'redirect' when status in ('401', '403') then 'auth_failure'
    when status = '404' then 'not_found' when status = '429' then 'rate_limited' when status[1] = '4' then 'client_error' when status[1] = '5' then 'server_error' else 'informational' end as status_category
  from named)"""

#: prep with split by position
SPLIT = f"""{PREP},
pos as (select *, row_number() over (order by ts, event_seq) - 1 as idx, count(*) over () as n_all from prep),
parts as (select * exclude (idx, n_all), case when idx < floor(n_all * 0.65::double) then 'training' when idx < floor(n_all * 0.65::double) + floor(n_all * 0.15::double) then 'validation' else 'testing' end as split from pos)"""


def split_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_position(prepared(spark, sf_dir), [F.col("ts"), F.col("event_seq")])


def sessions_sql(source: str, name: str, timeout: int = 21_600, min_events: int = 3, by: str = "") -> str:
    """CTEs that number the sessions of ``source`` (per ``by`` columns, if any) as ``name``."""
    p = f"{by}, " if by else ""
    return f"""
{name}_k as (select *, case when ip = '' then 'missing_ip' else ip end as session_ip from {source}),
{name}_n as (select *, case when ts - lag(ts) over (partition by {p}session_ip order by ts, event_seq) <= interval {timeout} seconds then 0 else 1 end as fresh from {name}_k),
{name}_s as (select * exclude (fresh), cast(sum(fresh) over (partition by {p}session_ip order by ts, event_seq) as integer) as session_no from {name}_n),
{name} as (select *, cast(row_number() over (partition by {p}session_ip, session_no order by ts, event_seq) - 1 as integer) as pos, cast(count(*) over (partition by {p}session_ip, session_no) as integer) as n_events,
  min(ts) over (partition by {p}session_ip, session_no) as session_start from {name}_s qualify n_events >= {min_events})"""


SESSIONS = f"{PREP},{sessions_sql('prep', 'sess')}"
#: sessions of each part, numbered inside it
PARTS = f"{SPLIT},{sessions_sql('parts', 'sess', by='split')}"

def model_sql(parts: str) -> str:
    """Counts, probabilities and scores of the categorical model over sessions (sess, with split)."""
    return f"""{parts},
train as (select * from sess where split = 'training'),
pairs as (select url_group as u, status_category as s, count(*) as n from train group by 1, 2),
tot as (select sum(n)::double as n_events, (count(distinct u) + 1)::double as n_u, (count(distinct s) + 1)::double as n_s from pairs),
urls as (select u, sum(n)::double as n from pairs group by 1),
kinds as (select s, sum(n)::double as n from pairs group by 1),
url_p as (select u as url_group, n, (n + 0.5) / (n_events + 0.5 * n_u) as p from (select * from urls union all select '__UNK__', 0) x, tot),
kind_p as (select s as status_category, n, (n + 0.5) / (n_events + 0.5 * n_s) as p from (select * from kinds union all select '__UNK__', 0) x, tot),
cells as (select a.url_group, b.status_category, coalesce(c.n, 0) as n, a.n as url_n,
   (coalesce(c.n, 0) + 0.5) / (n_events + 0.5 * n_u * n_s) as p_joint, (coalesce(c.n, 0) + 0.5) / (a.n + 0.5 * n_s) as p_cond
   from url_p a cross join kind_p b cross join tot left join pairs c on c.u = a.url_group and c.s = b.status_category),
ent as (select (select sum(-p * log2(p)) from url_p) as h_url, (select sum(-p * log2(p)) from kind_p) as h_status, (select sum(-p_joint * log2(p_joint)) from cells) as h_pair,
   (select sum(url_n / n_events * -p_cond * log2(p_cond)) from cells, tot where url_n > 0) as h_given),
ref as (select h_url + h_given as reference from ent),
bits as (select x.*, -log2((coalesce(a.n, 0) + 0.5) / (tot.n_events + 0.5 * n_u)) as url_bits, -log2((coalesce(c.n, 0) + 0.5) / (coalesce(a.n, 0) + 0.5 * n_s)) as status_bits,
   a.u is null as unknown_url, b.s is null as unknown_status
   from sess x cross join tot left join urls a on a.u = x.url_group left join kinds b on b.s = x.status_category left join pairs c on c.u = x.url_group and c.s = x.status_category),
scores as (select split, session_ip, session_no, min(ts) as start_time, max(ts) as end_time, cast(count(*) as integer) as n_events, -sum(url_bits + status_bits) as log_probability, avg(url_bits + status_bits) as information_score,
   arg_min(url_bits + status_bits, pos) as first_bits, cast(count(*) filter (unknown_url) as integer) as n_unknown_urls, cast(count(*) filter (unknown_status) as integer) as n_unknown_statuses
   from bits group by 1, 2, 3)"""


MODEL = model_sql(PARTS)


def detect_sql(model: str) -> str:
    """Thresholds, components, fusion and report over the scores of a model."""
    return f"""{model},
aep as (select quantile_cont(abs(information_score - reference), 0.9) as aep_threshold from scores, ref where split = 'validation'),
kde as (select stddev_samp(information_score) * power(count(*), -0.2) as h, count(*)::double as n from scores where split = 'training'),
points as (select information_score as v from scores where split = 'training'),
dens as (select x.split, x.session_ip, x.session_no, sum(exp(-0.5 * ((x.information_score - v) / h) ** 2)) / (n * h * sqrt(2 * pi())) as density from scores x cross join points cross join kde group by 1, 2, 3, h, n),
comp as (select s.*, abs(information_score - reference) as aep_deviation, abs(information_score - reference) > aep_threshold as aep_anomalous, density, -ln(density + 1e-12) as density_score
   from scores s join dens using (split, session_ip, session_no) cross join ref cross join aep),
dlim as (select quantile_cont(density_score, 0.9) as density_threshold from comp where split = 'validation'),
cal as (select avg(aep_deviation) as am, stddev_pop(aep_deviation) as asd, avg(density_score) as dm, stddev_pop(density_score) as dsd from comp where split = 'training'),
fused as (select comp.*, density_score > density_threshold as density_anomalous, 0.5 * (aep_deviation - am) / asd + 0.5 * (density_score - dm) / dsd as hybrid_score from comp, cal, dlim),
cuts as (select quantile_cont(hybrid_score, 0.9) as warning, quantile_cont(hybrid_score, 0.99) as critical from fused where split = 'validation'),
modes as (select f.*, m.mode, case when hybrid_score >= critical then 'CRITICAL' when hybrid_score >= warning then 'WARNING' else 'NORMAL' end as sev
   from fused f cross join cuts cross join (values ('aep'), ('density'), ('hybrid')) m(mode) where split = 'testing'),
report as (select *, case mode when 'aep' then aep_anomalous when 'density' then density_anomalous else sev <> 'NORMAL' end as anomalous, case when mode = 'hybrid' then sev end as severity,
   case mode when 'aep' then aep_deviation when 'density' then density_score else hybrid_score end as mode_score from modes)"""


DETECT = detect_sql(MODEL)
#: a first-order chain over state descriptions, whose stationary distribution comes from squaring its (half lazy) matrix
MARKOV = f"""{PARTS},
mst as (select *, concat('{{"status_category":"', status_category, '","url_group":"', url_group, '"}}') as state from sess),
mnx as (select session_ip, session_no, pos, state, lead(state) over (partition by session_ip, session_no order by pos) as nx from mst where split = 'training'),
mstate as (select state, count(*) filter (pos = 0) as n_first, count(nx) as n_from from mnx group by 1 union all select '__UNK__', 0, 0),
mstep as (select state as f, nx as t, count(*) as n from mnx where nx is not null group by 1, 2),
mk as (select count(*)::double as k, sum(n_first)::double as ns from mstate),
mcell as materialized (select a.i as f, b.i as t, (coalesce(s.n, 0) + 0.5) / (a.n_from + 0.5 * k) as p from (select *, row_number() over (order by state) as i from mstate) a cross join (select *, row_number() over (order by state) as i from mstate) b cross join mk
   left join mstep s on s.f = a.state and s.t = b.state),
{"".join(f"mp{i + 1} as materialized (select a.f, b.t, sum(a.p * b.p) as p from {f'mp{i}' if i else "(select f, t, 0.5 * p + case when f = t then 0.5 else 0 end as p from mcell)"} a join {f'mp{i}' if i else "(select f, t, 0.5 * p + case when f = t then 0.5 else 0 end as p from mcell)"} b on a.t = b.f group by 1, 2), " for i in range(6))}
mpi as (select t as i, avg(p) as pi from mp6 group by 1),
ref as (select sum(pi * -p * log2(p)) as reference from mpi join mcell on mcell.f = mpi.i),
mknown as (select x.split, x.session_ip, x.session_no, x.pos, x.ts, coalesce(a.state, '__UNK__') as state, a.state is null as unknown from mst x left join mstate a on a.state = x.state),
mprev as (select *, lag(state) over (partition by split, session_ip, session_no order by pos) as prev from mknown),
msc as (select p.*, case when prev is null then (a.n_first + 0.5) / (ns + 0.5 * k) else (coalesce(s.n, 0) + 0.5) / (b.n_from + 0.5 * k) end as p from mprev p cross join mk join mstate a on a.state = p.state left join mstate b on b.state = p.prev left join mstep s on s.f = p.prev and s.t = p.state),
scores as (select split, session_ip, session_no, min(ts) as start_time, max(ts) as end_time, cast(count(*) as integer) as n_events, sum(log2(p)) as log_probability, -avg(log2(p)) as information_score, cast(count(*) filter (unknown) as integer) as n_unknown_states from msc group by 1, 2, 3)"""
DETECT_MARKOV = detect_sql(MARKOV)



# ---- log lines

BROKEN = "event_id % 17 = 0"


def _line(text: str, stamp: str, div: str) -> str:
    body = (
        f"""concat('{{"method":"', {_METHOD}, '","route_name":', case when event_id % 7 = 0 then concat('"', event_type, '.show"') else 'null' end, ',"uri":"/', event_type, '/', cast(event_id as {text}), """
        f"""'","status":', {_STATUS}, ',"ip":"10.0.0.', cast(user_id % 250 as {text}), '"}}')"""
    )
    head = f"concat('[', {stamp}, '] local.INFO: ')"
    kind = f"({div}) % 5"
    return (
        f"case when not ({BROKEN}) then concat({head}, 'Route request completed. ', {body})"
        f" when {kind} = 0 then 'not a valid log line'"
        f" when {kind} = 1 then concat({head}, 'Something else happened. ', {body})"
        f" when {kind} = 2 then concat({head}, 'Route request completed. {{\"method\": oops')"
        f" when {kind} = 3 then concat({head}, 'Route request completed. {{\"method\":\"GET\"}}')"
        " else 'garbage [2026-01-02 03:04:05] tail' end"
    )


LINES = f"lines as (select event_id as event_seq, event_type, user_id, ts, event_id, {_line('varchar', chr(39).join(['strftime(ts, ', '%Y-%m-%d %H:%M:%S', ')']), 'event_id // 17')} as raw_line from events)"

#: what parsing the lines must give, from what they were made of
PARSED = f"""{LINES},
parsed as (select event_seq, raw_line,
  case when not ({BROKEN}) then 'ok' else ['malformed_line', 'unexpected_message', 'invalid_json', 'missing_fields', 'malformed_line'][(event_id // 17) % 5 + 1] end as parse_status,
  case when {BROKEN} and (event_id // 17) % 5 = 0 then '' when {BROKEN} and (event_id // 17) % 5 = 4 then '2026-01-02 03:04:05' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as "timestamp",
  case when {BROKEN} and (event_id // 17) % 5 in (0, 4) then '' else 'INFO' end as log_level,
  case when {BROKEN} then '' else {_METHOD} end as method,
  case when {BROKEN} or event_id % 7 <> 0 then '' else concat(event_type, '.show') end as route_name,
  case when {BROKEN} then '' else concat('/', event_type, '/', cast(event_id as varchar)) end as uri,
  case when {BROKEN} then '' else {_STATUS} end as status,
  case when {BROKEN} then '' else concat('10.0.0.', cast(user_id % 250 as varchar)) end as ip
  from lines)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_seq, raw_line): every seventeenth line is broken in one of five ways."""
    line = _line("string", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "event_id div 17")
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as event_seq", f"{line} as raw_line")


# ---- log folders: the requests as lines in time order, with whole seconds


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_seq, ts, split, raw_line) of all requests, split by position."""
    rows = requests(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))
    payload = F.to_json(F.struct("method", F.nullif(F.col("route_name"), F.lit("")).alias("route_name"), "uri", F.col("status").cast("int").alias("status"), "ip"), {"ignoreNullFields": "false"})
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] local.INFO: Route request completed. "), payload)
    return split_by_position(rows.withColumn("raw_line", line), [F.col("ts"), F.col("event_seq")]).select("event_seq", "ts", "split", "raw_line")


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text files whose names and lines follow the order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("raw_line").write.text(path)


#: where the lines stand in eight files that grow in three rounds. A file's last line of a round lacks its line feed until the next
#: round, but for the eighth file; that one is written anew in the third round, and is shorter then.
GROWN = """placed as (select event_seq, raw_line, event_seq % 3 as r, (event_seq // 3) % 8 as f from lines),
ends as (select *, row_number() over (partition by f, r order by event_seq desc) = 1 as last_one, f = 7 and r = 2 as fresh from placed),
grown as (select event_seq, raw_line, f, cast(coalesce(sum(strlen(raw_line) + 1) over (partition by f, fresh order by r, event_seq rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset,
  case when last_one and f < 7 and r < 2 then r + 1 else r end as seen from ends)"""


def grow_files(lines: DataFrame, folder: str, r: int) -> None:
    """What round r adds to the files of ``GROWN``."""
    rows = lines.where(F.col("event_seq") % 3 == r).withColumn("file", F.floor(F.col("event_seq") / 3) % 8)
    in_file = Window.partitionBy("file")
    begin = F.when((F.row_number().over(in_file.orderBy("event_seq")) == 1) & (F.lit(r) > 0) & (F.col("file") < 7), "\n").otherwise("")
    end = F.when((F.row_number().over(in_file.orderBy(F.desc("event_seq"))) == 1) & (F.lit(r) < 2) & (F.col("file") < 7), "").otherwise("\n")
    rows = rows.select("file", "event_seq", F.concat(begin, "raw_line", end).alias("data"))

    def write(part: Iterator[Row]) -> None:
        store, path = opened(folder)
        store.create_dir(path)
        for file, own in groupby(part, key=lambda x: x["file"]):
            name = f"{path}/routes-{file}.log"
            with store.open_output_stream(name) if (file, r) == (7, 2) or r == 0 else store.open_append_stream(name) as f:
                for x in own:
                    f.write(x["data"].encode())

    rows.repartition("file").sortWithinPartitions("file", "event_seq").foreachPartition(write)


WORKFLOW_CONFIG = SessionConfig(timeout_seconds=600, min_events=1, smoothing=0.5)


# ---- inventories: lists as large as the application, written once, so that their size is known and joins with them move no requests

INVENTORY = """inv as (select distinct '*' as method, concat('/api/v2/', event_type, '/:id') as path from events
  union all select distinct 'get', concat('/', event_type, '/list/') from events union all select distinct 'POST', concat('/', upper(event_type), '/Items/:id') from events)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    rows = F.array(
        F.struct(F.lit("*").alias("method"), F.concat(F.lit("/api/v2/"), "event_type", F.lit("/:id")).alias("path")),
        F.struct(F.lit("get").alias("method"), F.concat(F.lit("/"), "event_type", F.lit("/list/")).alias("path")),
        F.struct(F.lit("POST").alias("method"), F.concat(F.lit("/"), F.upper("event_type"), F.lit("/Items/:id")).alias("path")),
    )
    return stage(types.select(F.inline(rows)), "inventory")


def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("event_type").alias("t"))
    return stage(first.select(F.concat("t", F.lit(".show")).alias("route_name")), "listed-names")


def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_type").alias("t"))
    return stage(last.select(F.concat(F.lit("/"), "t", F.lit("/list")).alias("path")), "excluded-paths")


def excluded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_type").alias("t"))
    return stage(last.select(F.concat("t", F.lit(".show")).alias("route_name")), "excluded-names")


EXCLUDED = "kept as (select * from prep where not (regexp_replace(normalized_uri, '/+$', '') = (select concat('/', max(event_type), '/list') from events) or route_name = (select concat(max(event_type), '.show') from events)))"


def flagged_sql(source: str, name: str = "flagged") -> str:
    path = "regexp_replace(normalized_uri, '/+$', '')"
    return f"""{INVENTORY},
invp as (select upper(method) as m, regexp_replace(path, '/+$', '') as p from inv),
{name} as (select x.*, exists (select 1 from invp where p = {path} and (m = '*' or m = x.method)) as by_path, route_name = (select concat(min(event_type), '.show') from events) as by_name from {source} x)"""


def curated_sql(source: str) -> str:
    return f"""{flagged_sql(source)},
curated as (select *, case when by_name or by_path then 'normal' else 'review' end as classification,
  case when by_name then 'allowlisted_route_name' when by_path then 'allowlisted_method_path' else 'endpoint_not_in_application_allowlist' end as reason from flagged)"""


#: what the folder jobs keep: in training and validation what is listed, session by session; in testing everything
WORKFLOW_PARTS = f"""{SPLIT.replace("select event_id as event_seq, ts,", "select event_id as event_seq, date_trunc('second', ts) as ts,")},
left_in as (select * from parts where split = 'testing' or not (regexp_replace(normalized_uri, '/+$', '') = (select concat('/', max(event_type), '/list') from events) or route_name = (select concat(max(event_type), '.show') from events))),
{curated_sql("left_in")},{sessions_sql("curated", "cs", timeout=600, min_events=1, by="split")},
own as (select * exclude (session_ip, session_no, pos, n_events, session_start) from cs qualify split = 'testing' or not bool_or(classification = 'review') over (partition by split, session_ip, session_no)),
{sessions_sql("own", "sess", timeout=600, min_events=1, by="split").strip()}"""
WORKFLOW = detect_sql(model_sql(WORKFLOW_PARTS))
#: the same, with the excluded routes left out of the third folder too
ANALYSIS = WORKFLOW.replace("where split = 'testing' or not (regexp_replace", "where not (regexp_replace", 1)


# ---- experiment history from orders

_HISTORY = [
    "o_orderkey as seq",
    "case when o_orderkey % 3 = 0 then 'build' else 'evaluation' end as type",
    "concat('m', cast(o_custkey % 40 as {t})) as model_dir",
    "case when o_orderkey % 11 = 0 then null else o_orderpriority end as model_created_at",
    "cast(o_orderkey as {t}) as timestamp",
    "case when o_orderkey % 3 = 0 then concat('{{\"k\":', cast(o_orderkey as {t}), '}}') end as parameters",
    "case when o_orderkey % 5 = 0 then '{{}}' else concat('{{\"comparisons\":{{\"aep\":{{\"session_alert_rate\":0.5,\"metrics\":{{\"f1\":', cast(o_orderkey % 1000 as {t}), '.25}}}}}}}}') end as result",
    "o_orderstatus as dataset",
]
HISTORY = "hist as (select " + ", ".join(h.format(t="varchar") for h in _HISTORY) + " from orders)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[h.format(t="string") for h in _HISTORY])
