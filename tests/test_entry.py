"""The driver's contract, and a sample of registered queries against their SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from sessionscope.queries import session_queries

TABLES = ("events", "orders", "pages", "documents", "labels", "conversations")
SAMPLE = ("parse_log_lines", "normalize_uri", "upgrade_states", "session_control", "sliced_sessions", "fixed_count_windows", "window_records", "joint_probabilities", "score_sessions", "entropy_rate", "score_report", "roc_auc", "rank_experiments", "stream_live_sessions", "acknowledge_alerts")


def plain(v):
    return (round(v, 6) + 0.0 if math.isfinite(v) else str(v)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = session_queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(session_queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.reasons for r in rows)


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(session_queries.QUERIES) <= set(queries)
    assert all(callable(f) for f in queries.values())
