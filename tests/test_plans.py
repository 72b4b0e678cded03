"""Plans are the ones wanted: filters and columns reach the scan, one exchange for a merge."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.config import Options
from tidemark.plans import queries as q
from tidemark.plans.merge import current, latest

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_filter_reaches_the_scan(spark):
    for form in ("window", "max_by"):
        df = latest(q.changelog(spark, SF), ["user_id"], ["value", "_deleted"], form=form).where("user_id = 7")
        assert "EqualTo(user_id,7)" in plan(df)


def test_value_filter_stays_above_the_merge(spark):
    df = latest(q.changelog(spark, SF), ["user_id"], ["value", "_deleted"]).where("value > 0")
    assert "GreaterThan(value" not in plan(df)


def test_columns_are_pruned_and_one_exchange(spark):
    df = current(q.changelog(spark, SF), ["user_id"], ["value"]).select("user_id", "value")
    text = plan(df)
    assert "props" not in text and text.count("Exchange") == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("events", "orders", "customer", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    build, sql = q.QUERIES[name]
    df = build(spark, SF)
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    want = sorted(cur.fetchall(), key=repr)
    assert got == want


def test_state_counts_of_batches_above_the_freeze_limit(spark, tmp_path):
    c = duckdb.connect()
    n = 4 * Options().freeze_rows  # a quarter of it would be frozen for its size
    c.execute(f"COPY (SELECT i AS event_id, i % 997 AS user_id, 'view' AS event_type, 0.5::DOUBLE AS value FROM range({n}) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    build, sql = q.QUERIES["state_counts"]
    df = build(spark, str(tmp_path))
    want = c.execute(sql)
    assert [tuple(r) for r in df.select(*(d[0] for d in want.description)).collect()] == want.fetchall() == [(1, 997, 1, n // 4, n + 1, 1)]


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
