"""Registered queries beside DuckDB on the smallest tables, under two shuffle widths."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "harvest_links json_items json_auto clean_site dedup_safe bloom_contains raw_upsert idempotent_append"
    " robots_allowed page_stop_serial next_walk scroll_accumulate pacing_plan alert_throttle proxy_evict"
    " task_transitions task_refused frontier_apply frontier_next ckpt_save chunk detail_backfill_limit"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", ["harvest_links", "dedup_safe", "alert_throttle", "frontier_apply"])
def test_result_does_not_depend_on_partitions(spark, name):
    results = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = entry.queries()[name](spark, FOLDER)
        results.append(rows_of(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 120


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
