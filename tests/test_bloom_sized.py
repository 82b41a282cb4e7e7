"""Filters whose shape follows from the table."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelake.operators import bloom
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = ["bloom_build_sized", "bloom_contains_sized", "bloom_count_sized"]


@pytest.mark.parametrize("name", NAMES)
def test_sized_queries_equal_their_twins(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_filters_grow_with_the_table(spark, tmp_path):
    docs = spark.range(80_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.where("doc_id < 40000").select("doc_id").write.parquet(str(tmp_path / "labels.parquet"))
    estimate = entry.queries()["bloom_count_sized"](spark, str(tmp_path)).first()["estimate"]
    assert abs(estimate - 80_000) < 400
    answers = entry.queries()["bloom_contains_sized"](spark, str(tmp_path)).where("maybe").count()
    assert 40_000 <= answers < 40_200
    assert bloom.shape_for(docs.limit(0), "doc_id") == bloom.bloom_shape(1)
