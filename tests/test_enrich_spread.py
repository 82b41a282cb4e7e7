"""Rows that look nothing up are spread over the tasks of the lookup."""

import pytest
from pyspark.sql import functions as F

from pagelake.operators import enrich


@pytest.mark.parametrize("limit", [0, 2])
def test_rows_without_a_lookup_do_not_meet_in_one_task(spark, limit):
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        link = F.when(F.col("id") < 4, F.concat(F.lit("https://a.test/"), F.col("id"))).otherwise(None if limit else "")
        items = spark.range(1000).select("id", link.alias("link"), F.lit("old").alias("name"))
        details = spark.createDataFrame([("https://a.test/1", "one"), ("https://a.test/3", "three")], "url string, name string")
        out = enrich.detail_backfill(items, details, "link", ["name"], ["id"], limit).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = {1: "one"} if limit else {1: "one", 3: "three"}
    assert {r["id"]: r["name"] for r in out} == {i: found.get(i, "old") for i in range(1000)}
    tasks = [r["task"] for r in out]
    assert max(tasks.count(t) for t in set(tasks)) < 500
