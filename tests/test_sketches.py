import pytest
from pyspark.sql import functions as F

from pagelake.operators import sketches


def test_days_unite_to_the_whole(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("site"), (F.col("id") % 10).alias("day"), (F.col("id") % 20_001).alias("user"))
    rows = rows.unionByName(rows.limit(0)).unionByName(spark.createDataFrame([(0, 1, None)], "site long, day long, user long"))
    table = sketches.SketchTable(spark, str(tmp_path / "t"), "user", ["site", "day"], lg_k=12)
    with pytest.raises(ValueError):
        table.read()
    for day in range(10):
        table.add(rows.where(F.col("day") == day), f"day{day}")
    table.add(rows.where("day = 3"), "day3")
    late = rows.where("day = 3")
    table.add(late, "again")  # other name, same rows: no estimate changes
    assert table.read().count() == 30
    by_site = {r["site"]: r["n"] for r in sketches.united(table.read(), ["site"]).select("site", sketches.estimate().alias("n")).collect()}
    exact = {r["site"]: r["n"] for r in rows.groupBy("site").agg(F.countDistinct("user").alias("n")).collect()}
    at_once = {r["site"]: r["n"] for r in sketches.sketched(rows, "user", ["site"], 12).select("site", sketches.estimate().alias("n")).collect()}
    for site, n in exact.items():
        assert abs(by_site[site] - n) <= sketches.error_bound(12) * n and abs(at_once[site] - n) <= sketches.error_bound(12) * n
    table.compact()
    folded = {r["site"]: r["n"] for r in sketches.united(table.read(), ["site"]).select("site", sketches.estimate().alias("n")).collect()}
    assert folded == by_site
    assert len(table.versions.latest()[1]["folders"]) == 1
    table.add(rows.where("day = 3"), "day3")
    assert len(table.versions.latest()[1]["folders"]) == 1


def test_small_and_empty(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "y")], "k string, item string")
    got = {r["k"]: (r["n"], r["ok"]) for r in sketches.sketched(rows, "item", ["k"]).select("k", sketches.estimate().alias("n"), sketches.within("sketch", F.lit(1)).alias("ok")).collect()}
    assert got["a"] == (1, True) and got[None] == (1, True) and got["b"][0] == 0
    assert sketches.sketched(rows.limit(0), "item", ["k"]).count() == 0
