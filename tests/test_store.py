import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.operators import upsert
from pagelake.sources import checkpoint, files, pages
from pagelake.sources.store import TableStore, append_new


def test_raw_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "raw"), buckets=3)
    one = spark.createDataFrame(
        [("s1", "http://a.test/1", "v1", 1), ("s1", "http://A.test/1#x", "v2", 2), ("s1", "http://a.test/2", "w", 3), ("s2", "http://a.test/1", "z", 4)],
        "site_name string, url string, raw_data string, seq long",
    )
    store.save(one, "seq", "2024-01-01 00:00:00")
    assert store.count("s1") == 2 and store.count("s2") == 1 and store.count("s1", "crawled") == 2
    hashes = {r["url"]: r["url_hash"] for r in store.read().collect()}
    updates = spark.createDataFrame([(hashes["http://a.test/1"], "done", 1)], "url_hash string, status string, v int")
    store.set_status(updates, "v", "2024-01-02 00:00:00")
    assert {(r["site_name"], r["status"]) for r in store.read().collect()} == {("s1", "done"), ("s1", "crawled"), ("s2", "done")}
    two = spark.createDataFrame([("s1", "http://a.test/1", "v3", 1), ("s1", "http://a.test/3", "n", 2)], one.schema)
    store.save(two, "seq", "2024-01-03 00:00:00")
    rows = {(r["site_name"], r["url"]): r for r in store.read().collect()}
    first = rows["s1", "http://a.test/1"]
    assert (first["raw_data"], first["status"]) == ("v3", "crawled")
    assert first["created_at"] == datetime.datetime(2024, 1, 1) and first["updated_at"] == datetime.datetime(2024, 1, 3)
    assert rows["s2", "http://a.test/1"]["status"] == "done" and len(rows) == 4
    assert store.audit().isEmpty()
    newest = store.query("s1", limit=1, status="crawled").collect()
    assert len(newest) == 1 and newest[0]["updated_at"] == datetime.datetime(2024, 1, 3)


def test_saving_reads_only_touched_partitions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "raw"), buckets=8)
    rows = spark.range(200).select(
        F.concat(F.lit("s"), F.col("id") % 4).alias("site_name"), F.concat(F.lit("http://a.test/"), "id").alias("url"),
        F.lit("x").alias("raw_data"), F.col("id").alias("seq"),
    )
    store.save(rows, "seq", "2024-01-01 00:00:00")
    held = store.versions.latest()[1]["slots"]
    read = store._rows(store.versions.latest()[1], {int(min(held))}).inputFiles()
    assert read and all(f"/slot={min(held)}/" in f for f in read)
    before = set((tmp_path / "raw").rglob("*.parquet"))
    store.save(rows.filter("seq = 1"), "seq", "2024-01-02 00:00:00")
    after = set((tmp_path / "raw").rglob("*.parquet"))
    assert before <= after and len(after - before) == 1
    assert len(set(map(tuple, store.versions.latest()[1]["slots"].values())) - set(map(tuple, held.values()))) == 1
    assert store.read().count() == 200


def test_cleaned_store_gains_columns(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "cleaned"), "cleaned", buckets=2)
    one = spark.createDataFrame(
        [("s", "http://a.test/1", 1, "t", [1, 2], True, 1), ("s", "", 2, None, None, False, 2)],
        "site_name string, url string, `书名` int, title string, tags array<int>, ok boolean, seq int",
    )
    store.save(one, "seq", "2024-01-01 00:00:00")
    two = spark.createDataFrame([("s", "http://a.test/1", "new", 2.5, "9", 1)], "site_name string, url string, title string, `Net Price` double, id string, seq int")
    store.save(two, "seq", "2024-01-02 00:00:00")
    rows = {r["url"]: r.asDict() for r in store.read().collect()}
    name = upsert.store_names(spark, ["书名"])["书名"]
    row = rows["http://a.test/1"]
    assert (row["title"], row["net_price"], row[name], row["tags"], row["ok"]) == ("new", 2.5, 1, "[1,2]", True)
    assert "id" not in row and rows[""]["url_hash"] == "" and rows[""]["net_price"] is None
    assert store.query("s", limit=1, offset=1).count() == 1 and store.query("s", offset=2).count() == 0


def test_sites_that_look_like_numbers(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "raw"), buckets=2)
    rows = spark.createDataFrame([("007", "http://a.test/1", "v", 1)], "site_name string, url string, raw_data string, seq int")
    store.save(rows, "seq", "2024-01-01 00:00:00")
    store.save(rows, "seq", "2024-01-02 00:00:00")
    assert [(r["site_name"], r["raw_data"]) for r in store.read().collect()] == [("007", "v")]


def test_store_types():
    assert [upsert.store_type(t) for t in (T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.ArrayType(T.LongType()))] == [
        "boolean", "bigint", "bigint", "double", "string", "string"]


def test_append_twice_inserts_the_new_rows_once(spark, tmp_path):
    path = str(tmp_path / "items")
    two_pages = spark.createDataFrame([(f"l{i}", f"t{i}") for i in range(40)], "link string, title string")
    three_pages = spark.createDataFrame([(f"l{i}", f"t{i}") for i in range(60)], "link string, title string")
    assert append_new(spark, two_pages, path) == 40
    assert append_new(spark, three_pages, path) == 20
    assert append_new(spark, three_pages, path) == 0
    assert append_new(spark, three_pages.withColumn("note", F.lit("n")).limit(1), path) == 1
    assert spark.read.option("mergeSchema", True).parquet(path).count() == 61


def items(*names):
    return [{"标题": n} for n in names]


def test_checkpoint_files(spark, tmp_path):
    path = str(tmp_path / "resume")
    schema = f"page_no bigint, items {checkpoint.ITEMS}"
    assert checkpoint.load(spark, path, "sig").count() == 0
    assert checkpoint.clear(spark, path, "sig") is False
    checkpoint.save(spark.createDataFrame([(1, items("a")), (2, [])], schema), path, "sig")
    (tmp_path / "resume" / "sig=sig" / "extra.txt").write_text('\n{broken\n{"page":"3","items":[{"n":1}]}\n{"page":0,"items":[]}\n{"page":4,"items":"x"}\n{"page":5,"items":[1]}\n[]\n')
    checkpoint.save(spark.createDataFrame([(7, items("g"))], schema), path, "other")
    got = {r["page_no"]: r["items"] for r in checkpoint.load(spark, path, "sig").collect()}
    assert got == {1: items("a"), 2: [], 3: [{"n": "1"}]}
    checkpoint.save(spark.createDataFrame([(1, items("b", "c"))], schema), path, "sig")
    assert checkpoint.load(spark, path, "sig").filter("page_no = 1").first()["items"] == items("b", "c")
    checkpoint.compact(spark, path, "sig", str(tmp_path / "small"))
    assert checkpoint.load(spark, str(tmp_path / "small"), "sig").count() == 3
    assert checkpoint.clear(spark, path, "sig") is True and checkpoint.clear(spark, path, "sig") is False
    assert checkpoint.load(spark, path, "sig").count() == 0 and checkpoint.load(spark, path, "other").count() == 1


def test_last_line_of_a_page_wins(spark):
    lines = [(i, f'{{"page":{i % 20 + 1},"items":[{{"n":{i}}}]}}') for i in range(60)]
    got = checkpoint.parse_lines(spark.createDataFrame(lines, "line_no int, value string").repartition(4))
    assert {r["page_no"]: r["items"] for r in got.collect()} == {p + 1: [{"n": str(40 + p)}] for p in range(20)}


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# proxies\n http://p1:1 \n\nhttp://p2:2\r\nhttp://p1:1\n  # x\n")
    got = files.read_text_list(spark, str(tmp_path / "list.txt")).orderBy("line_no").collect()
    assert [r["entry"] for r in got] == ["http://p1:1", "http://p2:2"]
    assert files.entries_of(" a, b,,a ") == files.entries_of(["a", " b", "", "a"]) == ["a", "b"]
    (tmp_path / "t.csv").write_text("﻿标题,价格\n" + "".join(f'"r, {i}",{i}\n' for i in range(300)), encoding="utf-8")
    preview = files.read_csv_preview(spark, str(tmp_path / "t.csv"))
    assert preview.columns == ["标题", "价格"] and preview.count() == 200 and preview.first()["标题"] == "r, 0"
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([('say "hi"\n', [1, 2])], "t string, a array<int>"), out)
    assert [tuple(r) for r in files.read_csv_preview(spark, out).collect()] == [('say "hi"\n', "[1,2]")]


def test_jsonl_archive(spark, tmp_path):
    path = str(tmp_path / "raw")
    files.write_raw_jsonl(spark.createDataFrame([("a", 1)], "url string, n int"), path, "shop", "20240601")
    files.write_raw_jsonl(spark.createDataFrame([("b", 2)], "url string, n int"), path, "shop", "20240602")
    assert (tmp_path / "raw" / "site=shop" / "dt=20240601").is_dir()
    (tmp_path / "raw" / "site=shop" / "dt=20240601" / "x.json").write_text('\n\n{"url":"c","extra":true}\n')
    assert {(r["url"], r["n"], r["extra"]) for r in files.read_jsonl(spark, path).collect()} == {("a", 1, None), ("b", 2, None), ("c", None, True)}


def test_usable_pages(spark):
    df = spark.createDataFrame([(200, "x", None), (200, "", None), (404, "x", None), (301, "x", "boom"), (301, "y", None)], "status_code int, text string, error string")
    assert pages.usable(df).count() == 1 and pages.fetch_ok(df).count() == 3
