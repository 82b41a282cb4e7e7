"""Commits of stored tables: all or nothing, one writer a version, replays, late rows, drifting types."""

import datetime

import pytest

from pagelake.operators import upsert
from pagelake.sources import checkpoint
from pagelake.sources.intake import stream_files
from pagelake.sources.store import TableStore, append_new, appended, fresh_rows
from pagelake.sources.versions import Conflict, Versions, names_in
from pagelake.streaming import flows

DAY1, DAY2, DAY3 = (f"2024-01-0{d} 00:00:00" for d in (1, 2, 3))
SCHEMA = "site_name string, url string, raw_data string, seq long"


def batch(spark, *rows):
    return spark.createDataFrame([(s, f"http://x.test/{u}", d, v) for s, u, d, v in rows], SCHEMA)


def held(store, version=None):
    return {(r["site_name"], r["url"].rsplit("/", 1)[-1]): r["raw_data"] for r in store.read(version).collect()}


def test_a_number_is_taken_once(spark, tmp_path):
    one, two = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "t"))
    assert one.latest() == (0, {}) and one.read(0) == {}
    assert one.commit(0, {"a": "ü"}) == 1 and two.latest() == (1, {"a": "ü"})
    with pytest.raises(Conflict):
        two.commit(0, {"a": 2})
    assert two.latest() == (1, {"a": "ü"}) and not [n for n, _ in names_in(spark, one.place) if n.startswith(".draft")]
    calls = []

    def racing(number, manifest):
        calls.append(number)
        if len(calls) == 1:
            one.commit(1, {"a": 3})  # another writer comes first
        return {"a": manifest["a"], "b": number}

    assert two.change(racing) == 3 and calls == [1, 2] and two.latest()[1] == {"a": 3, "b": 2}
    assert two.change(lambda n, m: None) == 3
    assert two.expire(1) == [{"a": 3, "b": 2}] and two.numbers() == [3]


def test_an_interrupted_save_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "t"), buckets=2, groups=2)
    store.save(batch(spark, ("s", "1", "a", 1), ("s", "2", "a", 2)), "seq", DAY1)
    before = held(store)

    def dies(self, after, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", dies)
        with pytest.raises(OSError):
            store.save(batch(spark, ("s", "1", "b", 3), ("s", "3", "b", 4)), "seq", DAY2)
    again = TableStore(spark, str(tmp_path / "t"))
    assert (again.buckets, again.groups) == (2, 2) and held(again) == before and again.version() == 1
    assert len(names_in(spark, str(tmp_path / "t" / "data"))) == 2  # the dead writer's folder
    again.save(batch(spark, ("s", "1", "b", 3)), "seq", DAY2)
    assert held(again) == {**before, ("s", "1"): "b"}
    assert again.vacuum() == 1 and held(again, 1) == before and held(again) == {**before, ("s", "1"): "b"}


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), buckets=2, groups=2)
    store.save(batch(spark, ("s", "1", "a", 1)), "seq", DAY1)
    pinned = store.read()
    store.save(batch(spark, ("s", "1", "b", 1), ("u", "9", "c", 1)), "seq", DAY2)
    assert [r["raw_data"] for r in pinned.collect()] == ["a"] and held(store, 1) == {("s", "1"): "a"}
    assert held(store) == {("s", "1"): "b", ("u", "9"): "c"} and store.count("u") == 1 and store.count("none") == 0
    store.save(batch(spark), "seq", DAY3)
    assert store.version() == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    one = TableStore(spark, str(tmp_path / "t"), buckets=1, groups=1)
    one.save(batch(spark, ("s", "1", "a", 1)), "seq", DAY1)
    commit, other = Versions.commit, TableStore(spark, str(tmp_path / "t"))

    def slow(self, after, manifest):
        monkeypatch.setattr(Versions, "commit", commit)
        other.save(batch(spark, ("s", "2", "b", 1)), "seq", DAY2)
        return commit(self, after, manifest)

    monkeypatch.setattr(Versions, "commit", slow)
    one.save(batch(spark, ("s", "3", "c", 1)), "seq", DAY3)
    assert held(one) == {("s", "1"): "a", ("s", "2"): "b", ("s", "3"): "c"} and one.version() == 3


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), buckets=2, groups=2)
    store.save(batch(spark, ("s", "1", "a", 1)), "seq", DAY1, source="feed", batch_id=0)
    store.save(batch(spark, ("s", "1", "b", 1)), "seq", DAY2, source="feed", batch_id=1)
    version = store.version()
    assert store.save(batch(spark, ("s", "1", "a", 1)), "seq", DAY3, source="feed", batch_id=0) == version
    assert store.save(batch(spark, ("s", "1", "z", 1)), "seq", DAY3, source="feed", batch_id=1) == version
    assert held(store) == {("s", "1"): "b"}
    store.save(batch(spark, ("s", "1", "c", 1)), "seq", DAY3, source="other", batch_id=0)
    assert held(store) == {("s", "1"): "c"}


def test_a_stream_that_loses_its_commit_log_is_known(spark, tmp_path):
    folder, store = tmp_path / "in", TableStore(spark, str(tmp_path / "t"), buckets=2, groups=2, versioned=True)
    batch(spark, ("s", "1", "a", 1), ("s", "2", "b", 2)).coalesce(1).write.parquet(str(folder))
    run = lambda: flows.drain(flows.upsert_sink(stream_files(spark, str(folder), SCHEMA), store, "seq", DAY1, str(tmp_path / "ck")))
    run()
    version = store.version()
    for done in (tmp_path / "ck" / "commits").iterdir():  # as if the driver had died before Spark noted the batch
        done.unlink()
    run()
    assert store.version() == version and held(store) == {("s", "1"): "a", ("s", "2"): "b"}


def test_late_rows_do_not_replace_newer_ones(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), buckets=2, groups=2, versioned=True)
    store.save(batch(spark, ("s", "1", "old", 5), ("s", "2", "x", None)), "seq", DAY1)
    store.save(batch(spark, ("s", "1", "late", 4), ("s", "2", "y", 0), ("s", "3", "z", 1)), "seq", DAY2)
    assert held(store) == {("s", "1"): "old", ("s", "2"): "y", ("s", "3"): "z"}
    rows = {r["url"][-1]: r for r in store.read().collect()}
    assert rows["1"]["updated_at"] == datetime.datetime(2024, 1, 1) and "_seq" not in store.read().columns
    store.save(batch(spark, ("s", "1", "new", 6)), "seq", DAY3)
    assert TableStore(spark, str(tmp_path / "t")).versioned and held(store)["s", "1"] == "new"


def test_types_that_drift_are_widened(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), "cleaned", buckets=2, groups=1)
    save = lambda rows, schema, day: store.save(spark.createDataFrame(rows, schema), "seq", day)
    save([("s", "http://x.test/1", 7, 1, 1), ("s", "http://x.test/2", 8, 2, 1)], "site_name string, url string, stock int, score int, seq int", DAY1)
    save([("s", "http://x.test/1", "sold out", 2.5, 2)], "site_name string, url string, stock string, score double, seq int", DAY2)
    assert {r["url"][-1]: (r["stock"], r["score"]) for r in store.read().collect()} == {"1": ("sold out", 2.5), "2": ("8", 2.0)}
    save([("s", "http://x.test/3", 9, True, 3)], "site_name string, url string, stock int, score boolean, seq int", DAY3)
    assert {r["url"][-1]: (r["stock"], r["score"]) for r in store.read().collect()} == {"1": ("sold out", "2.5"), "2": ("8", "2.0"), "3": ("9", "true")}
    assert {r["url"][-1]: r["stock"] for r in store.read(1).collect()} == {"1": 7, "2": 8}


def test_odd_keys(spark):
    table = spark.createDataFrame(
        [(1, None, "u", "h", "a", "crawled", None, None)],
        "id long, site_name string, url string, url_hash string, raw_data string, status string, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([(None, None, "b", 1), (None, None, "c", 2), ("s", "", "d", None)], SCHEMA)
    out = upsert.raw_upsert(table, new, "seq", DAY1)
    assert sorted(((r["site_name"], r["raw_data"]) for r in out.collect()), key=repr) == [("s", "d"), (None, "a"), (None, "c")]
    again = upsert.raw_upsert(out, new, "seq", DAY2)
    assert again.count() == 3 and out.columns == table.columns


def test_the_order_of_saves_decides_not_the_clock(spark, tmp_path, monkeypatch):
    import os

    path, schema = str(tmp_path / "c"), f"page_no bigint, items {checkpoint.ITEMS}"
    put = lambda *pages, **how: checkpoint.save(spark.createDataFrame([(p, [{"n": v}]) for p, v in pages], schema), path, "x", **how)
    got = lambda: {r["page_no"]: r["items"][0]["n"] for r in checkpoint.load(spark, path, "x").collect()}
    put((1, "a"), (2, "a"))
    put((1, "b"))
    for f in (tmp_path / "c").rglob("part-*"):
        os.utime(f, (10**9, 10**9) if "save=000000000002" in str(f) else (2 * 10**9, 2 * 10**9))
    assert got() == {1: "b", 2: "a"}
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            put((3, "lost"))
    assert got() == {1: "b", 2: "a"}
    for k in range(4):
        put((2, f"v{k}"), most_saves=3)
    assert got() == {1: "b", 2: "v3"} and len(Versions(spark, f"{path}/sig=x").latest()[1]["saves"]) == 3


def test_an_append_reads_fingerprints_where_they_lie(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    rows = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) as link", "'x' as title")
    assert append_new(spark, rows(0, 40), path) == 40 and append_new(spark, rows(30, 60), path) == 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fresh_rows(spark, rows(0, 9), path)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "ReadSchema: struct<_fp:binary>" in plan
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            append_new(spark, rows(100, 110), path)
    assert appended(spark, path).count() == 60 and append_new(spark, rows(100, 110), path) == 10
    wider = rows(0, 2).selectExpr("link", "title", "if(link = '0', '', 'n') as note")  # an empty note is none
    assert append_new(spark, wider, path) == 1 and appended(spark, path, last=True).collect()[0]["note"] == "n"
    assert append_new(spark, rows(0, 5).selectExpr("title", "link"), path) == 0
