"""Streams over several files against their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from pagelake.operators.throttle import throttle
from pagelake.session import epoch_micros
from pagelake.sources.intake import stream_files
from pagelake.sources.store import TableStore
from pagelake.streaming import flows

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def events(spark, tmp_path):
    """The events as four files in order of time, and as one table."""
    rows = spark.read.parquet(EVENTS).withColumn("t", epoch_micros("ts")).withColumn("at", F.col("ts").cast("timestamp"))
    folder = tmp_path / "in"
    for i in range(4):
        part = rows.filter((F.col("event_id") >= 250 * i) & (F.col("event_id") < 250 * (i + 1)))
        part.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return stream_files(spark, str(folder), rows.schema, max_files=1), rows


def test_throttle_over_batches(events, tmp_path):
    stream, rows = events
    keyed = F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ")
    interval = 3 * 3_600_000_000
    out = flows.drain_to_files(
        flows.throttle(stream.withColumn("k", keyed), "k", "t", "event_id", interval), str(tmp_path / "out"), str(tmp_path / "ck")
    )
    want = throttle(rows.withColumn("k", keyed), "k", "t", "event_id", interval)
    assert {r["id"] for r in out.collect()} == {r["event_id"] for r in want.select("event_id").collect()}


def test_dedup_keeps_the_first_arrival(events, tmp_path):
    stream, rows = events
    url = F.concat(F.lit("http://u.test/"), "user_id", F.lit("#"), "event_id")
    out = flows.drain_to_files(flows.dedup(stream.withColumn("url", url), "url", "at", "90 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["user_id"]: r["event_id"] for r in out.collect()}
    assert out.count() == len(got) == rows.select("user_id").distinct().count()
    # Between files the earlier one wins.
    first = {r["user_id"]: r["f"] for r in rows.groupBy("user_id").agg(F.min("event_id").alias("f")).collect()}
    assert all(got[u] // 250 == first[u] // 250 for u in got)


def test_windows_equal_batch(events, tmp_path):
    stream, rows = events
    out = flows.windowed_metrics(stream, "at", "event_type", F.col("event_type") != "error", "value", delay="1 hour", window="6 hours")
    got = {(r["window_start"], r["event_type"]): (r["requests"], round(r["sum_latency"], 6)) for r in flows.drain_to_files(out, str(tmp_path / "out"), str(tmp_path / "ck")).collect()}
    batch = rows.groupBy(F.window("at", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    want = {(r["w"]["start"], r["event_type"]): (r["n"], round(r["s"], 6)) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = max(k[0] for k in want)
    assert {k for k in want if (last - k[0]).total_seconds() > 8 * 3600} <= set(got)


def test_upsert_is_idempotent(spark, events, tmp_path):
    stream, rows = events
    store = TableStore(spark, str(tmp_path / "store"), buckets=2)
    records = lambda df: df.select(
        F.col("event_type").alias("site_name"), F.concat(F.lit("http://u.test/"), "user_id").alias("url"), F.col("props").alias("raw_data"), "event_id")
    flows.drain(flows.upsert_sink(records(stream), store, "event_id", "2024-01-01 00:00:00", str(tmp_path / "ck")))
    want = {(r[0], r[1]): r[2] for r in records(rows).groupBy("site_name", "url").agg(F.max_by("raw_data", "event_id")).collect()}
    read = lambda: {(r["site_name"], r["url"]): r["raw_data"] for r in store.read().collect()}
    assert read() == want
    store.save(records(rows.filter("event_id >= 750")), "event_id", "2024-01-01 00:00:00")
    assert read() == want


def test_cleaning_is_the_same_plan(events, tmp_path):
    stream, rows = events
    rules = {"error": [{"type": "filter", "condition": "value > 20"}], "view": [{"type": "replace", "source": "props", "pattern": "k", "replacement": "K"}]}
    one = flows.drain_to_files(flows.clean(stream, rules, "event_type"), str(tmp_path / "out"), str(tmp_path / "ck"))
    two = flows.clean(rows, rules, "event_type")
    assert sorted(map(tuple, one.select("event_id", "props").collect())) == sorted(map(tuple, two.select("event_id", "props").collect()))


def test_stuck_timer(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "task string, event string, seq bigint"

    def land(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))

    land(("a", "pop", 1), ("b", "pop", 1), ("b", "complete", 2))
    stream = stream_files(spark, str(folder), schema, "json", max_files=1)
    out = flows.stuck_tasks(stream, "task", "event", 500)
    query = out.writeStream.format("memory").queryName("stuck").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 60
        n = 0
        while time.time() < deadline and not spark.table("stuck").count():
            # A timer fires in a later batch, so something must keep arriving.
            land((f"c{n}", "complete", 1))
            n += 1
            time.sleep(1)
        assert [r["task"] for r in spark.table("stuck").collect()] == ["a"]
    finally:
        query.stop()


def test_throttle_state_goes_with_the_watermark(spark, tmp_path):
    folder, schema = tmp_path / "in", "k string, at timestamp, id bigint"
    day = 86_400
    rows = [(f"k{i}", (i + 1) * day, i) for i in range(40)] + [("hot", day + i * day // 4, 100 + i) for i in range(160)]

    def land(part):
        spark.createDataFrame(part, "k string, s long, id long").select("k", F.timestamp_seconds("s").alias("at"), "id").coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = stream_files(spark, str(folder), schema).withColumn("t", F.unix_micros("at"))
        out = flows.throttle(stream, "k", "t", "id", day * 1_000_000, time="at", delay="1 hour")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    rows.sort(key=lambda r: r[1])
    land(rows[:100])
    run()
    land(rows[100:])
    kept = run()  # a restart goes on from the stored state
    want, last = set(), {}
    for k, s, i in rows:
        if k not in last or s - last[k] >= day:
            want.add(i)
            last[k] = s
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert kept[-1] < 12  # of 41 keys only those of the last day are held, with their timers


def test_stuck_since_is_the_same_over_two_batches(spark, tmp_path):
    folder, schema = tmp_path / "in", "task string, event string, at timestamp"

    def land(*rows):
        spark.createDataFrame(rows, "task string, event string, s long").select("task", "event", F.timestamp_seconds(F.col("s") + 1000).alias("at")).coalesce(1).write.mode("append").json(str(folder))

    def run():
        stream = stream_files(spark, str(folder), schema, "json")
        out = flows.drain_to_files(flows.stuck_since(stream, "task", "event", "at", 100_000), str(tmp_path / "out"), str(tmp_path / "ck"))
        return sorted((r["task"], int(r["popped_at"].timestamp()) - 1000) for r in out.collect())

    land(("a", "pop", 0), ("b", "pop", 10), ("c", "pop", 20), ("c", "complete", 119), ("d", "pop", 30), ("d", "complete", 130), ("e", "pop", 150))
    assert run() == [("d", 30)]  # the watermark stands at 90
    land(("b", "fail", 100), ("e", "complete", 249), ("f", "pop", 500))
    assert run() == [("a", 0), ("d", 30)]
