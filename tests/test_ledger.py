from pyspark.sql import functions as F

from pagelake.operators import alerts, assist, frontier, ledger, metrics, proxies


def tasks(spark, rows):
    return spark.createDataFrame(rows, "task_id string, status string, created_at double")


def test_final_status(spark):
    df = spark.createDataFrame(
        [("a", "failed", 0), ("a", "empty", 0), ("b", "failed", 0), ("b", "completed", 3), ("c", "reused", 2), ("d", "failed", 1)],
        "task_id string, status string, item_count int",
    )
    cancelled = spark.createDataFrame([("d",)], "task_id string")
    got = {r["task_id"]: r["status"] for r in ledger.task_status(df, cancelled).collect()}
    assert got == {"a": "failed", "b": "partial", "c": "completed", "d": "cancelled"}


def test_eviction_spares_open_tasks(spark):
    rows = [(f"t{i:02}", "running" if i < 5 else "completed", float(i)) for i in range(60)]
    kept = {r["task_id"] for r in ledger.evict_terminal(tasks(spark, rows)).collect()}
    assert kept == {f"t{i:02}" for i in range(60)} - {f"t{i:02}" for i in range(5, 15)}
    assert ledger.evict_terminal(tasks(spark, rows[:50])).count() == 50
    many_open = [(f"t{i:02}", "completed" if i < 3 else "pending", float(i)) for i in range(60)]
    assert ledger.evict_terminal(tasks(spark, many_open)).count() == 57


def test_sweep(spark):
    t = tasks(spark, [("a", "running", 1.0), ("b", "completed", 1.0), ("c", "interrupted", 1.0)]).withColumns(
        {"ended_at": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    p = spark.createDataFrame([("a", 1, "running", 0.0), ("a", 2, "completed", 0.0), ("b", 1, "running", 0.0), ("c", 1, "running", 0.0)],
                              "task_id string, page_no int, status string, updated_at double")
    swept, pages = ledger.restart_sweep(t, p, 9.0, "restart")
    assert {r["task_id"]: (r["status"], r["error"]) for r in swept.collect()} == {
        "a": ("interrupted", "restart"), "b": ("completed", None), "c": ("interrupted", None)}
    assert {(r["task_id"], r["page_no"]): r["status"] for r in pages.collect()} == {
        ("a", 1): "interrupted", ("a", 2): "completed", ("b", 1): "running", ("c", 1): "interrupted"}


def test_transitions(spark):
    t = spark.createDataFrame([("a", "pending"), ("b", "completed"), ("x", "running")], "task_id string, status string")
    events = [("a", "cancel", None, 1), ("a", "update", "completed", 2), ("a", "cancel", None, 3), ("b", "cancel", None, 1),
              ("c", "insert", None, 1), ("c", "update", "running", 2), ("c", "cancel", None, 3), ("d", "cancel", None, 1)]
    e = spark.createDataFrame(events, "task_id string, event string, status string, seq bigint")
    for width in (1, 1000):
        after, refused = ledger.task_transitions(t, e, width)
        assert {r["task_id"]: r["status"] for r in after.collect()} == {"a": "completed", "b": "completed", "c": "cancelling", "x": "running"}
        assert sorted(map(tuple, refused.collect()), key=str) == [("a", 3, "completed"), ("b", 1, "completed"), ("d", 1, None)]


def test_retry_plan(spark):
    rows = [("a", "failed", '{"pagination":{"type":"url_pattern"}}', False), ("b", "partial", '{"_checkpoint_scope":"s"}', False),
            ("c", "failed", "{}", True), ("d", "completed", "{}", False), ("e", "interrupted", "bad", None)]
    df = spark.createDataFrame(rows, "task_id string, status string, config_json string, has_redacted_secrets boolean")
    got = {r["parent_task_id"]: r for r in ledger.retry_plan(df, "r1").collect()}
    assert set(got) == {"a", "b", "e"}
    assert (got["a"]["checkpoint_scope"], got["a"]["retry_action"]) == ("a", "resume_pages")
    assert (got["b"]["checkpoint_scope"], got["b"]["retry_action"]) == ("s", "rerun")
    assert len({r["task_id"] for r in got.values()}) == 3 and all(len(r["task_id"]) == 12 for r in got.values())


def test_detail_and_logs(spark):
    t = spark.createDataFrame([("a", "running")], "task_id string, status string")
    p = spark.createDataFrame([("a", 2, "empty", None), ("a", 1, "failed", "e")], "task_id string, page_no int, status string, error string")
    logs = spark.range(1500).select(F.lit("a").alias("task_id"), "id", F.concat(F.lit("l"), "id").alias("text"))
    got = ledger.task_detail(t, p, logs)
    assert got.filter("part = 'page'").count() == 2
    row = got.filter("part = 'log'").agg(F.min("seq").alias("low"), F.count("*").alias("n")).first()
    assert (row["low"], row["n"]) == (500, 1000)
    tail = [r["text"] for r in ledger.log_tail(logs, 3).collect()]
    assert tail == ["l1497", "l1498", "l1499"]


def test_frontier(spark):
    rows = [("u1", "s", 5, 10.0), ("u2", "s", 7, 20.0), ("u3", "s", 7, 5.0), ("u4", "q", 0, 1.0)]
    df = frontier.with_hash(spark.createDataFrame(rows, "url string, site string, priority int, created_at double")).withColumns(
        {"depth": F.lit(0), "meta": F.lit(None).cast("map<string,string>"), "state": F.lit("queued")})

    def first(mode):
        return {r["site"]: r["url"] for r in frontier.next_tasks(df, mode).collect()}

    assert first("fifo") == {"s": "u3", "q": "u4"} and first("lifo") == {"s": "u2", "q": "u4"} and first("priority") == {"s": "u3", "q": "u4"}
    events = spark.createDataFrame([("u1", "pop", 1), ("u1", "fail", 2), ("u2", "pop", 1), ("u3", "pop", 1), ("u3", "complete", 2), ("u4", "pop", 1), ("u4", "fail", 2), ("u4", "fail", 3)],
                                   "url string, event string, seq int")
    events = frontier.with_hash(events).drop("url")
    after = frontier.apply_events(df, events)
    assert {r["url"]: (r["state"], r["priority"]) for r in after.collect()} == {"u1": ("queued", 4), "u2": ("processing", 7), "u4": ("queued", 0)}
    back = frontier.recover_stuck(after, 321.0)
    assert {r["url"]: (r["state"], r["recovered"]) for r in back.collect()}["u2"] == ("queued", True)
    assert {r["url"]: r["state"] for r in frontier.recover_stuck(after, 320.0).collect()}["u2"] == "processing"
    assert {(r["site"], r["state"]): r["n"] for r in frontier.sizes(after).collect()} == {("s", "queued"): 1, ("s", "processing"): 1, ("q", "queued"): 1}
    assert frontier.clear(df, ["s"]).count() == 1
    batch = spark.createDataFrame([(1, "u9"), (2, "u9"), (3, "u1")], "n int, url string")
    admitted = frontier.admit(batch, df, ["n"], 99.0)
    assert [(r["url"], r["created_at"], r["state"], r["meta"]) for r in admitted.collect()] == [("u9", 99.0, "queued", {})]


def test_histogram_and_alerts(spark):
    df = spark.createDataFrame([("s", 0.1), ("s", 0.2), ("s", 31.0), ("s", 2.0)], "site string, latency double")
    got = {r["le"]: r["n"] for r in metrics.latency_histogram(df).collect()}
    assert got == {"0.1": 1, "0.5": 2, "1.0": 2, "2.0": 3, "5.0": 3, "10.0": 3, "30.0": 3, "+Inf": 4}
    rates = spark.createDataFrame([("a", 0.79), ("b", 0.8)], "site string, rate double")
    assert [r["dedup_key"] for r in alerts.low_success(rates).collect()] == ["low_success_a"]
    sizes = spark.createDataFrame([("a", 10_000), ("b", 10_001)], "site string, size int")
    assert [r["site"] for r in alerts.queue_backlog(sizes).collect()] == ["b"]
    assert alerts.proxy_exhausted(spark.createDataFrame([(0,)], "available int")).count() == 1
    assert alerts.proxy_exhausted(spark.createDataFrame([(1,)], "available int")).count() == 0


def test_anonymity(spark):
    rows = [({"Via": "x"}, None), ({"via": "x", "Accept": "y"}, None), ({"Forwarded": ""}, "timeout"), (None, None)]
    df = spark.createDataFrame(rows, "h map<string,string>, e string")
    assert [r[0] for r in df.select(proxies.anonymity("h", "e")).collect()] == ["anonymous", "elite", "unknown", "unknown"]


def test_assist(spark):
    df = spark.createDataFrame([(1, "text one", "old"), (2, "", "old"), (3, "bad", "old")], "id int, body string, title string")

    def scorer(prompts):
        return prompts["user"].map(lambda u: "no json" if "bad" in u else 'Here:\n```json\n{"title": "New", "n": 3}\n```')

    rows = assist.extract_fields(df, ["title", "n"], scorer, "body").orderBy("id").collect()
    assert [(r["title"], r["n"]) for r in rows] == [("New", "3"), ("old", None), ("old", None)]
    assert assist.extract_fields(df, ["title"], None, "body").columns == df.columns
    labels = assist.classify(df, ["news", "shop"], lambda p: p["user"].map(lambda u: f'"shop" {len(u)}'), "body").orderBy("id").collect()
    assert [r["category"] for r in labels] == ["shop", None, "shop"]
    assert [r["body"] for r in assist.normalize(df, "body", lambda p: p["user"].str.upper() + " ").orderBy("id").collect()] == ["TEXT ONE", "", "BAD"]


def test_replies(values):
    got = values(['{"a":1}', 'x ```{"a":2}``` {y}', 'so {"a":3} end', "none", None, ""], lambda c: F.to_json(assist.parse_reply(c)))
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}', "{}", "{}", "{}"]
