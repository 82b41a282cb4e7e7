import pytest
from pyspark.sql import functions as F

from pagelake import JobConfig, run_job
from pagelake.plans import job
from pagelake.sources import checkpoint

CONFIG = {
    "name": "books", "pagination": {"type": "url_pattern", "url_pattern": "http://b.test/page/{page}", "max_pages": 5},
    "item_selector": "li", "fields": {"title": "a::text", "link": "a::attr(href)"},
}


def page(no, ids):
    boxes = "".join(f'<li><a href="/d/{i}"> Book  {i} </a></li>' for i in ids)
    return (no, f"http://b.test/page/{no}", f"<ul>{boxes}<li></li></ul>")


@pytest.fixture
def pages(spark):
    def make(*rows):
        return spark.createDataFrame([page(*r) for r in rows], "page_no int, url string, html string")

    return make


def got(df, *columns):
    return [tuple(r) for r in df.orderBy("page_no", "item_idx").select(*columns).collect()]


def test_two_pages_of_twenty(pages):
    df = run_job(pages((1, range(20)), (2, range(20, 40))), CONFIG)
    assert df.count() == 40
    assert got(df, "title", "link")[0] == ("Book 0", "/d/0")


def test_concurrent_equals_serial_and_only_serial_stops(pages):
    both = pages((1, range(10)), (2, range(10, 20)))
    assert got(run_job(both, CONFIG), "title") == got(run_job(both, {**CONFIG, "concurrency": 4}), "title")
    gap = pages((1, [1]), (2, []), (3, [3]), (9, [9]))
    assert got(run_job(gap, CONFIG), "page_no") == [(1,)]
    assert got(run_job(gap, {**CONFIG, "concurrency": 4}), "page_no") == [(1,), (3,)]


def test_resume_reuses_pages(spark, pages):
    schema = f"page_no bigint, items {checkpoint.ITEMS}"
    done = spark.createDataFrame([(1, [{"title": "kept", "link": "/k"}, {"title": "two"}])], schema)
    new = run_job(pages((1, [1]), (2, [2])), {**CONFIG, "resume": True}, checkpoint=done)
    assert got(new, "page_no", "title", "link") == [(1, "kept", "/k"), (1, "two", ""), (2, "Book 2", "/d/2")]
    assert got(run_job(pages((1, [1])), CONFIG, checkpoint=done), "title") == [("Book 1",)]


def test_details_then_cleaning_then_dedup(spark, pages):
    details = spark.createDataFrame(
        [("http://b.test/d/1", "<h1>ONE 1</h1>"), ("http://b.test/d/2", "<h1>captcha</h1>"), ("http://b.test/d/3", "<h1>ONE 3</h1>")],
        "url string, html string",
    )
    config = {
        **CONFIG, "concurrency": 2, "first_url": "http://b.test/", "detail": {"link_field": "link", "fields": {"title": "h1", "extra": "h1"}},
        "postprocess": {"title": {"lower": True, "regex_replace": [r"\d", ""]}}, "dedup": {"key": "title"},
    }
    df = run_job(pages((1, [1, 2, 3, 4])), config, details=details)
    assert got(df, "title", "extra") == [("one ", "ONE 1"), ("book ", None)]
    few = run_job(pages((1, [1, 2, 3, 4])), {**config, "detail": {**config["detail"], "limit": 1}, "dedup": {}}, details=details)
    assert got(few, "extra") == [("ONE 1",), (None,), (None,), (None,)]


def test_json_pages_captured_responses_and_challenges(spark, pages):
    rows = spark.createDataFrame(
        [(1, "u1", ' {"d":[{"t":"j"}]}'), (2, "u2", "<li><a href=x>h</a></li>"), (3, "u3", "<title>just-a-moment</title><li><a href=x>c</a></li>"), (4, "u4", "")],
        "page_no int, url string, html string",
    )
    config = {**CONFIG, "concurrency": 2, "api": {"item_path": "d", "fields": {"title": "t"}}}
    assert got(run_job(rows, config), "page_no", "title", "link") == [(1, "j", None), (2, "h", "x")]
    captured = spark.createDataFrame([(2, "u2", '{"d":[{"t":"api"},7]}')], "page_no int, url string, body string")
    assert got(run_job(rows, config, responses=captured), "page_no", "title") == [(1, "j"), (2, "api")]
    report = job.page_report(rows, run_job(rows, config))
    assert {r["page_no"]: r["status"] for r in report.collect()} == {1: "completed", 2: "completed", 3: "empty", 4: "failed"}


def test_robots_and_hooks(spark, pages):
    rules = spark.createDataFrame([("b.test", "*", 0, False, "/page/2")], "host string, agent string, ordinal int, allow boolean, path string")
    config = {**CONFIG, "concurrency": 2, "respect_robots": True}
    df = run_job(pages((1, [1]), (2, [2])), config, robots_rules=rules, transforms=(lambda d: d.withColumn("n", F.length("title")),))
    assert got(df, "page_no", "n") == [(1, 6)]


def test_store(spark, pages, tmp_path):
    cfg = JobConfig.of({**CONFIG, "concurrency": 2})
    path = str(tmp_path / "items")
    assert job.store_result(run_job(pages((1, range(20)), (2, range(20, 40))), cfg), cfg, path) == 40
    assert job.store_result(run_job(pages((1, range(20)), (2, range(20, 40)), (3, range(40, 60))), cfg), cfg, path) == 20
