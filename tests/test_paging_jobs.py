"""Jobs that page by next links and by scrolling, positions of captured items, and jobs run to their end."""

import json

import pytest

from pagelake import run_job
from pagelake.operators import paging
from pagelake.plans import job
from pagelake.sources import checkpoint

FIELDS = {"title": "a::text", "link": "a::attr(href)"}
BASE = {"name": "books", "render": "playwright", "first_url": "http://b.test/p/1", "item_selector": "li.item", "fields": FIELDS}


def page(no, ids, after="", state=""):
    boxes = "".join(f'<li class="item"><a href="/d/{i}">Book {i}</a></li>' for i in ids)
    button = f'<ul><li class="turn {state}"><a href="{after}">next</a></li></ul>' if after is not None else ""
    return (no, f"http://b.test/p/{no}", f"<ul>{boxes}</ul>{button}")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "page_no int, url string, html string")


def got(df, *columns):
    return [tuple(r) for r in df.orderBy("page_no", "item_idx").select(*columns).collect()]


def walk(spark, rows, **plan):
    config = {**BASE, "pagination": {"type": "next_button", "next_selector": "li.turn", "max_pages": 10, **plan}}
    return got(run_job(frame(spark, *rows), config), "page_no", "title")


def test_next_links_are_followed_to_their_end(spark):
    rows = [page(7, [70], "/p/1"), page(3, [3, 33], None), page(1, [1], "/p/5"), page(5, [5], "3")]
    assert walk(spark, rows) == [(1, "Book 1"), (2, "Book 5"), (3, "Book 3"), (3, "Book 33")]
    assert walk(spark, rows, max_pages=2) == [(1, "Book 1"), (2, "Book 5")]
    assert walk(spark, rows, max_pages=1) == [(1, "Book 1")]


@pytest.mark.parametrize(
    "second", [page(2, [1, 9], "/p/3"), page(2, [], "/p/3"), None], ids=["same first item", "no items", "not fetched"])
def test_a_page_that_shows_nothing_new_ends_the_walk(spark, second):
    rows = [page(1, [1], "/p/2"), page(3, [3], None)] + ([second] if second else [])
    assert walk(spark, rows) == [(1, "Book 1")]


def test_a_disabled_button_ends_the_walk(spark):
    rows = [page(1, [1], "/p/2", "is-Disabled"), page(2, [2], None)]
    assert walk(spark, rows) == [(1, "Book 1")]
    assert walk(spark, rows, disabled_marker="gone") == [(1, "Book 1"), (2, "Book 2")]


def test_circles_end(spark):
    assert walk(spark, [page(1, [1], "/p/2"), page(2, [2], "/p/1")]) == [(1, "Book 1"), (2, "Book 2")]


def test_scrolling_takes_what_is_new(spark):
    shown = [[1, 2], [1, 2, 3], [2, 3], [3], [1], [9], [10]]
    rows = [page(k + 1, ids) for k, ids in enumerate(shown)]
    run = lambda most: got(run_job(frame(spark, *rows), {**BASE, "pagination": {"type": "infinite_scroll", "max_scrolls": most}}), "page_no", "title")
    assert run(50) == [(1, "Book 1"), (1, "Book 2"), (2, "Book 3")]  # three quiet rounds after the second
    assert run(1) == [(1, "Book 1"), (1, "Book 2")]


def test_positions_go_on_over_the_responses_of_a_page(spark):
    body = lambda *ids: json.dumps([{"t": f"r{i}", "u": f"/d/{i}"} if i else "noise" for i in ids])
    responses = spark.createDataFrame([(1, "http://b.test/api", body(3, 0, 4), 2), (1, "http://b.test/api", body(1, 2), 1)], "page_no int, url string, body string, seq int")
    details = spark.createDataFrame([(f"http://b.test/d/{i}", f"<p>text {i}</p>") for i in range(5)], "url string, html string")
    config = {
        **BASE, "render": "direct", "api": {"fields": {"title": "t", "link": "u"}}, "detail": {"link_field": "link", "fields": {"text": "p"}, "limit": 3},
    }
    out = run_job(frame(spark, page(1, [8])), config, responses=responses, details=details)
    rows = got(out, "item_idx", "title", "text")
    assert [r[1] for r in rows] == ["r1", "r2", "r3", "r4"] and len({r[0] for r in rows}) == 4
    assert [bool(r[2]) for r in rows] == [True, True, True, False]


def test_blank_keys_do_not_read_the_pages_twice(spark):
    out = run_job(frame(spark, page(1, [1, 1, 2])), {**BASE, "render": "direct", "dedup": {"key": "link"}})
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [r[0] for r in got(out, "title")] == ["Book 1", "Book 2"]


def test_a_job_goes_on_where_it_failed(spark, tmp_path, monkeypatch):
    config = {"name": "books", "pagination": {"type": "url_pattern", "url_pattern": "http://b.test/p/{page}", "max_pages": 5}, "item_selector": "li.item", "fields": FIELDS, "resume": True, "concurrency": 2}
    root = str(tmp_path / "job")
    with monkeypatch.context() as m:
        m.setattr(job, "store_result", lambda *a: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            job.complete_job(frame(spark, page(1, [1, 2])), config, root)
    sig = job.contract_signature(config, None)
    assert checkpoint.load(spark, f"{root}/checkpoints", sig).count() == 1
    changed = frame(spark, page(1, [99]), page(2, [3]))  # page 1 is not read again
    assert job.complete_job(changed, config, root) == 3
    assert checkpoint.load(spark, f"{root}/checkpoints", sig).count() == 0
    assert job.complete_job(frame(spark, page(1, [1, 2]), page(2, [3]), page(3, [4])), config, root) == 1


def test_a_walk_reads_its_pages_once(spark):
    """Every round needs the pages; what they are made of must not run again for each."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"u{i}", f"u{i + 1}", False, f"item {i}") for i in range(12)]
    shape = "url string, next_url string, disabled boolean, first_item string"
    pages = spark.createDataFrame(rows, shape).mapInArrow(count, shape)
    walk = paging.next_walk(pages, spark.createDataFrame([("u0",)], "url string"), 10)
    assert sorted(r["pos"] for r in walk.collect()) == list(range(1, 11))
    assert read.value == len(rows)
