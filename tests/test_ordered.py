"""Order-dependent operators against plain loops, with one group holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ordered, paging, proxies
from pagelake.operators.throttle import throttle


def events(seed, n=900, span=5000, ties=True):
    rnd = random.Random(seed)
    keys = ["hot"] * (n // 3) + [rnd.choice(["a", "b", "c", None]) for _ in range(n - n // 3)]
    return [(i, k, rnd.randrange(span // (3 if ties else 1)) * (3 if ties else 1), rnd.random() < 0.4) for i, k in enumerate(keys)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, t bigint, ok boolean").repartition(5)


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("width", [50, 700, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_pacing(spark, seed, width):
    rows = events(seed)
    want = {}
    for group in groups(rows).values():
        free = None
        for i, _, t, _ in group:
            slot = t if free is None else max(t, free)
            want[i], free = slot, slot + 17
    got = ordered.paced(frame(spark, rows), ["k"], "t", "id", 17, width)
    assert {r["id"]: r["slot"] for r in got.collect()} == want


@pytest.mark.parametrize("width", [60, 900, 10**6])
@pytest.mark.parametrize("interval", [1, 7, 60])
def test_throttle(spark, width, interval):
    rows = events(interval + width)
    want = {i for i, k, _, _ in rows if k is None}
    for k, group in groups(rows).items():
        last = None
        for i, _, t, _ in group:
            if k is not None and (last is None or t - last >= interval):
                want.add(i)
                last = t
    got = throttle(frame(spark, rows), "k", "t", "id", interval, width)
    assert {r["id"] for r in got.collect()} == want


def test_eviction(spark):
    rows = events(5)
    want = {}
    for k, group in groups(rows).items():
        fails = 0
        for _, _, t, ok in group:
            fails = 0 if ok else fails + 1
            if fails == 3:
                want.setdefault(k, t)
    got = proxies.evicted(frame(spark, rows), 400, proxy="k")
    assert {r["k"]: r["evicted_at"] for r in got.collect()} == want


@pytest.mark.parametrize("width", [30, 10**6])
def test_running(spark, width):
    rows = events(6)
    want = {}
    for group in groups(rows).values():
        total, top = 0, None
        for i, _, t, ok in group:
            total += i
            top = max(x for x in (top, i if ok else None) if x is not None) if ok or top is not None else None
            want[i] = (total, top)
    got = ordered.running(
        frame(spark, rows), ["k"], ["t", "id"], width, sums={"s": F.col("id")}, maxima={"m": F.when(F.col("ok"), F.col("id"))}
    )
    assert {r["id"]: (r["s"], r["m"]) for r in got.collect()} == want


def test_numbering_and_chunks(spark):
    rows = events(8)
    df = frame(spark, rows)
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    got = ordered.number_rows(df, [F.desc("t"), F.col("id")], partitions=6)
    assert {r["id"]: r["row_no"] for r in got.collect()} == want
    chunks = ordered.chunk(df, ["id"], 250).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in chunks] == [(0, 250), (1, 250), (2, 250), (3, 150)]


def walk(pages, seed, most):
    at, seen = seed, []
    while at in pages and at not in seen and len(seen) < most:
        seen.append(at)
        nxt, disabled, first = pages[at]
        if disabled or nxt not in pages or not pages[nxt][2] or pages[nxt][2] == (first or "?"):
            break
        at = nxt
    return {(seed, u, i + 1) for i, u in enumerate(seen)}


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_next_walk(spark, most):
    rnd = random.Random(9)
    pages = {
        f"u{i}": (None if rnd.random() < 0.05 else f"u{i + 1}" if rnd.random() < 0.9 else f"u{rnd.randrange(80)}",
                  rnd.random() < 0.03, rnd.choice(["x", "y", "z", "w", "v", "", None, f"i{i}", f"j{i}"]))
        for i in range(80)
    }
    df = spark.createDataFrame([(u, *v) for u, v in pages.items()], "url string, next_url string, disabled boolean, first_item string")
    seeds = ["u0", "u5", "u17", "u40", "missing"]
    got = paging.next_walk(df, spark.createDataFrame([(s,) for s in seeds], "url string"), most)
    assert {tuple(r) for r in got.select("seed", "url", "pos").collect()} == set().union(*(walk(pages, s, most) for s in seeds))


def test_a_url_with_many_rows_is_one_page(spark):
    rows = [(f"u{i}", f"u{i + 1}", False, f"i{i}") for i in range(12) for _ in range(5)]
    df = spark.createDataFrame(rows, "url string, next_url string, disabled boolean, first_item string")
    got = paging.next_walk(df, spark.createDataFrame([("u0",), ("u0",)], "url string"), 100)
    assert sorted(tuple(r) for r in got.select("pos", "url").collect()) == [(i + 1, f"u{i}") for i in range(12)]


def test_scroll(spark):
    rnd = random.Random(10)
    rows = []
    for session in range(12):
        for snap in range(1, 31):
            for idx in range(rnd.randrange(3)):
                rows.append((session, snap, idx, f"f{rnd.randrange(4 + snap // 2)}"))
    want = set()
    for session in range(12):
        seen, quiet, n = set(), 0, 0
        while quiet < 3 and n < 20:
            n += 1
            new = {}
            for s, snap, idx, fp in rows:
                if s == session and snap == n and fp not in seen:
                    new.setdefault(fp, idx)
            quiet = 0 if new else quiet + 1
            want |= {(session, fp, n, idx) for fp, idx in new.items()}
            seen |= set(new)
    df = spark.createDataFrame(rows, "session int, snap int, idx int, fp string")
    got = paging.scroll_accumulate(df, "session", "snap", "idx", "fp", max_scrolls=20)
    assert {tuple(r) for r in got.select("session", "fp", "snap", "idx").collect()} == want


def test_serial_stop_and_seeds(spark):
    df = spark.createDataFrame(
        [("j", 1, 3, False), ("j", 2, 1, False), ("j", 3, 0, False), ("j", 4, 5, False), ("k", 1, 2, True), ("l", 1, 1, None)],
        "job string, page_no int, n_items int, failed boolean",
    )
    got = paging.page_stop_serial(df, ["job"]).select("job", "page_no").collect()
    assert sorted(map(tuple, got)) == [("j", 1), ("j", 2), ("l", 1)]
    seeds = paging.seed_pages(spark, "http://a.test/{page:03d}/{page}", 9, 2).orderBy("page_no").collect()
    assert [tuple(r) for r in seeds] == [(9, "http://a.test/009/9"), (10, "http://a.test/010/10")]
    with pytest.raises(ValueError):
        paging.page_urls("http://a.test/{id}")
