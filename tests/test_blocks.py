"""Blocks by rows: a key with nine tenths of all rows, and one dense stretch of time."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ordered, proxies
from pagelake.operators.throttle import throttle


def dense(seed, n=3000):
    """Nine tenths on one key, most of them in one hundredth of the time."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.9
        t = 50_000 + rnd.randrange(1500) if hot and rnd.random() < 0.8 else rnd.randrange(150_000)
        rows.append((i, "hot" if hot else rnd.choice(["a", "b", None]), t, rnd.random() < 0.5))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, t bigint, ok boolean").repartition(5)


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("rows", [40, 333])
def test_no_block_is_much_longer_than_asked(spark, rows):
    data = dense(1)
    tagged = ordered.blocks(frame(spark, data), ["k"], "t", rows)
    sizes = tagged.groupBy("_g", "_block").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
    assert max(r["n"] for r in sizes) <= rows * 1.3 + 5
    for group in {r["_g"] for r in sizes}:
        mine = sorted((r for r in sizes if r["_g"] == group), key=lambda r: r["_block"])
        assert all(a["hi"] < b["lo"] for a, b in zip(mine, mine[1:]))
    assert sum(r["n"] for r in sizes) == len(data)


@pytest.mark.parametrize("interval", [1, 5, 40, 700, 10**6])
@pytest.mark.parametrize(("rows", "fan"), [(25, 2), (100, 3), (10**6, 64)])
def test_throttle_over_a_tree_of_blocks(spark, interval, rows, fan):
    data = dense(interval)
    want = {i for i, k, _, _ in data if k is None}
    for k, group in in_order(data).items():
        last = None
        for i, _, t, _ in group:
            if k is not None and (last is None or t - last >= interval):
                want.add(i)
                last = t
    assert {r["id"] for r in throttle(frame(spark, data), "k", "t", "id", interval, rows, fan).collect()} == want


def test_pacing_and_eviction(spark):
    data = dense(3)
    slots, evicted = {}, {}
    for k, group in in_order(data).items():
        free, fails = None, 0
        for i, _, t, ok in group:
            slots[i] = t if free is None else max(t, free)
            free = slots[i] + 17
            fails = 0 if ok else fails + 1
            if fails == 3:
                evicted.setdefault(k, t)
    got = ordered.paced(frame(spark, data), ["k"], "t", "id", 17, 60)
    assert {r["id"]: r["slot"] for r in got.collect()} == slots
    assert {r["k"]: r["evicted_at"] for r in proxies.evicted(frame(spark, data), 60, proxy="k").collect()} == evicted


def test_one_moment_and_no_rows(spark):
    data = [(i, "k", 7, True) for i in range(50)]
    got = ordered.running(frame(spark, data), ["k"], ["t", "id"], 10, sums={"s": F.col("id")})
    assert {r["id"]: r["s"] for r in got.collect()} == {i: i * (i + 1) // 2 for i in range(50)}
    assert throttle(frame(spark, []), "k", "t", "id", 5).collect() == [] and ordered.paced(frame(spark, []), ["k"], "t", "id", 5).collect() == []
