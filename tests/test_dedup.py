import random

from pyspark.sql import functions as F

from pagelake.operators import bloom, dedup, enrich, upsert


def test_overlapping_pages(spark):
    """Three pages of ten with overlapping tails: 24 unique, both blank links stay."""
    links = [f"l{i}" for i in range(9)] + [""] + [f"l{i}" for i in range(6, 16)] + [f" l{i} " for i in range(13, 22)] + [None]
    df = spark.createDataFrame([(i // 10, i % 10, v) for i, v in enumerate(links)], "page_no int, item_idx int, link string")
    kept = dedup.dedup_safe(df, "link", ["page_no", "item_idx"]).orderBy("page_no", "item_idx").collect()
    assert len(links) == 30 and len(kept) == 24
    assert [r["link"] for r in kept if not (r["link"] or "").strip()] == ["", None]
    assert dedup.dedup_report(df, "link").first().asDict() == {"total": 30, "kept": 24, "dropped": 6}


def hot_rows(spark, n=6000):
    """A third of all rows share one key, another third has none."""
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else "" if i % 3 == 1 else f"k{rnd.randrange(500)}", rnd.random()) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id int, k string, v double").repartition(6)


def test_hot_and_blank_keys(spark):
    rows, df = hot_rows(spark)
    best = {}
    for i, k, _ in rows:
        if k and i < best.get(k, 1 << 30):
            best[k] = i
    want = sorted(list(best.values()) + [i for i, k, _ in rows if not k])
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert [r["id"] for r in dedup.dedup_safe(df, "k", ["id"]).orderBy("id").collect()] == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_key_is_cut_before_the_shuffle(spark):
    _, df = hot_rows(spark, 300)
    for out in (dedup.dedup_safe(df, "k", ["id"]), dedup.latest_wins(df, ["k"], ["id"]), dedup.dedup_first(df, ["k"], ["id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_null_is_a_key_for_plain_dedup(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id int, k string")
    assert [r["id"] for r in dedup.dedup_first(df, ["k"], ["id"]).orderBy("id").collect()] == [1, 3]


def test_admit_new(spark):
    batch = spark.createDataFrame([(1, "http://A.test/x"), (2, "http://a.test/x#f"), (3, "http://a.test/old"), (4, "http://a.test/?b=1&a=2")], "id int, url string")
    seen = spark.createDataFrame([("http://a.test/old",), ("http://a.test/?a=2&b=1",)], "url string")
    seen = seen.unionByName(seen).select(dedup.url_fingerprint("url").alias("url_hash"))
    assert [r["id"] for r in dedup.admit_new(batch, seen, "url", ["id"]).collect()] == [1]


def test_item_fingerprint_is_a_set(spark):
    df = spark.createDataFrame([("b", " ", "a", "z", "q"), ("a", "b", None, " z", "other"), ("a", "a", "b", "c", "")], "a string, b string, c string, d string, e string")
    one, two, three = [r["fp"] for r in df.select(dedup.item_fingerprint(df.columns).alias("fp")).collect()]
    assert one == two == "a\u0001b\u0001z" and three == "a\u0001b"


def test_bloom(spark):
    bits, hashes = bloom.bloom_shape(500, 0.01)
    items = spark.range(500).select(F.concat(F.lit("u"), "id").alias("item"))
    words = bloom.build(items.unionByName(items), "item", bits, hashes)
    halves = bloom.merge(
        bloom.build(items.filter("item < 'u3'"), "item", bits, hashes), bloom.build(items.filter("item >= 'u3'"), "item", bits, hashes)
    )
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, halves.collect()))
    assert bloom.contains(items, "item", words, bits, hashes).filter("not maybe").count() == 0
    others = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("item"))
    wrong = bloom.contains(others, "item", words, bits, hashes).filter("maybe").count()
    assert wrong < 2000 * 0.05
    assert 450 <= bloom.count(words, bits, hashes).first()["estimate"] <= 550
    assert bloom.count(words.limit(0), bits, hashes).first()["estimate"] == 0
    full = spark.createDataFrame([(0, -1)], "word bigint, bits bigint")
    assert bloom.count(full, 64, 2).first()["estimate"] == float("inf")


def test_idempotent_append_counts_new_rows_only(spark):
    first = spark.createDataFrame([(f"l{i}", f"t{i}") for i in range(40)], "link string, title string")
    more = spark.createDataFrame([(f"l{i}", f"t{i}") for i in range(60)] + [("l59", "t59")], "link string, title string")
    assert upsert.idempotent_append(first, more).count() == 20
    # A column added later does not make the old rows new; a missing value is ''.
    wider = first.withColumn("note", F.lit("")).unionByName(spark.createDataFrame([("l0", "t0", "n")], "link string, title string, note string"))
    assert [tuple(r) for r in upsert.idempotent_append(first, wider).collect()] == [("l0", "t0", "n")]
    # Values do not run into each other.
    a = spark.createDataFrame([("1:a", "")], "x string, y string")
    b = spark.createDataFrame([("1", "a"), ("", "1:a"), ("1:a", None)], "x string, y string")
    assert upsert.idempotent_append(a, b).count() == 2


def test_blank_keys_are_kept_where_the_order_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (" ", 1), (None, 1), ("", 1), ("", 1)], "link string, n int")
    kept = [r["link"] for r in dedup.dedup_safe(df, "link", ["n"]).collect()]
    assert sorted(k or "" for k in kept) == ["", "", "", " ", "a"]


def test_more_rows_of_a_key_than_spark_limits_early(spark):
    from pagelake.operators import dedup

    rows = [("hot" if i % 10 else f"k{i % 7}", (i * 7919) % 100_003, i) for i in range(9000)] + [(None, 5, -1), (None, 5, -2)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(6)
    want = set()
    for key in {r[0] for r in rows}:
        want |= {r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:1500]}
    got = dedup.first_per_key(df, ["k"], [F.desc("t"), F.col("id")], 1500)
    assert {r["id"] for r in got.collect()} == want and got.columns == df.columns
