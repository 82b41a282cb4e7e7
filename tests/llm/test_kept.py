"""What kept tables leave on disk, and the texts that stand in for sets."""

import time

import pyarrow as pa

from pagelake import session
from pagelake.llm import common, shingle_join


def test_a_kept_table_leaves_no_shuffle_files(spark):
    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (held.apply(i).getName() for i in range(held.size())) if f.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(common._CLEANUP)
    out = common.kept(spark.range(1000).repartition(4, "id"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 1000 and spark.conf.get(common._CLEANUP) == setting


def test_a_text_of_another_digest_gives_no_pair():
    digest = shingle_join.xxh3_128_digest(shingle_join.shingle_set(b"a b c d", 3).tobytes())
    batch = pa.RecordBatch.from_pydict({"a": [1, 2], "b": [3, 4], "dx": [digest, digest], "x": ["a b c d", "other words here"], "dy": [digest, digest], "y": ["A b c d"] * 2})
    pairs = list(shingle_join.set_pairs(batch, "a", "b", 3))
    assert [(a, b, p.tolist() == q.tolist()) for a, b, p, q in pairs] == [(1, 3, True)]


def test_prefixes_are_dropped_once_used(docs, monkeypatch):
    tables = []
    monkeypatch.setattr(shingle_join, "kept", lambda df: tables.append(common.kept(df)) or tables[-1])
    gone = []
    monkeypatch.setattr(shingle_join, "forget", lambda *some: gone.extend(t.kept_at for t in some) or common.forget(*some))
    out = shingle_join.near_duplicates(docs(["a b c d e f", "a b c d e f", "g h i j k l"])).collect()
    assert sorted(r["component_id"] for r in out) == [0, 0, 2]
    assert {t.kept_at for t in tables if "prefix" in t.columns} <= set(gone)


def test_a_table_kept_by_a_key_is_not_shuffled_by_it_again(spark):
    out = common.kept_by(spark.range(1000).selectExpr("id node", "cast(id as string) text"), "node")
    few = spark.range(500).selectExpr("id * 3 a").hint("merge")
    joined = few.join(out.withColumnRenamed("node", "a"), "a")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 334 and out.count() == 1000
    assert plan.count("Exchange hashpartitioning") == 1
    common.forget(out)


def test_pairs_leave_the_texts_where_they_are(docs, monkeypatch):
    by = []
    monkeypatch.setattr(shingle_join, "kept_by", lambda df, key: by.append((key, df.columns)) or common.kept_by(df, key))
    shingle_join.near_duplicates(docs(["a b c d e f", "a b c d e f g", "g h i j k l"]), shingle=3, num=50).collect()
    assert by == [("node", ["node", "digest", "text"])]


def test_a_kept_table_lets_the_driver_give_memory_back(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(common, "give_back", asked.append)
    assert common.kept(spark.range(10)).count() == 10
    assert common.kept_by(spark.range(10), "id").count() == 10
    assert len(asked) == 2


def test_garbage_goes_once_the_heap_has_grown_to_its_share(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collections = lambda: sum(b.getCollectionCount() for b in beans)
    assert session.give_back(spark, 2.0)[0] is False
    before = collections()
    assert session.give_back(spark, 0.0)[0] is True
    assert collections() > before


def test_a_driver_without_the_command_keeps_what_it_has(spark, monkeypatch):
    monkeypatch.setattr(session, "TRIM", "noSuchCommand")
    assert session.give_back(spark, 2.0) == (False, False)
