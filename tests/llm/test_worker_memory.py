"""What Python workers and the buffers before them hold of a task's rows."""

import pyarrow as pa

from pagelake.llm import common, quality, shingle_join

TEXTS = ["the plain words of a text", "the### plain&&& words%%%", "", None] * 5


def test_python_gets_the_text_once_and_gives_scores_alone(docs):
    df = docs(TEXTS)
    model = quality.train(df, df.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) quality"))
    scored = quality.score(df, model, keep=tuple(df.columns))
    plan = scored.where("score >= 0.5").select("kept.*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "MapInArrow" not in plan
    found = {r["doc_id"]: r for r in scored.collect()}
    alone = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert len(found) == len(TEXTS) and alone == {i: r["score"] for i, r in found.items()}
    assert [found[i]["kept"]["text"] for i in range(len(TEXTS))] == TEXTS


def test_known_words_are_kept_as_bytes():
    features = quality.Indicators(18)
    first = features.slots(b"One two, one TWO three")
    assert {len(v) for v in features.memo.young.values()} == {16} and all(type(v) is bytes for v in features.memo.young.values())
    assert (features.slots(b"One two, one TWO three") == first).all()


def test_the_join_hands_small_batches_to_python(spark, docs, monkeypatch):
    seen, before = [], spark.conf.get(common._BATCH)

    def watched(df):
        seen.append(spark.conf.get(common._BATCH))
        return common.kept(df)

    monkeypatch.setattr(shingle_join, "kept", watched)
    found = shingle_join.near_duplicates(docs(["a b c d e f", "a b c d e f", "g h i j k l"])).collect()
    assert sorted(r["component_id"] for r in found) == [0, 0, 2]
    assert set(seen) == {f"{4 << 20}b"} and spark.conf.get(common._BATCH) == before


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('abcdefgh ', 1000) text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    with common.small_batches(spark):
        most = max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect())
    assert most <= 5 << 20


def test_freed_memory_goes_back_after_each_batch(monkeypatch):
    back = []

    class Pool:
        def release_unused(self):
            back.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 100] * 10})
    assert sum(b.num_rows for b in common.blocks(iter([batch, batch]), "text", 250)) == 20 and len(back) == 2
