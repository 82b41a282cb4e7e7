"""The pipeline's stages on the smallest tables, each on what its predecessor kept."""

import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from pagelake.llm import contamination, pii, shingle_join
from pagelake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.dtypes, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.dtypes == columns, name
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, single, clean, redacted = seen
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in good) and all(i in good for i, q in labels.items() if q)
    found = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(spark.createDataFrame(list(good.items()), "doc_id long, text string")).collect()}
    assert set(single) == {i for i, c in found.items() if i == c}
    held = contamination.contaminated(spark.createDataFrame(list(single.items()), "doc_id long, text string"), spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert set(clean) == set(single) - {r["doc_id"] for r in held.collect()}
    assert set(redacted) == set(clean)
    left = pii.report(docs).selectExpr(*[f"sum(n_{k}) as {k}" for k in pii.KINDS]).first()
    assert tuple(left) == (0, 0, 0, 0)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    from tokenizers import Tokenizer

    native = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"] for r in pieces} == set(redacted)
    for r in pieces[:50]:
        import numpy as np

        ids = np.array([*native.encode(redacted[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


TABLES = {"op3": "embeddings", "op12": "conversations", "op13": "embeddings"}
#: Queries that do not give one row for every row of their table.
OTHER_ROWS = ("op1", "op7", "op12", "op13")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_table(spark, name):
    op = name.split("_")[0]
    table = TABLES.get(op, "documents")
    key = {"documents": "doc_id", "embeddings": "vec_id", "conversations": "conv_id"}[table]
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    found = QUERIES[name](spark, FOLDER)
    if op not in OTHER_ROWS:
        assert found.count() == rows.count()
    if op != "op7":
        assert found.select(key).distinct().count() == rows.select(key).distinct().count()
