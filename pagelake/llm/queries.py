"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import contamination, langid, licenses, line_runs, near_vectors, packing, pii, quality, shingle_join, suffix_dedup, token_counts, turns, whitening
from pagelake.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = run
        return fn

    return register


@query("op1_packing")
def op1(table):
    return packing.pack(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_quality")
def op2(table):
    return quality.quality_scores(table("documents"), table("labels"))


@query("op3_near_vectors")
def op3(table):
    return near_vectors.near_vectors(table("embeddings"))


@query("op4_pii")
def op4(table):
    return pii.report(table("documents"))


@query("op5_token_counts")
def op5(table):
    return token_counts.count_tokens(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_langid")
def op6(table):
    return langid.identify(table("documents"))


@query("op7_contamination")
def op7(table):
    return contamination.contaminated(table("documents"), table("benchmark"))


@query("op8_shingle_join")
def op8(table):
    return shingle_join.near_duplicates(table("documents"), shingle=3, num=90, den=100)


@query("op9_licenses")
def op9(table):
    return licenses.scan(table("documents"))


@query("op10_suffix_dedup")
def op10(table):
    return suffix_dedup.remove_repeats(table("documents")).drop("kept")


@query("op11_line_dedup")
def op11(table):
    found = line_runs.drop_repeated(table("documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = """
    with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    lines as (
        select r, doc_id, unnest(string_split(text, chr(10))) as line,
               unnest(range(len(string_split(text, chr(10))))) as pos from docs
    ), keyed as (
        select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
    ), held as (
        select k, min(doc_id) as first_doc from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
    ), marked as (
        select r, doc_id, line, pos, first_doc is not null and doc_id <> first_doc as gone from keyed left join held using (k)
    )
    select doc_id, count(*) as n_lines, count_if(gone)::bigint as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
    from marked group by r, doc_id
"""


@query("op12_turns")
def op12(table):
    rows = table("conversations")
    return turns.repaired_digests(turns.damage(rows), rows)


@query("op13_whitening")
def op13(table):
    return whitening.whiten(table("embeddings"))
