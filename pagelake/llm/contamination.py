"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item and a document are sets of word shingles.  Shingles are ordered by one hash; the
sketch of an item is its smallest hash values, and how many of them is set by the size
partition the item falls into: a document that contains at least the threshold share of an
item of q shingles misses at most ``q - ceil(share * q)`` of them, so of one more than that
at least one is found.  Within a partition (sizes q in [2^j, 2^(j+1))) every item keeps as
many values as its largest size needs, so no document at or above the threshold is missed.
Documents smaller than the item's share are skipped.  Candidates are verified by exact
containment over the shingles themselves.

Words are lower-cased runs of ASCII letters and digits and of characters beyond ASCII.  With
fewer words than a shingle has, the whole sequence is the one shingle; without words there
is none, and nothing is found.  Null texts count as empty, repeated rows once per (id, item);
rows with a null id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.columns import let, plain_words, words
from pagelake.llm.common import kept, text_column


def starts(w: Column, size: int) -> Column:
    """Where shingles start; none without words."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(own: Column, size: int) -> Column:
    """Hashes of the distinct shingles of an array of words."""
    return F.array_distinct(let(own, lambda w: F.transform(starts(w, size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))))


def shingles(own: Column, size: int) -> Column:
    """The distinct shingles as text."""
    return F.array_distinct(let(own, lambda w: F.transform(starts(w, size), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))))


def needed(share: float, q: Column) -> Column:
    """Shingles in common that reach the threshold share of q, counted in ten-thousandths."""
    return F.ceil(q * round(share * 10_000) / 10_000).cast("int")


def sketches(items: DataFrame, share: float) -> DataFrame:
    """(item_id, q, value): the smallest hashes of each item, as many as its partition needs."""
    largest = (F.pow(F.lit(2), F.floor(F.log2(F.col("q").cast("double"))) + 1).cast("long") - 1).alias("largest")
    sized = items.where("q > 0").select("item_id", "q", "hashes", largest)
    most = sized.withColumn("k", F.col("largest") - needed(share, F.col("largest")) + 1)
    return most.select("item_id", "q", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.least("k", "q").cast("int"))).alias("value"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = 0.8,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of all pairs at or above the threshold.

    The documents' hashes are exploded without their texts and joined with the sketches;
    only pairs that share a value go on.  Verification reads the texts of those documents
    again and takes each item's shingles beside them.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(plain_words(text_column(benchmark, item_text_col))).alias("w")).where(F.col("item_id").isNotNull())
    items = items.select("item_id", shingle_hashes(F.col("w"), shingle).alias("hashes"), shingles(F.col("w"), shingle).alias("item")).withColumn("q", F.size("hashes"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text")).where(F.col("doc_id").isNotNull())
    hashed = texts.select("doc_id", words(plain_words(F.col("text"))).alias("w")).select("doc_id", shingle_hashes(F.col("w"), shingle).alias("h"))
    values = hashed.select("doc_id", F.size("h").alias("n"), F.explode("h").alias("value"))
    candidates = (
        values.join(sketches(items, share), "value").where(F.col("n") >= needed(share, F.col("q")))
        .select("doc_id", "item_id").distinct()
    )
    candidates = kept(candidates)
    by_doc = candidates.join(items.select("item_id", "item"), "item_id")
    chosen = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = chosen.select("doc_id", shingles(words(plain_words(F.col("text"))), shingle).alias("doc"))
    n_common = F.size(F.array_intersect("item", "doc"))
    checked = sets.join(by_doc, "doc_id").select("doc_id", "item_id", F.size("item").alias("n_item"), n_common.alias("n_common"))
    return (
        checked.where(F.col("n_common") >= needed(share, F.col("n_item")))
        .groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_common").alias("n_common"))
        .withColumn("containment", F.col("n_common") / F.col("n_item"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no test item; rows with a null id stay."""
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("_bad_id"), "left_anti")
