"""Keep-first dedup, admit-new and item fingerprints.

Keep-first is ``row_number() == 1``: Spark then puts a group limit before the
shuffle, so a hot key sends at most one row per map task, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import text as tx
from pagelake.functions.urls import url_fingerprint

#: Up to this many rows of a group Spark limits before the shuffle (``spark.sql.optimizer.windowGroupLimitThreshold``).
GROUP_LIMIT = 1000


def _cols(names: Iterable[str | Column]) -> list[Column]:
    return [F.col(f"`{n}`") if isinstance(n, str) else n for n in names]


def first_per_key(df: DataFrame, keys: list, order: list, limit: int = 1) -> DataFrame:
    """The first ``limit`` rows of every key by ``order`` (a missing key is a key).

    Spark limits groups before the shuffle up to a thousand rows. Beyond that a key is first dealt
    out over as many parts as there are shuffle partitions, by a hash of the row; each part keeps its first
    ``limit``, and only those meet.
    """
    if limit > GROUP_LIMIT:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hashed = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType)]
        salted = df.withColumn("_part", F.pmod(F.xxhash64(F.lit(0), *hashed), F.lit(parts)))
        df = _numbered(salted, [*_cols(keys), F.col("_part")], order).filter(F.col("_rn") <= limit).drop("_rn", "_part")
    return _numbered(df, _cols(keys), order).filter(F.col("_rn") <= limit).drop("_rn")


def _numbered(df: DataFrame, keys: list[Column], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*_cols(order))))


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(df, keys, order)


def latest_wins(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version per key."""
    return first_per_key(df, keys, [c.desc() for c in _cols(version)])


def dedup_safe(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first row per trimmed key; rows with a blank key are all kept.

    A blank row has a number of its own beside the key, so it is the first of its group whatever
    its order columns hold, and the input is read once.
    """
    blank = tx.is_blank(F.col(f"`{key}`"))
    keyed = df.withColumns(
        {"_key": F.when(~blank, tx.strip(F.col(f"`{key}`").cast("string"))), "_lone": F.when(blank, F.monotonically_increasing_id())}
    )
    return first_per_key(keyed, ["_key", "_lone"], order).drop("_key", "_lone")


def dedup_report(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows :func:`dedup_safe` keeps and drops.

    Rows are counted per key first, so that the final step sees one row per key and
    no distinct set is built in one place.
    """
    blank = tx.is_blank(F.col(f"`{key}`"))
    per_key = df.groupBy(
        F.when(~blank, tx.strip(F.col(f"`{key}`").cast("string"))).alias("_key")
    ).agg(F.count("*").alias("_n"))
    kept = F.sum(F.when(F.col("_key").isNull(), F.col("_n")).otherwise(1))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        F.coalesce(kept, F.lit(0)).alias("kept"),
        F.coalesce(F.sum("_n") - kept, F.lit(0)).alias("dropped"),
    )


def dedup_url(df: DataFrame, url: str, order: list[str]) -> DataFrame:
    """The first row per URL fingerprint, which stays as ``url_hash``."""
    return first_per_key(df.withColumn("url_hash", url_fingerprint(url)), ["url_hash"], order)


def admit_new(
    batch: DataFrame, history: DataFrame, url: str, order: list[str], history_hash: str = "url_hash"
) -> DataFrame:
    """Batch rows whose URL is new both to the history and within the batch.

    Exact. The history is reduced to one row per hash before it is shuffled, so a URL
    seen a billion times weighs no more than any other.
    """
    fresh = dedup_url(batch, url, order)
    seen = history.select(F.col(history_hash).alias("url_hash")).distinct()
    return fresh.join(seen, "url_hash", "left_anti")


def item_fingerprint(columns: list[str]) -> Column:
    """The set of the first three non-blank stripped values of an item, as text."""
    values = F.array(*[tx.strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns])
    some = F.slice(F.filter(values, lambda v: v != ""), 1, 3)
    return F.array_join(F.array_sort(F.array_distinct(some)), "\u0001")
