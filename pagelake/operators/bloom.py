"""A bloom filter as a table of 64-bit words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.hashing import ERROR_RATE, bloom_positions, bloom_shape
from pagelake.functions.text import col


def shape_for(items: DataFrame, item: str, rate: float = ERROR_RATE) -> tuple[int, int]:
    """(bits, hashes) for the distinct items of a table, which are counted first: one row comes back."""
    n = items.select(col(item).alias("item")).filter("item is not null").distinct().count()
    return bloom_shape(max(n, 1), rate)


def positions(items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """``(item, pos)`` for each distinct item: copies cost nothing past the map side."""
    keys = items.select(col(item).alias("item")).filter("item is not null").distinct()
    return keys.select("item", F.explode(bloom_positions("item", bits, hashes)).alias("pos"))


def build(items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """``(word, bits)`` with the bits set by the items; partial ORs run before the shuffle."""
    pos = positions(items, item, bits, hashes)
    mask = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return pos.groupBy(F.expr("pos div 64").alias("word")).agg(F.bit_or(mask).alias("bits"))


def merge(*filters: DataFrame) -> DataFrame:
    """OR of filters of one shape, e.g. yesterday's and today's."""
    union = filters[0]
    for other in filters[1:]:
        union = union.unionByName(other)
    return union.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def contains(items: DataFrame, item: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``(item, maybe)`` per distinct item: true if all its bits are set.

    The probes, one per hash, carry a 16-byte digest instead of the item.
    """
    keys = items.select(col(item).alias("item")).filter("item is not null").distinct()
    named = keys.withColumn("_h", F.unhex(F.md5("item")))
    probes = named.select("_h", F.explode(bloom_positions("item", bits, hashes)).alias("pos")).withColumn(
        "word", F.expr("pos div 64")
    )
    bit = F.expr("coalesce(shiftrightunsigned(bits, cast(pos % 64 as int)) & 1L, 0L)")
    verdicts = probes.join(words, "word", "left").groupBy("_h").agg((F.min(bit) == 1).alias("maybe"))
    return named.join(verdicts, "_h").select("item", "maybe")


def count(words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Estimate of the number of items from the share of set bits: 0 if none, inf if all."""
    ratio = F.col("set_bits") / F.lit(float(bits))
    estimate = F.floor(-F.lit(bits / hashes) * F.log(1 - ratio)).cast("double")
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("set_bits")).select(
        "set_bits",
        F.when(F.col("set_bits") == 0, F.lit(0.0))
        .when(ratio >= 1, F.lit(float("inf")))
        .otherwise(estimate)
        .alias("estimate"),
    )


__all__ = ["bloom_shape", "build", "contains", "count", "merge", "positions", "shape_for"]
