"""The URLs seen so far: their fingerprints on Parquet, and bloom filters in front of them.

A filter is a table of blocks of eight 64-bit words. A URL has one block and one bit in each of
its words, so a batch asks it with a single join on the block, of which the filter's side lies
in buckets and is not shuffled. What a filter denies is new; only what it does not deny is held against the
fingerprints, of which only the slots concerned are read. New URLs are ORed into the
youngest filter. One that has taken in the URLs it is made for is left as it is, and the next is twice its size,
so that the share of false alarms keeps its bound (about 1 in 1,500 each) however many there are.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.dedup import dedup_url
from pagelake.sources.bucketed import read_bucketed, write_bucketed
from pagelake.sources.versions import Versions, remove

WORDS = 8
#: 512 bits a block, 16 a URL.
URLS_PER_BLOCK = 32
FILTER = "block bigint, " + ", ".join(f"w{i} bigint" for i in range(WORDS))


def masks() -> list[Column]:
    """The bit of each word for ``url_hash``."""
    h = F.xxhash64(F.lit(7), "url_hash")
    place = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in place]


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("url_hash"), F.lit(blocks).cast("bigint"))


class SeenUrls:
    """A history of URL fingerprints below one path."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 64, first_blocks: int = 4096):
        self.spark, self.path, self.versions = spark, path, Versions(spark, path)
        fixed = self.versions.latest()[1]
        self.slots = fixed.get("slots", slots)
        self.buckets = fixed.get("buckets") or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.first_blocks = first_blocks

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(3), "url_hash"), F.lit(self.slots)).cast("int")

    def _filter(self, entry: dict) -> DataFrame:
        return read_bucketed(self.spark, f"{self.path}/{entry['name']}", FILTER, ["block"], self.buckets)

    def maybe_seen(self, rows: DataFrame, manifest: dict) -> DataFrame:
        """Rows with ``url_hash`` and ``_maybe``: false where every filter denies the URL."""
        for k, entry in enumerate(manifest.get("filters", [])):
            words = self._filter(entry).withColumnsRenamed({f"w{i}": f"_w{i}" for i in range(WORDS)})
            hit = reduce(lambda a, b: a & b, [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(masks())])
            asked = rows.withColumn("block", block_of(entry["blocks"])).join(words, "block", "left")
            rows = asked.withColumn(f"_in{k}", F.coalesce(hit, F.lit(False))).drop("block", *[f"_w{i}" for i in range(WORDS)])
        flags = [F.col(f"_in{k}") for k in range(len(manifest.get("filters", [])))]
        return rows.withColumn("_maybe", reduce(lambda a, b: a | b, flags, F.lit(False))).drop(*[f"_in{k}" for k in range(len(flags))])

    def hashes(self, manifest: dict, slots: set[int] | None = None) -> DataFrame:
        """Stored fingerprints, of some slots or all."""
        paths = [
            f"{self.path}/{c['name']}/slot={s}" for c in manifest.get("commits", []) for s in c["slots"] if slots is None or s in slots
        ]
        empty = self.spark.createDataFrame([], "url_hash string")
        return self.spark.read.schema("url_hash string").parquet(*paths) if paths else empty

    def admit(self, batch: DataFrame, url: str, order: list[str]) -> DataFrame:
        """The batch rows whose URL is new to the history and first in the batch; they are part of it from then on."""
        part = uuid.uuid4().hex[:12]
        number, manifest = self.versions.latest()
        asked = f"{self.path}/asked-{part}"
        flagged = self.maybe_seen(dedup_url(batch, url, order), manifest)
        flagged.write.parquet(asked)
        rows = self.spark.read.schema(flagged.schema).parquet(asked)
        maybe = rows.where("_maybe")
        touched = {r["s"] for r in maybe.select(self._slot().alias("s")).distinct().collect()}  # as many as slots
        known = maybe.join(self.hashes(manifest, touched), "url_hash", "left_anti") if touched else maybe
        fresh, name = rows.where("not _maybe").unionByName(known).drop("_maybe"), f"new-{part}"
        fresh.write.parquet(f"{self.path}/rows-{part}")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/rows-{part}")
        new = fresh.select("url_hash")
        counts = {r["slot"]: r["count"] for r in new.groupBy(self._slot().alias("slot")).count().collect()}
        if counts:
            new.withColumn("slot", self._slot()).repartition("slot").write.partitionBy("slot").parquet(f"{self.path}/{name}")
            filters = self._taken_in(manifest.get("filters", []), new, sum(counts.values()))
            commits = [*manifest.get("commits", []), {"name": name, "slots": sorted(counts)}]
            self.versions.commit(number, {"slots": self.slots, "buckets": self.buckets, "filters": filters, "commits": commits})
        remove(self.spark, asked)
        return fresh

    def _taken_in(self, filters: list[dict], new: DataFrame, n: int) -> list[dict]:
        """The filters after new URLs: ORed into the youngest, or into a larger one if that is full."""
        young = filters[-1] if filters else None
        if young is None or young["urls"] + n > young["blocks"] * URLS_PER_BLOCK:
            blocks = max(self.first_blocks, 2 * young["blocks"] if young else 0, -(-n // URLS_PER_BLOCK))
            filters, young = [*filters, None], {"blocks": blocks, "urls": 0}
        bits = new.select(block_of(young["blocks"]).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks())])
        both = bits.unionByName(self._filter(young)) if young["urls"] else bits
        name = f"filter-{uuid.uuid4().hex[:12]}"
        words = both.repartition(self.buckets, "block").groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        write_bucketed(words, f"{self.path}/{name}", ["block"], self.buckets)
        return [*filters[:-1], {"name": name, "blocks": young["blocks"], "urls": young["urls"] + n}]
