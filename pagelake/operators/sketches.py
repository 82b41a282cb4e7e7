"""Distinct counts from HyperLogLog sketches that are kept per day and united on demand.

A sketch has a fixed size whatever it has seen, so a count over any span of days reads one row a
day and key.  Uniting is idempotent: a day that is sketched twice is counted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.versions import Versions

LG_K = 14


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error that an estimate keeps within so many standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def sketched(rows: DataFrame, item: str, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """``keys`` and ``sketch``: one sketch of the items per key (say site and day); null items do not count.

    Map tasks send one sketch a key, however many rows it has.
    """
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(F.col(item).cast("string"), lg_k).alias("sketch"))


def united(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of fewer keys (say site alone), as if all rows had been sketched together."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: Column | str = "sketch") -> Column:
    """The number of distinct items a sketch has seen."""
    return F.hll_sketch_estimate(sketch)


def within(sketch: Column | str, exact: Column | str, lg_k: int = LG_K) -> Column:
    """Whether the estimate of a sketch is within its error bound of the exact count."""
    exact = F.col(exact) if isinstance(exact, str) else exact
    return F.abs(estimate(sketch) - exact) <= F.ceil(exact * error_bound(lg_k))


class SketchTable:
    """Sketches on shared files; every batch adds a small folder, ``read`` unites them by key.

    ``add`` with the id of a batch that is in the table already changes nothing, and would not
    change an estimate if it did.  ``compact`` folds all folders into one.
    """

    def __init__(self, spark: SparkSession, root: str, item: str, keys: Sequence[str], lg_k: int = LG_K):
        self.spark, self.root, self.item, self.keys, self.lg_k = spark, root, item, list(keys), lg_k
        self.versions = Versions(spark, root)

    def add(self, rows: DataFrame, batch: str) -> None:
        place = f"batch-{batch}"
        if batch in self.versions.latest()[1].get("batches", []):
            return
        sketched(rows, self.item, self.keys, self.lg_k).write.mode("overwrite").parquet(f"{self.root}/{place}")

        def make(_, now):
            if batch in now.get("batches", []):
                return None
            return {"batches": [*now.get("batches", []), batch], "folders": [*now.get("folders", []), place]}

        self.versions.change(make)

    def read(self) -> DataFrame:
        """(keys, sketch) of the latest version; fails where nothing was added yet."""
        number, now = self.versions.latest()
        if not number:
            raise ValueError(f"no sketches in {self.root}")
        return united(self.spark.read.parquet(*[f"{self.root}/{f}" for f in now["folders"]]), self.keys)

    def compact(self) -> None:
        number, now = self.versions.latest()
        if len(now.get("folders", [])) > 1:
            place = f"folded-{number}"
            self.read().write.mode("overwrite").parquet(f"{self.root}/{place}")
            self.versions.commit(number, {"batches": now["batches"], "folders": [place]})
