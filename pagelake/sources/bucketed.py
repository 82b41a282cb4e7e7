"""Parquet folders laid out in hash buckets, so that a join on the keys moves the other side only."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write rows in buckets of the keys, sorted by them.

    Rows should come dealt out by the keys (from a grouping or a join on them, or by
    ``repartition(buckets, *keys)``); else every task writes a file for every bucket.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"drop table {name}")


def read_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """The rows of such a folder. The table that tells Spark of the buckets is gone again at once, its files stay."""
    name, by = f"bucketed_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"create table {name} ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    rows = spark.table(name)
    spark.sql(f"drop table {name}")
    return rows


def read_bucketed_parts(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int, part: str) -> DataFrame:
    """The rows of the bucketed folders ``part=…`` below a path as one table with that column.

    Spark looks up partitions when it plans a query, so this table stays in the catalog, one for every path.
    """
    name, by = f"bucketed_{hashlib.md5(path.encode()).hexdigest()}", ", ".join(keys)
    spark.sql(
        f"create table if not exists {name} ({schema}, {part} string) using parquet partitioned by ({part})"
        f" clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'"
    )
    spark.sql(f"alter table {name} recover partitions")
    return spark.table(name)
