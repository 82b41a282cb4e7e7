"""Continuous intake of items or URLs: files, the rate source or Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                 max_files: int | None = None) -> DataFrame:
    """New files of a folder, in order of arrival; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema: str, per_batch: int = 1_000_000) -> DataFrame:
    """JSON messages of a topic (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_batch)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m"), "timestamp").select("m.*", "timestamp")
