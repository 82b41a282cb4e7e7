"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagelake.functions.urls import url_fingerprint
from pagelake.operators.metrics import LATENCY_BUCKETS
from pagelake.operators.rules import clean_site
from pagelake.sources.files import write_raw_jsonl
from pagelake.sources.store import TableStore
from pagelake.streaming import processors

SCRAPE_WINDOW = "15 seconds"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Spark unpickles a processor on the driver too, in a Python process that has none of the shipped files.
cloudpickle.register_pickle_by_value(processors)


def clean(stream: DataFrame, site_rules: Mapping[str, Iterable[Mapping[str, Any]]], site: str = "site") -> DataFrame:
    """The batch rules, unchanged: they are projections and filters only."""
    return clean_site(stream, site_rules, site)


def dedup(stream: DataFrame, url: str, at: str, delay: str) -> DataFrame:
    """The first arrival per URL within the watermark; state older than that is dropped."""
    return (
        stream.withColumn("url_hash", url_fingerprint(url))
        .withWatermark(at, delay)
        .dropDuplicatesWithinWatermark(["url_hash"])
    )


def windowed_metrics(stream: DataFrame, at: str, site: str, ok: Column, latency: str,
                     delay: str = "1 minute", window: str = SCRAPE_WINDOW) -> DataFrame:
    """Counts, rate and latency buckets per site and window; late rows beyond the delay are left out."""
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, window).alias("w"), site)
        .agg(
            F.count("*").alias("requests"),
            F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("rate"),
            F.sum(latency).alias("sum_latency"),
            *[F.count_if(F.col(latency) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in LATENCY_BUCKETS],
        )
        .select(F.col("w.start").alias("window_start"), site, "requests", "rate", "sum_latency",
                *[f"le_{str(b).replace('.', '_')}" for b in LATENCY_BUCKETS])
    )


def stateful(spark: SparkSession) -> None:
    """Let the session keep state in RocksDB, which the operators with timers need; a no-op where it does."""
    if not spark.conf.get(STATE_STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def throttle(stream: DataFrame, key: str, at: str, event_id: str, interval: int,
             time: str | None = None, delay: str = "1 minute", idle_ms: int | None = None) -> DataFrame:
    """Emit an alert if the last emitted one of its key is ``interval`` old; blank keys always pass.

    ``at`` is a whole number in the unit of ``interval``. Alerts of a key must arrive in order
    between micro-batches; within one they are sorted. The state of a key is one number. With
    ``time``, the timestamp that ``at`` gives in microseconds, the watermark drops it as soon as
    no alert can be held back by it (and alerts later than ``delay`` are left out). Without, it stays, or goes when
    the key has been silent for ``idle_ms`` of processing time; such a query never runs out of batches, so it is
    not for a trigger that stops when all is read.
    """
    lone = F.coalesce(F.trim(key), F.lit("")) == ""
    # Blank keys get a group of their own each, so they are never held back and never pile up.
    columns = [
        F.when(lone, F.concat(F.lit(processors.LONE), F.col(event_id).cast("string"))).otherwise(F.col(key)).alias("k"),
        F.col(at).cast("bigint").alias("t"), F.col(event_id).cast("bigint").alias("id"),
    ]
    stateful(stream.sparkSession)
    if time is None:
        keyed, mode = stream.select(*columns), "None" if idle_ms is None else "ProcessingTime"
    else:
        keyed, mode = stream.select(*columns, F.col(time).alias("_time")).withWatermark("_time", delay), "EventTime"
    return keyed.groupBy("k").transformWithStateInPandas(
        processors.Throttle(interval, time is not None, idle_ms), "k string, t bigint, id bigint", "Append", mode
    )


def stuck_tasks(stream: DataFrame, task: str, event: str, timeout_ms: int) -> DataFrame:
    """Tasks popped and not finished within the timeout, by a processing-time timer.

    ``event`` is ``pop``, ``complete`` or ``fail``. Emits each stuck task once.
    """
    stateful(stream.sparkSession)
    keyed = stream.select(F.col(task).alias("task"), (F.col(event) == "pop").alias("is_pop"), F.col("seq").cast("bigint").alias("at"))
    out = keyed.groupBy("task").transformWithStateInPandas(processors.Stuck(timeout_ms, False), "task string, at bigint", "Append", "ProcessingTime")
    return out.select("task")


def stuck_since(stream: DataFrame, task: str, event: str, at: str, timeout_ms: int, delay: str = "1 minute") -> DataFrame:
    """``(task, popped_at)`` of the pops after which the task did nothing for the timeout, by event time.

    A pop is reported by the next event of its task if that comes too late, else as soon as the watermark
    says that none can come in time; its state is gone then.
    """
    stateful(stream.sparkSession)
    keyed = stream.select(
        F.col(task).cast("string").alias("task"), (F.col(event) == "pop").alias("is_pop"), F.unix_millis(at).alias("at"), F.col(at).alias("_time")
    ).withWatermark("_time", delay)
    out = keyed.groupBy("task").transformWithStateInPandas(processors.Stuck(timeout_ms, True), "task string, at bigint", "Append", "EventTime")
    return out.select("task", F.timestamp_millis("at").alias("popped_at"))


def upsert_sink(stream: DataFrame, store: TableStore, version: str, run_ts: str, checkpoint: str) -> DataStreamWriter:
    """Upsert every micro-batch. The table's version names the stream's last batch, so one that
    is replayed after a failure is known and changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.save(batch, version, run_ts, source=checkpoint, batch_id=batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def archive_sink(stream: DataFrame, raw_path: str, store: TableStore, version: str, site: str, day: str,
                 run_ts: str, checkpoint: str) -> DataStreamWriter:
    """Two writes per micro-batch: the JSON-lines archive first, so raw data outlives a failing table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The folder is named by the batch, so a replay overwrites instead of adding twice.
        batch.withColumns({"site": F.col(site), "dt": F.lit(day)}).write.mode("overwrite").partitionBy(
            "site", "dt"
        ).json(f"{raw_path}/batch={batch_id}")
        store.save(batch, version, run_ts, source=checkpoint, batch_id=batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def log_sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append log rows with their day ``dt``, exactly once through the file sink's commit log."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("dt").outputMode("append")
    )


def drain(writer: DataStreamWriter) -> None:
    """Process what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def drain_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Drain into an in-memory table; for tests and small checks only."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    drain(writer)
    return stream.sparkSession.table(name)


def drain_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain an append stream into Parquet on shared storage and read it back."""
    drain(
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


Transform = Callable[[DataFrame], DataFrame]
__all__ = [
    "archive_sink", "clean", "dedup", "drain", "drain_to_files", "drain_to_table", "log_sink",
    "stuck_since", "stuck_tasks", "throttle", "upsert_sink", "windowed_metrics", "write_raw_jsonl",
]
