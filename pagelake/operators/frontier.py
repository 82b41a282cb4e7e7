"""The URL frontier as a table: ``(url, url_hash, site, priority, depth, meta, created_at, state)``.

``state`` is ``queued`` or ``processing``; a completed task is no longer in the table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.urls import url_fingerprint
from pagelake.operators.dedup import admit_new, first_per_key

STUCK_AFTER = 300


def task_json() -> Column:
    """A task as text; equal priorities are popped from the largest text down."""
    return F.to_json(F.struct("url", "site", "priority", "depth", "meta", "created_at"))


def admit(batch: DataFrame, history: DataFrame, order: list[str], run_ts: float) -> DataFrame:
    """New tasks of a batch, queued; missing attributes get their defaults."""
    defaults = {
        "site": F.lit("default"),
        "priority": F.lit(0),
        "depth": F.lit(0),
        "meta": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        "created_at": F.lit(float(run_ts)),
    }
    for name, value in defaults.items():
        batch = batch.withColumn(name, F.coalesce(F.col(name), value) if name in batch.columns else value)
    return admit_new(batch, history, "url", order).withColumn("state", F.lit("queued"))


def next_tasks(frontier: DataFrame, mode: str = "fifo", n: int = 1, by: str = "site") -> DataFrame:
    """The next ``n`` tasks of each site: oldest, newest, or highest priority first."""
    orders = {
        "fifo": [F.col("created_at"), F.col("url_hash")],
        "lifo": [F.col("created_at").desc(), F.col("url_hash").desc()],
        "priority": [F.col("priority").desc(), task_json().desc()],
    }
    if mode not in orders:
        raise ValueError(f"unknown queue mode {mode!r}")
    return first_per_key(frontier.filter("state = 'queued'"), [by], orders[mode], n)


def apply_events(frontier: DataFrame, events: DataFrame) -> DataFrame:
    """Apply task outcomes to the frontier.

    ``events(url_hash, event, seq)`` with event ``pop`` (queued to processing), ``complete``
    (gone), ``fail`` (queued again, priority one lower but not below 0) or ``drop`` (failed
    for good, gone). The last outcome of a task since its last pop decides.
    """
    last = events.groupBy("url_hash").agg(
        F.max_by("event", "seq").alias("_event"),
        F.count_if(F.col("event") == "fail").cast("int").alias("_fails"),
    )
    joined = frontier.join(last, "url_hash", "left").filter(
        "_event is null or _event not in ('complete', 'drop')"
    )
    lowered = F.greatest(F.col("priority") - F.coalesce("_fails", F.lit(0)), F.lit(0))
    return joined.withColumns(
        {
            "priority": F.when(F.col("_fails") > 0, lowered).otherwise(F.col("priority")),
            "state": F.when(F.col("_event") == "pop", "processing")
            .when(F.col("_event") == "fail", "queued")
            .otherwise(F.col("state")),
        }
    ).drop("_event", "_fails")


def recover_stuck(frontier: DataFrame, now: float, timeout: int = STUCK_AFTER) -> DataFrame:
    """Processing tasks older than ``timeout`` seconds are queued again.

    The age counts from ``created_at``; a processing task without one is dropped.
    """
    busy = F.col("state") == "processing"
    stuck = busy & (F.lit(float(now)) - F.col("created_at") > timeout)
    return frontier.filter(~busy | F.col("created_at").isNotNull()).withColumns(
        {"recovered": F.coalesce(stuck, F.lit(False)), "state": F.when(stuck, "queued").otherwise(F.col("state"))}
    )


def sizes(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("site", "state").agg(F.count("*").alias("n"))


def clear(frontier: DataFrame, sites: Iterable[str]) -> DataFrame:
    """Forget a site: its queue, its tasks in work and, with the same call, its seen set."""
    return frontier.filter(~F.coalesce(F.col("site").isin(*sites), F.lit(False)))


def with_hash(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("url_hash", url_fingerprint("url"))
