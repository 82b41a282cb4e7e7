"""Task, page and log ledgers: ``tasks``, ``task_pages``, ``task_logs``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators import ordered
from pagelake.operators.dedup import first_per_key, latest_wins

# Task and page states.
ACTIVE = ("pending", "running", "cancelling")
TERMINAL = ("completed", "partial", "failed", "cancelled", "interrupted")
RETRYABLE = ("partial", "failed", "cancelled", "interrupted")
PAGE_DONE = ("completed", "empty", "reused")
LEDGER_SIZE = 50
LOG_TAIL = 1000
PREVIEW_ROWS = 200
UPDATABLE = ("status", "started_at", "ended_at", "item_count", "error", "file_path", "sqlite_path")


def page_stats(pages: DataFrame, task: str = "task_id") -> DataFrame:
    return pages.groupBy(task).agg(
        F.count("*").alias("total_pages"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        F.count_if(F.col("status").isin(*PAGE_DONE)).alias("done_pages"),
    )


def final_status(cancelled: Column, failed_pages: Column, n_rows: Column) -> Column:
    failed = F.coalesce(failed_pages, F.lit(0)) > 0
    return (
        F.when(F.coalesce(cancelled, F.lit(False)), "cancelled")
        .when(failed & (F.coalesce(n_rows, F.lit(0)) == 0), "failed")
        .when(failed, "partial")
        .otherwise("completed")
    )


def task_status(pages: DataFrame, cancelled: DataFrame | None = None, task: str = "task_id") -> DataFrame:
    """How each task ended, from its page rows and the set of cancelled tasks."""
    totals = pages.groupBy(task).agg(
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("item_count"),
    )
    if cancelled is None:
        totals = totals.withColumn("_cancelled", F.lit(False))
    else:
        marked = cancelled.select(task).distinct().withColumn("_cancelled", F.lit(True))
        totals = totals.join(marked, task, "left")
    status = final_status(F.col("_cancelled"), F.col("failed_pages"), F.col("item_count"))
    return totals.withColumn("status", status).drop("_cancelled")


def task_flags(tasks: DataFrame) -> DataFrame:
    """Terminal, cancellable and retryable flags and the kind of retry."""
    config = F.try_parse_json("config_json")
    kind = F.try_variant_get(config, "$.pagination.type", "string")
    redacted = F.coalesce(F.col("has_redacted_secrets"), F.lit(False))
    return tasks.withColumns(
        {
            "terminal": F.col("status").isin(*TERMINAL),
            "can_cancel": F.col("status").isin(*ACTIVE),
            "can_retry": F.col("status").isin(*RETRYABLE) & ~redacted,
            "retry_action": F.when(kind == "url_pattern", "resume_pages").otherwise("rerun"),
        }
    )


def task_summary(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """The listing of tasks: row, flags and page counts (0 where there are no pages)."""
    stats = page_stats(pages)
    joined = task_flags(tasks).join(stats, "task_id", "left")
    return joined.fillna(0, ["total_pages", "failed_pages", "done_pages"])


def tasks_recent(tasks: DataFrame, n: int = 50) -> DataFrame:
    return tasks.orderBy(F.desc("created_at"), "task_id").limit(n)


def log_tail(logs: DataFrame, n: int = LOG_TAIL, log_id: str = "id") -> DataFrame:
    """The last ``n`` log rows, oldest first."""
    return logs.orderBy(F.desc(log_id)).limit(n).orderBy(log_id)


def log_tail_per_task(logs: DataFrame, n: int = LOG_TAIL, log_id: str = "id") -> DataFrame:
    return first_per_key(logs, ["task_id"], [F.desc(log_id)], n)


def preview(rows: DataFrame, order: list, n: int = PREVIEW_ROWS) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def evict_terminal(tasks: DataFrame, keep: int = LEDGER_SIZE) -> DataFrame:
    """What stays of the ledger: of all rows beyond ``keep``, the oldest terminal ones go."""
    excess = max(0, tasks.count() - keep)
    if not excess:
        return tasks
    terminal = tasks.filter(F.col("status").isin(*TERMINAL)).select("task_id", "created_at")
    oldest = ordered.number_rows(terminal, ["created_at", "task_id"], "_no").filter(F.col("_no") <= excess)
    return tasks.join(oldest.select("task_id"), "task_id", "left_anti")


def restart_sweep(tasks: DataFrame, pages: DataFrame, now: float, error: str) -> tuple[DataFrame, DataFrame]:
    """After a restart: open tasks and their running pages become interrupted."""
    was_open = F.col("status").isin(*ACTIVE)
    swept = tasks.withColumns(
        {
            "ended_at": F.when(was_open, F.lit(float(now))).otherwise(F.col("ended_at")),
            "error": F.when(was_open, F.coalesce("error", F.lit(error))).otherwise(F.col("error")),
            "status": F.when(was_open, "interrupted").otherwise(F.col("status")),
        }
    )
    marked = swept.filter("status = 'interrupted'").select("task_id").distinct().withColumn("_cut", F.lit(True))
    cut_off = (F.col("status") == "running") & F.coalesce("_cut", F.lit(False))
    swept_pages = (
        pages.join(marked, "task_id", "left")
        .withColumns(
            {
                "updated_at": F.when(cut_off, F.lit(float(now))).otherwise(F.col("updated_at")),
                "status": F.when(cut_off, "interrupted").otherwise(F.col("status")),
            }
        )
        .drop("_cut")
    )
    return swept, swept_pages


def page_status_upsert(reports: DataFrame, version: list[str]) -> DataFrame:
    """The latest report per (task_id, page_no); an empty error is no error."""
    latest = latest_wins(reports, ["task_id", "page_no"], version)
    return latest.withColumn("error", F.nullif("error", F.lit("")))


def task_detail(tasks: DataFrame, pages: DataFrame, logs: DataFrame) -> DataFrame:
    """Pages and the latest logs of tasks in long form ``(task_id, task_status, part, seq, status, text)``.

    A row per page and per log line rather than arrays, so that no task's history has to
    fit into one row.
    """
    page_part = pages.select(
        "task_id", F.lit("page").alias("part"), F.col("page_no").cast("bigint").alias("seq"),
        "status", F.col("error").alias("text"),
    )
    log_part = log_tail_per_task(logs).select(
        "task_id", F.lit("log").alias("part"), F.col("id").cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("status"), "text",
    )
    head = tasks.select("task_id", F.col("status").alias("task_status"))
    return page_part.unionByName(log_part).join(head, "task_id")


def retry_plan(tasks: DataFrame, run_id: str) -> DataFrame:
    """New pending tasks for the failed ones: the same configuration, resuming.

    The id of a retry follows from the parent and the run, so a repeated plan is the same.
    """
    config = F.try_parse_json("config_json")
    scope = F.nullif(F.try_variant_get(config, "$._checkpoint_scope", "string"), F.lit(""))
    flags = task_flags(tasks).filter("can_retry")
    return flags.select(
        F.substring(F.sha1(F.concat_ws("/", F.lit(run_id), "task_id")), 1, 12).alias("task_id"),
        F.col("task_id").alias("parent_task_id"),
        F.lit("pending").alias("status"),
        F.lit(True).alias("resume"),
        F.coalesce(scope, F.col("task_id").cast("string")).alias("checkpoint_scope"),
        "retry_action",
        "config_json",
    )


def task_transitions(tasks: DataFrame, events: DataFrame, rows: int = ordered.ROWS) -> tuple[DataFrame, DataFrame]:
    """Apply ``events(task_id, event, status, seq)`` to tasks; returns (tasks, refused events).

    ``insert`` creates a pending task; ``update`` sets the status; ``cancel`` is refused unless the task is
    pending, running or cancelling at that moment, and makes it cancelling.
    """
    is_set = F.col("event").isin("insert", "update")
    value = F.when(F.col("event") == "insert", "pending").otherwise(F.col("status"))
    marked = events.withColumn("_set", F.when(is_set, F.struct("seq", value.alias("s"))))

    last = marked.groupBy("task_id").agg(
        F.max("_set").alias("_set"),
        F.max(F.when(F.col("event") == "cancel", F.col("seq"))).alias("_cancel"),
        F.max(F.col("event") == "insert").alias("_new"),
    )
    joined = tasks.join(last, "task_id", "full")
    base = F.coalesce(F.col("_set")["s"], F.col("status"))
    cancels = F.col("_cancel").isNotNull() & (
        F.col("_set").isNull() | (F.col("_cancel") > F.col("_set")["seq"])
    )
    status = F.when(cancels & base.isin(*ACTIVE), "cancelling").otherwise(base)
    known = F.col("status").isNotNull() | F.col("_new")
    after = joined.filter(known).withColumn("status", status).drop("_set", "_cancel", "_new")

    # A cancel is judged by the last status set before it; an accepted cancel stays active.
    seen = ordered.running(marked, ["task_id"], ["seq"], rows, maxima={"_before": F.col("_set")})
    start = tasks.select("task_id", F.col("status").alias("_start"))
    at = F.coalesce(F.col("_before")["s"], F.col("_start"))
    refused = (
        seen.filter("event = 'cancel'")
        .join(start, "task_id", "left")
        .filter(at.isNull() | ~at.isin(*ACTIVE))
        .select("task_id", "seq", at.alias("status_then"))
    )
    return after, refused


def update_task(tasks: DataFrame, updates: DataFrame, version: str) -> DataFrame:
    """Latest value of the columns that may be updated; other columns of updates are ignored.

    A null in an update means "not given".
    """
    columns = [c for c in UPDATABLE if c in updates.columns and c in tasks.columns]
    last = updates.groupBy("task_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(f"_u_{c}") for c in columns]
    )
    joined = tasks.join(last, "task_id", "left")
    return joined.withColumns(
        {c: F.coalesce(f"_u_{c}", c) for c in columns}
    ).drop(*[f"_u_{c}" for c in columns])


def clean_queue(tasks: DataFrame, events: DataFrame, version: list[str]) -> DataFrame:
    """The cleaning queue ``(raw_id, status, retry_count)`` after its events.

    The latest event gives the status, failed events count as retries, untouched rows
    are pending.
    """
    latest = latest_wins(events, ["raw_id"], version).select("raw_id", "status")
    retries = events.groupBy("raw_id").agg(F.count_if(F.col("status") == "failed").alias("retry_count"))
    return (
        tasks.select("raw_id")
        .join(latest, "raw_id", "left")
        .join(retries, "raw_id", "left")
        .select(
            "raw_id",
            F.coalesce("status", F.lit("pending")).alias("status"),
            F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        )
    )


def retry_giveup(attempts: DataFrame, url: str = "url", max_retries: int = 3) -> DataFrame:
    """Per URL the number of attempts and whether they exceed the limit."""
    return attempts.groupBy(url).agg(F.count("*").alias("attempts")).withColumn(
        "gave_up", F.col("attempts") > max_retries
    )
