"""Alert rows from roll-ups, and their throttling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.throttle import throttle

# Default thresholds.
LOWEST_SUCCESS_RATE = 0.8
LARGEST_QUEUE = 10_000
THROTTLE_SECONDS = 300


def _alerts(df: DataFrame, kind: str, level: str, site, value, key) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), F.lit(level).alias("level"), site.alias("site"),
        value.cast("double").alias("value"), key.alias("dedup_key"),
    )


def low_success(rates: DataFrame, threshold: float = LOWEST_SUCCESS_RATE) -> DataFrame:
    site = F.col("site")
    return _alerts(
        rates.filter(F.col("rate") < threshold), "low_success", "critical",
        site, F.col("rate"), F.concat(F.lit("low_success_"), site),
    )


def proxy_exhausted(available: DataFrame) -> DataFrame:
    """``available(available)``: one row with the number of usable proxies."""
    return _alerts(
        available.filter("available = 0"), "proxy_exhausted", "critical",
        F.lit(None).cast("string"), F.col("available"), F.lit("proxy_exhausted"),
    )


def queue_backlog(sizes: DataFrame, threshold: int = LARGEST_QUEUE) -> DataFrame:
    site = F.col("site")
    return _alerts(
        sizes.filter(F.col("size") > threshold), "queue_backlog", "warning",
        site, F.col("size"), F.concat(F.lit("queue_backlog_"), site),
    )


__all__ = ["low_success", "proxy_exhausted", "queue_backlog", "throttle"]
