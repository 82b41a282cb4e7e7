"""Proxy statistics over a table of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators import ordered
from pagelake.operators.dedup import first_per_key

# Failures in a row that end a proxy; headers that give a proxy away.
MAX_FAIL = 3
PROXY_HEADERS = ("Via", "X-Forwarded-For", "X-Proxy-ID", "Forwarded")


def evicted(checks: DataFrame, rows: int = ordered.ROWS, proxy: str = "proxy", at: str = "t", tie: str = "id",
            ok: str = "ok", max_fail: int = MAX_FAIL) -> DataFrame:
    """``(proxy, evicted_at)``: when a proxy first failed ``max_fail`` times in a row.

    The number of successes so far names a run of failures. Of each run only the first
    ``max_fail`` failures go on, so a proxy that fails all day costs no more than others.
    """
    runs = ordered.running(
        checks, [proxy], [at, tie], rows, sums={"_run": F.when(F.col(ok), 1).otherwise(0)}
    )
    fails = first_per_key(runs.filter(~F.col(ok)).select(proxy, "_run", at, tie), [proxy, "_run"], [at, tie], max_fail)
    return (
        fails.groupBy(proxy, "_run")
        .agg(F.count("*").alias("_n"), F.max(at).alias("_at"))
        .filter(F.col("_n") == max_fail)
        .groupBy(proxy)
        .agg(F.min("_at").alias("evicted_at"))
    )


def health(checks: DataFrame, proxy: str = "proxy", ok: str = "ok", elapsed: str = "elapsed") -> DataFrame:
    """Checks, share alive and mean speed of the good checks."""
    return checks.groupBy(proxy).agg(
        F.count("*").alias("checks"),
        F.avg(F.when(F.col(ok), 1.0).otherwise(0.0)).alias("alive_share"),
        F.avg(F.when(F.col(ok), F.col(elapsed))).alias("avg_speed"),
    )


def anonymity(headers: Column | str, error: Column | str | None = None) -> Column:
    """anonymous if any proxy header is shown, elite if none, unknown after an error."""
    headers = F.col(headers) if isinstance(headers, str) else headers
    error = F.lit(None) if error is None else F.col(error) if isinstance(error, str) else error
    shown = F.exists(F.map_keys(headers), lambda k: k.isin(*PROXY_HEADERS))
    return (
        F.when(error.isNotNull() | headers.isNull(), "unknown").when(shown, "anonymous").otherwise("elite")
    )
