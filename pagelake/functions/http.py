"""Retry classes and back-off as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import col

# Status codes worth another try, codes that never are, longest wait.
RETRY_STATUS = (500, 502, 503, 504, 408, 429, 407)
NEVER_RETRY_STATUS = (404, 403, 410)
LONGEST_WAIT = 30


def retry_class(status: Column | str) -> Column:
    status = col(status)
    return (
        F.when(status.isin(*NEVER_RETRY_STATUS), "never")
        .when(status.isin(*RETRY_STATUS), "retry")
        .otherwise("pass")
    )


def retry_delay(attempt: Column | str) -> Column:
    """``min(2**n, 30)`` seconds; the exponent is bounded so that no n overflows."""
    return F.least(F.pow(F.lit(2.0), F.least(col(attempt), F.lit(10))), F.lit(float(LONGEST_WAIT)))


def fetch_backoff(attempt: Column | str, base: float = 2.0, jitter_seed: int | None = None) -> Column:
    """``base * 2**attempt`` seconds, plus up to one second of seeded jitter if asked for."""
    wait = F.lit(base) * F.pow(F.lit(2.0), col(attempt))
    return wait if jitter_seed is None else wait + F.rand(jitter_seed)


def retry_plan(
    status: Column | str, retry_times: Column | str, max_retries: int = 3,
    dont_retry: Column | None = None,
) -> Column:
    """What to do with a response: as_is, retry after ``delay`` seconds, or give_up."""
    attempt = F.coalesce(col(retry_times), F.lit(0)) + 1
    skip = F.coalesce(dont_retry, F.lit(False)) if dont_retry is not None else F.lit(False)
    action = (
        F.when(skip | ~col(status).isin(*RETRY_STATUS), "as_is")
        .when(attempt > max_retries, "give_up")
        .otherwise("retry")
    )
    return F.struct(
        action.alias("action"),
        attempt.alias("attempt"),
        F.when(action == "retry", retry_delay(attempt)).alias("delay"),
    )
