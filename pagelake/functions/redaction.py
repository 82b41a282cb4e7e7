"""Removal of credentials from headers, URLs and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import col

# Names whose values are secret, and the text put in their place.
SECRET_HEADERS = ("authorization", "cookie", "proxy-authorization", "x-api-key", "token")
SECRET_PARAMETERS = ("token", "key", "api_key", "access_token", "password", "secret", "sig")
MARK = "[REDACTED]"

_USERINFO = r"(://)[^/?#@\s]+@"
_PARAMETER = r"(?i)([?&](?:" + "|".join(SECRET_PARAMETERS) + r")=)[^&#\s]*"


def redact_headers(headers: Column | str) -> Column:
    """Secret headers get the mark, others stay; ``redacted`` tells whether any was."""
    headers = col(headers)
    secret = lambda k: F.lower(k).isin(*SECRET_HEADERS)
    return F.struct(
        F.transform_values(headers, lambda k, v: F.when(secret(k), F.lit(MARK)).otherwise(v)).alias("headers"),
        F.exists(F.map_keys(headers), secret).alias("redacted"),
    )


def redact_url(url: Column | str) -> Column:
    """User info and secret query values out of a URL, or out of any text holding URLs."""
    cleaned = F.regexp_replace(col(url), _USERINFO, "$1")
    return F.regexp_replace(cleaned, _PARAMETER, "$1")


def holds_secret(url: Column | str) -> Column:
    return redact_url(url) != col(url)


redact_text = redact_url
