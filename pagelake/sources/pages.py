"""Scans of fetched pages and of stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The full record of a fetch; a table may hold any part of it.
FETCHED_PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cookies", T.MapType(T.StringType(), T.StringType())),
        T.StructField("elapsed", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("proxy_used", T.StringType()),
    ]
)


def usable(pages: DataFrame, text: str = "text", status: str = "status_code") -> DataFrame:
    """Pages that may feed extraction: status 200 (where known) and some text."""
    keep = F.length(text) > 0
    if status in pages.columns:
        keep = (F.col(status) == 200) & keep
    return pages.filter(keep)


def fetch_ok(pages: DataFrame) -> DataFrame:
    """Fetches without an error and with a status from 200 to 399."""
    ok = (F.coalesce("error", F.lit("")) == "") & F.col("status_code").between(200, 399)
    return pages.filter(ok)


def read_pages(spark: SparkSession, path: str, text: str = "html") -> DataFrame:
    return usable(spark.read.parquet(path), text)


def query_site(
    table: DataFrame, site: str, limit: int = 100, offset: int = 0,
    status: str | None = None, newest: str = "id",
) -> DataFrame:
    """A page of a site's records, newest first; the filters reach the scan."""
    rows = table.filter(F.col("site_name") == site)
    if status:
        rows = rows.filter(F.col("status") == status)
    rows = rows.orderBy(F.desc(newest))
    return (rows.offset(offset) if offset else rows).limit(limit)


def pending_clean(raw: DataFrame, site: str, limit: int = 1000) -> DataFrame:
    return query_site(raw, site, limit, status="crawled")


def count_site(table: DataFrame, site: str, status: str | None = None) -> DataFrame:
    rows = table.filter(F.col("site_name") == site)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.agg(F.count("*").alias("n"))
