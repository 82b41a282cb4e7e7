"""Lookups between item, link, author and detail tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as tx
from pagelake.functions.urls import url_fingerprint
from pagelake.operators.dedup import dedup_first


def _with_turn(items: DataFrame, has_link: Column, order: list[str], limit: int) -> DataFrame:
    """Mark the rows whose detail page is wanted: all with a link, or the first ``limit``."""
    if not limit:
        return items.withColumn("_wanted", has_link)
    # The top rows are found without sorting the table and are at most ``limit``.
    last = items.filter(has_link).select(*order).orderBy(*order).limit(limit)
    marked = last.distinct().withColumn("_top", F.lit(True))
    return items.join(marked, order, "left").withColumn(
        "_wanted", has_link & F.coalesce("_top", F.lit(False))
    ).drop("_top")


def detail_backfill(
    items: DataFrame,
    details: DataFrame,
    link: str,
    fields: Iterable[str],
    order: list[str],
    limit: int = 0,
    resolved: Column | None = None,
    detail_url: str = "url",
    usable: Column | None = None,
) -> DataFrame:
    """Add or overwrite ``fields`` from the detail page a row links to.

    ``details`` holds one row of fields per page; pages for which ``usable`` is false (a
    challenge, a refusal) change nothing, nor do rows beyond the first ``limit`` with a
    link. ``order`` must identify a row. Pages are matched by URL fingerprint.
    """
    fields = list(fields)
    has_link = F.coalesce(F.col(link) != "", F.lit(False))
    target = F.col(link) if resolved is None else resolved
    if usable is not None:
        details = details.filter(usable)
    found = details.select(
        url_fingerprint(detail_url).alias("_hash"), *[F.col(f).alias(f"_new_{f}") for f in fields]
    )
    found = dedup_first(found, ["_hash"], [f"_new_{f}" for f in fields]).withColumn("_found", F.lit(True))
    # Rows that look nothing up get keys of their own that no page has: null keys would all meet in one task.
    alone = F.concat(F.lit("-"), F.xxhash64(link, *order).cast("string"))
    keyed = _with_turn(items, has_link, order, limit).withColumn(
        "_hash", F.coalesce(F.when(F.col("_wanted"), url_fingerprint(target)), alone)
    )
    joined = keyed.join(found, "_hash", "left")
    hit = F.coalesce("_found", F.lit(False))
    for f in fields:
        old = F.col(f) if f in items.columns else F.lit(None).cast("string")
        joined = joined.withColumn(f, F.when(hit, F.col(f"_new_{f}")).otherwise(old))
    return joined.drop("_hash", "_found", "_wanted", *[f"_new_{f}" for f in fields])


AUTHOR_FIELDS = ("author_name", "author_birth_date", "author_birth_place", "author_description")


def author_enrich(quotes: DataFrame, authors: DataFrame, on: str = "author_url") -> DataFrame:
    """Every quote with its author's fields, stripped; '' where the page or field is missing."""
    authors = authors.select(on, *AUTHOR_FIELDS)
    return quotes.join(authors, on, "left").withColumns(
        {f: F.coalesce(tx.strip(f), F.lit("")) for f in AUTHOR_FIELDS}
    )


def follow_links(links: DataFrame, pages: DataFrame, dst: str = "dst", url: str = "url") -> DataFrame:
    """Links whose target was fetched, with that page (inner join on the fingerprint)."""
    target = pages.withColumn("url_hash", url_fingerprint(url)).withColumnRenamed(url, "target_url")
    return links.withColumn("url_hash", url_fingerprint(dst)).join(target, "url_hash")
