"""Pagination as table work: seeds, stops, next-link walks, scroll snapshots, resume."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import cut

SCROLL_PATIENCE = 3


def check_pattern(pattern: str) -> None:
    """Refuse a pattern that holds anything but page numbers."""
    holes = re.findall(r"\{([^{}]*)\}", pattern)
    if not holes or any(not re.fullmatch(r"page(:0?\d*d)?", h) for h in holes):
        raise ValueError(f"only {{page}} may stand in the pattern: {pattern!r}")


def page_urls(pattern: str):
    """``{page}`` or a padded ``{page:03d}`` as an expression over a ``page_no`` column."""
    check_pattern(pattern)
    parts, at = [], 0
    for m in re.finditer(r"\{page(?::(0?\d*)d)?\}", pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        number = F.col("page_no")
        parts.append(F.format_string(f"%{m.group(1)}d", number) if m.group(1) else number.cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def seed_pages(spark: SparkSession, pattern: str, start: int, max_pages: int) -> DataFrame:
    """``(page_no, url)`` for the planned pages of one job."""
    return spark.range(start, start + max_pages).select(
        F.col("id").cast("int").alias("page_no")
    ).withColumn("url", page_urls(pattern))


def seeds_of_jobs(jobs: DataFrame, pattern: str = "url_pattern") -> DataFrame:
    """The same for a table of jobs ``(…, url_pattern, start_page, max_pages)``."""
    start = F.col("start_page").cast("bigint")
    numbers = F.explode(F.sequence(start, start + F.col("max_pages") - 1))
    return jobs.withColumn("page_no", numbers).withColumn(
        "url", F.replace(F.col(pattern), F.lit("{page}"), F.col("page_no").cast("string"))
    )


def page_stop_serial(pages: DataFrame, job: list[str], n_items: str = "n_items", failed: str = "failed") -> DataFrame:
    """Pages before the first empty or failed one of their job.

    The stop is one small aggregate per job, joined back; no job is scanned in order.
    """
    ends = F.coalesce(F.col(failed), F.lit(False)) | (F.coalesce(F.col(n_items), F.lit(0)) == 0)
    stops = pages.groupBy(*job).agg(F.min(F.when(ends, F.col("page_no"))).alias("_stop"))
    return (
        pages.join(stops, job, "left")
        .filter(F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop")))
        .drop("_stop")
    )


def page_concurrent(items: DataFrame, order: tuple[str, ...] = ("page_no", "item_idx")) -> DataFrame:
    """All pages, none stops another, merged in page order."""
    return items.orderBy(*order)


def next_walk(pages: DataFrame, seeds: DataFrame, max_pages: int) -> DataFrame:
    """Follow next links from each seed: ``(seed, url, pos)`` with pos from 1.

    ``pages(url, next_url, disabled, first_item)``; of several rows of a URL the least counts. A walk ends where
    there is no next link, it is disabled, the next page shows no or the same first
    item, a page comes again, or ``max_pages`` is reached.

    A walk of length n takes log2(n) joins, not n: round k joins the walks with the
    links that jump 2**k pages and adds only what is new. Lineage is cut by a reliable
    checkpoint each round; the pages, which every round needs, are read once.
    """
    shown = pages.groupBy("url").agg(F.min(F.struct("next_url", "disabled", "first_item")).alias("p"))
    pages = cut(shown.select("url", "p.next_url", "p.disabled", "p.first_item"))
    here = pages.filter(~F.coalesce("disabled", F.lit(False)) & F.col("next_url").isNotNull()).select(
        F.col("url").alias("src"), F.col("next_url").alias("dst"),
        F.coalesce("first_item", F.lit("?")).alias("old"),
    )
    there = pages.select(F.col("url").alias("dst"), F.col("first_item").alias("new"))
    changed = (F.coalesce("new", F.lit("")) != "") & (F.col("new") != F.col("old"))
    jump = cut(here.join(there, "dst").filter(changed).select("src", "dst"))

    walks = seeds.select(F.col("url").alias("seed"), "url").distinct().withColumn("pos", F.lit(0))
    walks = cut(walks.join(pages.select("url"), "url", "left_semi").select("seed", "url", "pos"))
    step = 1
    while step < max_pages:
        further = cut(
            walks.join(jump, walks["url"] == jump["src"])
            .select("seed", F.col("dst").alias("url"), (F.col("pos") + step).alias("pos"))
            .filter(F.col("pos") < max_pages)
        )
        if further.isEmpty():
            break
        walks = walks.unionByName(further)
        step *= 2
        if step < max_pages:
            ahead = jump.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
            jump = cut(jump.join(ahead, jump["dst"] == ahead["mid"]).select("src", F.col("far").alias("dst")))
    # A page that comes again begins a circle; only its first visit counts.
    return walks.groupBy("seed", "url").agg((F.min("pos") + 1).alias("pos"))


def scroll_accumulate(
    items: DataFrame, session: str, snapshot: str, order: str, fingerprint: str, max_scrolls: int = 50
) -> DataFrame:
    """Items as they first appear over scroll snapshots, up to three without anything new.

    The series that is looked at in order has one row per snapshot of a session, at most
    ``max_scrolls``; the items themselves are only aggregated and joined.
    """
    seen = (
        items.filter(F.col(snapshot).between(1, max_scrolls))
        .groupBy(session, fingerprint)
        .agg(F.min(F.struct(snapshot, order)).alias("_first"))
        .select(session, fingerprint, F.col("_first")[snapshot].alias(snapshot), F.col("_first")[order].alias(order))
    )
    grown = seen.select(session, snapshot).distinct()
    gap = F.col(snapshot) - F.lag(snapshot, 1, 0).over(W.partitionBy(session).orderBy(snapshot))
    stops = (
        grown.withColumn("_gap", gap)
        .filter(F.col("_gap") > SCROLL_PATIENCE)
        .groupBy(session)
        .agg(F.min(snapshot).alias("_stop"))
    )
    return (
        seen.join(stops, session, "left")
        .filter(F.col("_stop").isNull() | (F.col(snapshot) < F.col("_stop")))
        .drop("_stop")
    )


def resume_plan(planned: DataFrame, checkpoint: DataFrame, on: tuple[str, ...] = ("sig", "page_no")) -> DataFrame:
    """Planned pages with ``action``: reuse what the checkpoint holds, fetch the rest."""
    done = checkpoint.select(*on).distinct().withColumn("_done", F.lit(True))
    return planned.join(done, list(on), "left").withColumn(
        "action", F.when(F.col("_done"), "reuse").otherwise("fetch")
    ).drop("_done")
