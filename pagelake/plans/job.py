"""A configured job as one lazy plan: pages, items, details, cleaning, dedup, store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import jsonpath, urls
from pagelake.functions.hashing import contract_signature
from pagelake.operators import dedup, enrich, extract, jsonitems, paging, profile, robots, rules
from pagelake.plans.config import JobConfig
from pagelake.session import cut, ship
from pagelake.sources import checkpoint as checkpoints
from pagelake.sources.store import append_new

ORDER = ["page_no", "item_idx"]
# What a next button is where the job does not say, and the fields that tell pages apart.
NEXT_SELECTOR = "li.ant-pagination-next"
FIRST_ITEM = ("排名", "标题")
ITEMS = "array<map<string,string>>"


def page_items(pages: DataFrame, cfg: JobConfig) -> DataFrame:
    """Items of fetched pages ``(page_no, url, html)``: from JSON where a page is JSON, else HTML.

    Challenge pages are left out before any page reaches a Python task.
    """
    fields = cfg.api.get("fields") or {}
    usable = pages.filter((F.length("html") > 0) & ~profile.is_challenge("html"))
    if not fields:
        return extract.extract_items(usable, cfg.item_selector, cfg.fields, ["page_no", "url"])
    json_page = jsonpath.is_json("html")
    from_json = jsonitems.json_items(
        usable, fields, cfg.api.get("item_path", ""), "html", ["page_no", "url"]
    )
    if not cfg.fields:
        return from_json
    from_html = extract.extract_items(usable.filter(~json_page), cfg.item_selector, cfg.fields, ["page_no", "url"])
    return from_json.unionByName(from_html, allowMissingColumns=True)


def captured_items(responses: DataFrame, cfg: JobConfig) -> DataFrame:
    """Items of captured responses ``(page_no, url, body)``, numbered over all responses of a page.

    Responses count in the order of a column ``seq``, if there is one, then of their URLs and bodies.
    """
    order = [c for c in ("seq",) if c in responses.columns] + ["url", "body"]
    marked = responses.select("page_no", "url", F.struct(*order).alias("_at"), F.try_parse_json("body").alias("_v"))
    rows = jsonitems.json_records(
        marked, "_v", cfg.api.get("fields") or {}, cfg.api.get("item_path", ""), ["page_no", "url", "_at"], objects_only=True
    )
    place = F.row_number().over(W.partitionBy("page_no").orderBy("_at", "item_idx")) - 1
    return rows.withColumn("item_idx", place.cast(rows.schema["item_idx"].dataType)).drop("_at")


def _checkpointed(items: DataFrame, checkpoint: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of already finished pages, in the shape of freshly read ones."""
    old = checkpoint.select("page_no", F.posexplode("items").alias("item_idx", "_m")).select(
        F.col("page_no").cast(items.schema["page_no"].dataType).alias("page_no"), "item_idx",
        *[F.coalesce(F.try_element_at("_m", F.lit(c)), F.lit("")).alias(c) for c in columns],
    )
    return items.unionByName(old, allowMissingColumns=True)


def page_report(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Status and item count of every page for the task ledger."""
    counts = items.groupBy("page_no").agg(F.count("*").alias("item_count"))
    n = F.coalesce("item_count", F.lit(0))
    empty = F.coalesce(F.length("html"), F.lit(0)) == 0
    return pages.join(counts, "page_no", "left").select(
        "page_no",
        F.when(empty, "failed").when(n > 0, "completed").otherwise("empty").alias("status"),
        n.alias("item_count"),
    )


def run_job(
    pages: DataFrame,
    config: Mapping[str, Any] | JobConfig,
    details: DataFrame | None = None,
    responses: DataFrame | None = None,
    checkpoint: DataFrame | None = None,
    robots_rules: DataFrame | None = None,
    transforms: tuple[Callable[[DataFrame], DataFrame], ...] = (),
) -> DataFrame:
    """Item rows ``(page_no, item_idx, url, fields…)`` of a job over its fetched pages.

    ``details(url, html)`` are the pages that rows link to, ``responses`` captured JSON,
    ``checkpoint(page_no, items)`` the pages done before. The order of steps is fixed:
    pages, stop, details, postprocess, dedup. Pages already done and pages robots rules
    forbid are dropped before extraction. What pages count follows from ``pagination.type``:
    ``url_pattern`` takes the planned numbers, ``next_button`` follows next links from
    ``first_url`` and numbers pages as it meets them, ``infinite_scroll`` takes pages as snapshots
    and keeps what each adds, ``none`` takes all pages given. Where a step needs the items twice (a
    walk, a serial stop, a detail limit) they are read once into a reliable checkpoint; otherwise
    nothing runs until the result is used.
    """
    ship(pages.sparkSession)
    cfg = config if isinstance(config, JobConfig) else JobConfig.of(config)
    plan = cfg.pagination
    if plan["type"] == "url_pattern":
        pages = pages.filter(F.col("page_no").between(plan["start_page"], plan["start_page"] + plan["max_pages"] - 1))
    agent = cfg.user_agent or cfg.headers.get("User-Agent") or "*"
    if cfg.respect_robots and robots_rules is not None:
        pages = robots.robots_allowed(pages, robots_rules, agent, key="page_no").filter("allowed").drop("allowed")
    resuming = cfg.resume and checkpoint is not None
    todo = pages.join(checkpoint.select("page_no").distinct(), "page_no", "left_anti") if resuming else pages

    items = page_items(todo, cfg)
    if plan["type"] == "next_button":
        items = _walked(todo, cut(items), cfg)
    elif plan["type"] == "infinite_scroll":
        items = _scrolled(cut(items), plan["max_scrolls"])
    if responses is not None and cfg.api.get("fields"):
        items = jsonitems.prefer_api(captured_items(responses, cfg), items, "page_no")
    columns = [c for c in items.columns if c not in (*ORDER, "url")]
    if resuming:
        items = _checkpointed(items, checkpoint, columns)
    if cfg.serial or (details is not None and cfg.detail.get("limit")):
        items = cut(items)
    if cfg.serial:
        items = _before_stop(pages, items, plan["start_page"], plan["max_pages"])

    if details is not None and cfg.detail.get("link_field") in items.columns:
        items = _with_details(items, details, cfg, robots_rules, agent)
    if cfg.postprocess:
        items = rules.postprocess(items, cfg.postprocess)
    for transform in transforms:
        items = items.transform(transform)
    if cfg.dedup.get("key") in items.columns:
        items = dedup.dedup_safe(items, cfg.dedup["key"], ORDER)
    return items


def _first_item(items: DataFrame) -> Column:
    """What tells a page from the one before: the title-like field of its first item, else its first field."""
    columns = [c for c in items.columns if c not in (*ORDER, "url")]
    named = [c for c in FIRST_ITEM if c in columns] or columns[:1]
    return F.col(f"`{named[0]}`").cast("string") if named else F.lit(None).cast("string")


def _walked(pages: DataFrame, items: DataFrame, cfg: JobConfig) -> DataFrame:
    """Items of the pages that next links lead to from ``first_url``; the page number is the place in the walk."""
    plan = cfg.pagination
    button = plan.get("next_selector") or NEXT_SELECTOR
    inside = ", ".join(f"{part.strip()} a" for part in button.split(","))
    links = extract.extract_boxes(
        pages, extract.PAGE,
        {
            "_own": extract.Field(button, "attr", "href"), "_inside": extract.Field(inside, "attr", "href"),
            "_class": extract.Field(button, "attr", "class"), "_aria": extract.Field(button, "attr", "aria-disabled"),
        },
        ["url"],
    )
    href = F.coalesce(F.nullif("_own", F.lit("")), F.nullif("_inside", F.lit("")))
    marks = F.lower(F.concat_ws(" ", "_class", "_aria"))
    firsts = items.groupBy("url").agg(F.min_by(_first_item(items), F.struct(*ORDER)).alias("first_item"))
    shown = links.select(
        "url", urls.resolve_link("url", href).alias("next_url"), marks.contains(plan.get("disabled_marker") or "disabled").alias("disabled")
    ).join(firsts, "url", "left")
    seeds = pages.sparkSession.createDataFrame([(cfg.first_url,)], "url string")
    walk = paging.next_walk(shown, seeds, plan["max_pages"]).select("url", F.col("pos").cast(items.schema["page_no"].dataType).alias("_pos"))
    return items.join(walk, "url").withColumn("page_no", F.col("_pos")).select(*items.columns)


def _scrolled(items: DataFrame, max_scrolls: int) -> DataFrame:
    """Items at their first appearance over the snapshots, until three snapshots in a row add nothing."""
    columns = [c for c in items.columns if c not in (*ORDER, "url")]
    marked = items.select(F.lit(1).alias("_job"), *ORDER, dedup.item_fingerprint(columns).alias("_fp"))
    new = paging.scroll_accumulate(marked, "_job", "page_no", "item_idx", "_fp", max_scrolls)
    return items.join(new.select(*ORDER), ORDER, "left_semi")


def _before_stop(pages: DataFrame, items: DataFrame, start: int, max_pages: int) -> DataFrame:
    """Items before the first page number of the plan that has none."""
    spark = items.sparkSession
    have = items.select("page_no").distinct()
    planned = spark.range(start, start + max_pages).select(
        F.col("id").cast(items.schema["page_no"].dataType).alias("page_no")
    )
    stop = planned.join(have, "page_no", "left_anti").agg(F.min("page_no").alias("_stop"))
    # One row, so sending it to every task costs nothing.
    return (
        items.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop")))
        .drop("_stop")
    )


def _with_details(items: DataFrame, details: DataFrame, cfg: JobConfig, robots_rules, agent: str) -> DataFrame:
    fields = cfg.detail.get("fields") or {}
    usable = details.filter((F.length("html") > 0) & ~profile.is_challenge("html"))
    if cfg.respect_robots and robots_rules is not None:
        usable = robots.robots_allowed(usable, robots_rules, agent, key="url").filter("allowed").drop("allowed")
    read = extract.extract_boxes(usable, extract.PAGE, fields, ["url"]).drop("item_idx")
    base = F.lit(cfg.first_url or cfg.pagination.get("url_pattern", ""))
    link = cfg.detail["link_field"]
    return enrich.detail_backfill(
        items, read, link, list(fields), ORDER, int(cfg.detail.get("limit") or 0), urls.resolve_link(base, link)
    )


def complete_job(pages: DataFrame, config: Mapping[str, Any], root: str, **inputs: Any) -> int:
    """Run a job, keep its pages in a checkpoint, append its rows to its table; returns how many were new.

    The checkpoint below ``root`` belongs to the job's contract. With ``resume`` its pages are not
    read again; it is dropped once the rows are stored, so that what failed before goes on and what succeeded
    starts afresh.
    """
    spark, cfg = pages.sparkSession, JobConfig.of(config)
    place, sig = f"{root}/checkpoints", contract_signature(config, config.get("_checkpoint_scope"))
    done = checkpoints.load(spark, place, sig) if cfg.resume else None
    todo = pages if done is None else pages.join(done.select("page_no"), "page_no", "left_anti")
    if cfg.pagination["type"] in ("url_pattern", "none"):
        read = page_items(todo, cfg)
        names = [c for c in read.columns if c not in (*ORDER, "url")]
        entry = F.array(*[F.struct(F.lit(c).alias("k"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in names])
        in_order = F.array_sort(F.collect_list(F.struct("item_idx", entry.alias("m"))))
        checkpoints.save(read.groupBy("page_no").agg(F.transform(in_order, lambda x: F.map_from_entries(x["m"])).alias("items")), place, sig)
        inputs["checkpoint"] = checkpoints.load(spark, place, sig)
        config = {**config, "resume": True}
    n = store_result(run_job(pages, config, **inputs), cfg, f"{root}/items")
    checkpoints.clear(spark, place, sig)
    return n


def store_result(items: DataFrame, cfg: JobConfig, path: str) -> int:
    """Append the rows a table does not have yet; returns how many."""
    return append_new(items.sparkSession, items.drop(*ORDER, "url"), path)
