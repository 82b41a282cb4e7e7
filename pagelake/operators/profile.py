"""Page and host profiles: how a site is best collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as tx
from pagelake.functions.urls import host_key
from pagelake.operators.dedup import first_per_key
from pagelake.operators.extract import PAGE, Field, extract_boxes, select_counts

# Marks of challenge pages and of server-rendered data, and the limits.
CHALLENGE_MARKERS = (
    "challenge-platform", "cf-browser-verification", "__cf_chl_",
    "__jschl", "renderData", "just-a-moment", "验证码", "captcha",
    "waf-pass", "sec_verify", "JSESSIONID", "window._signature",
)
SSR_MARKERS = ("__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__", "window.__INITIAL_DATA__")
CHALLENGE_HEAD = 6000
TITLE_LENGTH = 120
MANY_SCRIPTS = 8
LITTLE_TEXT = 800
PAGE_LINK_SAMPLES = 4
CONTAINERS = {
    "article": "article",
    "div.item": "div[class*=item]",
    "div.product": "div[class*=product]",
    "li.list": "li[class*=list]",
    "table tr": "table tr",
    "div.card": "div[class*=card]",
}
CONTAINER_CANDIDATES = 4
NEXT_LINK = 'a[rel=next], a[class*=next]'
PAGE_LINK = 'a[href*="page="], a[href*="page/"], a[href*="?p="], a[href*="&p="]'
TITLE_LINK = "a[rel~=title], h3 a, .title a, .name"
PRICE = ".price, [class*=price], .Price"


def _quoted(words: tuple[str, ...]) -> str:
    return "|".join("\\Q" + w + "\\E" for w in words)


def is_challenge(html: Column | str, content_type: Column | None = None) -> Column:
    """Any mark in the head of a page; empty pages and JSON are none.

    The head is what the check is defined on, not a saving.
    """
    html = tx.col(html)
    head = F.lower(F.substring(html, 1, CHALLENGE_HEAD))
    found = head.rlike(_quoted(tuple(m.lower() for m in CHALLENGE_MARKERS)))
    if content_type is not None:
        found = found & ~F.coalesce(F.contains(F.lower(content_type), F.lit("json")), F.lit(False))
    return F.coalesce(found, F.lit(False))


def title(html: Column | str) -> Column:
    """Text of the first title element, at most 120 characters."""
    raw = F.regexp_extract(tx.col(html), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.substring(tx.strip(raw), 1, TITLE_LENGTH)


def body_text(html: Column | str) -> Column:
    """Body text without tags, scripts and styles included as the text they are."""
    body = F.regexp_replace(tx.col(html), r"(?is)^.*?<body[^>]*>", "")
    return tx.collapse(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"<[^>]*>", " "))


def signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """Script count, text length, server-rendered data and challenge, all native."""
    return pages.withColumns(
        {
            "script_count": F.regexp_count(html, F.lit(r"(?i)<script\b")),
            "text_len": F.length(body_text(html)),
            "has_ssr_json": F.coalesce(F.col(html).rlike(_quoted(SSR_MARKERS)), F.lit(False)),
            "challenge": is_challenge(html),
        }
    )


def render_choice(df: DataFrame) -> DataFrame:
    """How to fetch, from the columns of :func:`signals`."""
    dynamic = ~F.col("challenge") & (F.col("script_count") >= MANY_SCRIPTS) & (F.col("text_len") < LITTLE_TEXT)
    browser = F.col("challenge") | (dynamic & ~F.col("has_ssr_json"))
    return df.withColumns(
        {"js_dynamic": dynamic, "render": F.when(browser, "playwright").otherwise("direct")}
    )


def paging(pages: DataFrame) -> DataFrame:
    """Kind of pagination per page, with up to four sample links."""
    links = extract_boxes(
        pages,
        PAGE,
        {
            "_next": Field(NEXT_LINK, "attr_all", "href"),
            "_labels": Field("a", "all"),
            "_page": Field(PAGE_LINK, "attr_all", "href"),
        },
    ).drop("item_idx")
    labelled = F.exists("_labels", lambda t: F.contains(t, F.lit("下一页")) | F.contains(t, F.lit("Next")))
    has_next = (F.size("_next") > 0) | labelled
    return links.select(
        "page_id",
        "url",
        F.when(has_next, "next_button").when(F.size("_page") > 0, "url_pattern").otherwise("unknown").alias("pagination"),
        F.when(~has_next, F.slice("_page", 1, PAGE_LINK_SAMPLES)).alias("samples"),
    )


def container_counts(pages: DataFrame) -> DataFrame:
    return select_counts(pages, CONTAINERS)


def container_candidates(pages: DataFrame) -> DataFrame:
    """The four most frequent containers of each page with their selector."""
    selectors = F.create_map(*[F.lit(x) for pair in CONTAINERS.items() for x in pair])
    top = first_per_key(container_counts(pages), ["page_id"], [F.desc("n"), F.desc("label")], CONTAINER_CANDIDATES)
    return top.withColumn("selector", selectors[F.col("label")])


def field_candidates(pages: DataFrame) -> DataFrame:
    """A map of likely fields per page."""
    flags = extract_boxes(
        pages, PAGE,
        {
            "_t": Field(TITLE_LINK, "attr_all", "class"),
            "_tt": Field(TITLE_LINK, "all"),
            "_p": Field(PRICE, "all"),
            "_l": Field(f"{PAGE_LINK}, {NEXT_LINK}", "attr_all", "href"),
        },
    ).drop("item_idx")
    found = F.array(
        F.when((F.size("_t") > 0) | (F.size("_tt") > 0), F.struct(F.lit("标题").alias("k"), F.lit("h3 a::text").alias("v"))),
        F.when(F.size("_p") > 0, F.struct(F.lit("价格").alias("k"), F.lit(".price::text").alias("v"))),
        F.when(F.size("_l") > 0, F.struct(F.lit("链接").alias("k"), F.lit("a::attr(href)").alias("v"))),
    )
    return flags.select("page_id", "url", F.map_from_entries(F.array_compact(found)).alias("fields"))


def host_profile(profiled: DataFrame, url: str = "url") -> DataFrame:
    """Majority render choice and totals per host, from the columns of :func:`render_choice`."""
    per_choice = profiled.groupBy(host_key(url).alias("host"), "render").agg(
        F.count("*").alias("n"),
        F.count_if("challenge").alias("n_challenge"),
        F.sum("script_count").alias("scripts"),
    )
    return per_choice.groupBy("host").agg(
        F.sum("n").alias("n_pages"),
        F.sum("n_challenge").alias("n_challenge"),
        F.sum("scripts").alias("n_scripts"),
        F.max(F.struct("n", "render"))["render"].alias("render"),
    )
