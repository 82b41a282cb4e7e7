"""Rows out of pages and JSON responses, page filters, profiles, and the whole job."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import text as tx
from pagelake.functions import urls
from pagelake.operators import assist, dedup, extract, jsonitems, profile, robots
from pagelake.operators.extract import Field
from pagelake.plans.job import run_job
from pagelake.workload.registry import query

# Links of the navigation list of each page, as the regular expressions of the SQL side see them.
NAV_SQL = """
    select page_id, url, i - 1 as item_idx, replace(texts[i], '&amp;', '&') as label, replace(hrefs[i], '&amp;', '&') as href
    from (
        select *, unnest(generate_series(1, len(hrefs))) as i from (
            select page_id, url, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs,
                   regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2) as texts
            from (select page_id, url, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav from pages)
        )
    )
"""
NAV_FIELDS = {"label": "a::text", "href": "a::attr(href)"}
TITLE_SQL = r"trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g'))"
ORIGIN_SQL = "lower(regexp_extract(url, '^(https?)://', 1)) || '://' || split_part(url, '/', 3)"


def nav_links(t):
    return extract.extract_items(t.pages, "nav li", NAV_FIELDS)


@query("extract_links", f"select page_id, url, item_idx::int as item_idx, label, href from ({NAV_SQL})")
def _(t):
    return nav_links(t)


@query("extract_titles", f"select page_id, {TITLE_SQL} as title, {TITLE_SQL} as heading from pages")
def _(t):
    rows = extract.extract_items(t.pages, "html", {"title": "title::text", "heading": "article > h1:nth-child(1)"})
    return rows.select("page_id", "title", "heading")


@query(
    "extract_hrefs",
    """
    select page_id, replace(regexp_extract(html, '(?s)<nav>.*?<a href="([^"]*)">', 1), '&amp;', '&') as first_href,
           'utf-8' as charset, '' as none
    from pages
    """,
)
def _(t):
    rows = extract.extract_items(
        t.pages, "html", {"first_href": "nav a::attr(href)", "charset": "meta[charset]::attr(charset)", "none": "table::attr(id)"}
    )
    return rows.select("page_id", "first_href", "charset", "none")


@query(
    "extract_text_list",
    f"""
    select page_id, string_agg(label, '|' order by item_idx) as labels, count(*)::int as n_labels, first(label order by item_idx) as first_label,
           string_agg(href, '|' order by item_idx) as hrefs
    from ({NAV_SQL}) group by page_id
    """,
)
def _(t):
    rows = extract.extract_boxes(
        t.pages, "html",
        {"labels": Field("ul li a", "all"), "first_label": Field("nav a", "first"), "hrefs": Field("nav ul > li > a", "attr_all", "href")},
    )
    tagged = extract.with_tags(rows, "labels").withColumnRenamed("tag_count", "n_labels")
    return tagged.select(
        "page_id", F.array_join("labels", "|").alias("labels"), "n_labels", "first_label", F.array_join("hrefs", "|").alias("hrefs")
    )


@query(
    "item_lineage",
    "select page_id, url, 'links' as spider_name, '2024-06-01T00:00:00' as crawled_at from pages",
)
def _(t):
    return extract.with_lineage(t.pages.select("page_id", "url"), "links", "2024-06-01T00:00:00")


@query("resolve_links", f"select page_id, item_idx::int as item_idx, {ORIGIN_SQL} || href as dst from ({NAV_SQL})")
def _(t):
    return nav_links(t).select("page_id", "item_idx", urls.resolve_link("url", "href").alias("dst"))


@query(
    "outlinks",
    f"""
    select page_id, url as src, {ORIGIN_SQL} || href as dst, 'nav' as kind, item_idx::int as link_idx from ({NAV_SQL})
    union all
    select page_id, url, {ORIGIN_SQL} || href, 'first', 0 from ({NAV_SQL}) where item_idx = 0
    """,
)
def _(t):
    return extract.outlinks(t.pages, {"nav": "nav li a", "first": "li:nth-child(1) a"}, native_links=True)


@query(
    "harvest_links",
    f"""
    select page_id, item_idx::int as item_idx, label, dst, md5(dst) as url_hash from (
        select *, row_number() over (partition by dst order by page_id, item_idx) as rn
        from (select *, {ORIGIN_SQL} || href as dst from ({NAV_SQL}))
    ) where rn = 1
    """,
)
def _(t):
    """The flagship: pages to link items, cleaned, resolved, first per URL."""
    items = nav_links(t).select(
        "page_id", "item_idx", tx.clean_text("label").alias("label"),
        urls.resolve_root_relative("url", "href").alias("dst"),
    )
    return dedup.dedup_url(items, "dst", ["page_id", "item_idx"])


# --- JSON ---------------------------------------------------------------------------------

@query(
    "json_items",
    """
    select event_id, i as item_idx, case when i = 3 then 'plain' else event_type end as kind,
           case i when 1 then '' when 3 then 'plain' else user_id::varchar end as user
    from (select *, unnest([0, 1, 3]) as i from events)
    """,
)
def _(t):
    # An item without user, an empty one that must vanish, and a scalar one.
    item = F.concat(F.lit('{"type":" '), "event_type", F.lit(' ","user":{"id":'), "user_id", F.lit("}}"))
    body = F.concat(
        F.lit('{"data":{"items":['), item, F.lit(',{"type":"'), "event_type", F.lit('","user":null},{"x":1},"plain"]}}')
    )
    rows = t.events.select("event_id", body.alias("text"))
    return jsonitems.json_items(rows, {"kind": "type", "user": "user.id"}, "data.items", keep=["event_id"])


@query(
    "json_parallel",
    """
    select o_orderkey, i::int as item_idx, case i when 0 then o_orderstatus when 1 then 'x' else '' end as day,
           case i when 0 then o_custkey::varchar when 1 then '2' else '3' end as price
    from (select *, unnest([0, 1, 2]) as i from orders)
    """,
)
def _(t):
    body = F.concat(
        F.lit('{"unit":"c","daily":{"price":['), "o_custkey", F.lit(',2,3],"day":["'), "o_orderstatus", F.lit('","x"]}}')
    )
    rows = t.orders.select("o_orderkey", F.try_parse_json(body).alias("v"))
    return jsonitems.parallel_arrays(rows, "v", {"day": "day", "price": "price"}, "daily", keep=["o_orderkey"])


@query(
    "json_auto",
    """
    select event_id, i::int as item_idx, case when event_type = 'click' then event_type else i::varchar end as a,
           case when event_type = 'click' then user_id::varchar else '' end as b
    from (select *, unnest(generate_series(0, case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 else -1 end)) as i from events)
    """,
)
def _(t):
    """Each kind of event carries its items in another place."""
    e = F.col("event_type")
    body = (
        F.when(e == "click", F.concat(F.lit('[{"a":"'), e, F.lit('","b":'), "user_id", F.lit("}]")))
        .when(e == "view", F.lit('{"n":1,"a":[0,1],"x":{"a":[9]}}'))
        .when(e == "error", F.lit('{"n":1,"x":{"c":2},"z":{"a":[0,1,2]},"y":{"b":[7]}}'))
        .when(e == "signup", F.lit('{"items":[{"a":1,"b":2}]}'))
        .otherwise(F.lit("<html>[1]</html>"))
    )
    return jsonitems.json_items(t.events.select("event_id", body.alias("text")), {"a": "a", "b": "b"}, keep=["event_id"])


@query(
    "json_captured",
    "select event_id, 1 as item_idx, event_type as kind from events",
)
def _(t):
    body = F.concat(F.lit('{"list":["skip",{"type":"'), "event_type", F.lit('"},[1],{"type":"  "}]}'))
    rows = t.events.select("event_id", F.try_parse_json(body).alias("v"))
    return jsonitems.json_records(rows, "v", {"kind": "type"}, "list", keep=["event_id"], objects_only=True)


@query(
    "prefer_api",
    """
    select doc_id, 'api' as origin, quality::varchar as value from labels
    union all select doc_id, 'page', lang from documents where doc_id not in (select doc_id from labels)
    """,
)
def _(t):
    api = t.labels.select("doc_id", F.lit("api").alias("origin"), F.col("quality").cast("string").alias("value"))
    page = t.documents.select("doc_id", F.lit("page").alias("origin"), F.col("lang").alias("value"))
    return jsonitems.prefer_api(api, page, "doc_id")


# --- page filters -------------------------------------------------------------------------


@query(
    "challenge_pages",
    "select page_id, contains(url, 'spam-farm') as challenge, false as json_challenge, regexp_matches(lower(substr(html, 1, 6000)), 'captcha|jsessionid|验证码') as plain from pages",
)
def _(t):
    marked = F.when(F.contains("url", F.lit("spam-farm")), F.concat(F.lit("<!-- CAPTCHA -->"), "html")).otherwise(F.col("html"))
    return t.pages.select(
        "page_id", profile.is_challenge(marked).alias("challenge"),
        profile.is_challenge(marked, F.lit("application/JSON")).alias("json_challenge"),
        profile.is_challenge("html").alias("plain"),
    )


@query(
    "robots_allowed",
    """
    with p as (select page_id, split_part(url, '/', 3) as host, regexp_replace(url, '^https?://[^/]+|#.*$', '', 'g') as target from pages),
    hosts as (select distinct host from p),
    rules as (
        select host, 0 as o, false as allow, '/en/9' as path from hosts where not starts_with(host, 'blog.')
        union all select host, 1, true, '/en/' from hosts where not starts_with(host, 'blog.')
        union all select host, 2, false, '/fr/' from hosts where not starts_with(host, 'blog.')
        union all select host, 3, true, '/fr/5' from hosts where not starts_with(host, 'blog.')
        union all select host, 10, true, '/en/4' from hosts where starts_with(host, 'blog.')
        union all select host, 11, false, '/en/' from hosts where starts_with(host, 'blog.')
        union all select host, 12, true, '' from hosts where starts_with(host, 'blog.')
    )
    select page_id, coalesce(arg_min(allow, o), true) as allowed
    from p left join rules on p.host = rules.host and starts_with(target, path) group by page_id
    """,
)
def _(t):
    hosts = t.pages.select(F.lower(urls.netloc("url")).alias("host")).distinct()

    def rule(agent, ordinal, allow, path):
        return F.struct(
            F.lit(agent).alias("agent"), F.lit(ordinal).alias("ordinal"), F.lit(allow).alias("allow"), F.lit(path).alias("path")
        )

    common = [rule("*", 0, False, "/en/9"), rule("*", 1, True, "/en/"), rule("*", 2, False, "/fr/"), rule("*", 3, True, "/fr/5")]
    own = [rule("PageBot", 10, True, "/en/4"), rule("PageBot", 11, False, "/en/"), rule("pagebot", 12, False, "")]
    table = hosts.select(
        "host", F.inline(F.when(F.col("host").startswith("blog."), F.array(*common, *own)).otherwise(F.array(*common)))
    )
    # Agent names are compared without case, so both spellings are one group.
    table = table.withColumn("agent", F.lower("agent"))
    return robots.robots_allowed(t.pages.select("page_id", "url"), table, "PageBot/1.0").select("page_id", "allowed")


@query(
    "allowed_domains",
    "select page_id, url from pages where regexp_matches(split_part(url, '/', 3), '(^|[.])example[.](com|org)$')",
)
def _(t):
    return robots.allowed_domains(t.pages.select("page_id", "url"), ["example.com", "Example.org"])


# --- profiles -----------------------------------------------------------------------------


@query("profile_title", f"select page_id, substr({TITLE_SQL.replace('trim(regexp_replace(', 'trim(', 1).replace(r''', '\s+', ' ', 'g')''', '')}, 1, 120) as title from pages")
def _(t):
    return t.pages.select("page_id", profile.title("html").alias("title"))


_BODY_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""
_SIGNALS_SQL = f"""
    select page_id, url, len(regexp_extract_all(html, '(?i)<script\\b'))::int as script_count, length({_BODY_SQL})::int as text_len,
           regexp_matches(html, '__NEXT_DATA__|__NUXT__|__INITIAL_STATE__') as has_ssr_json,
           regexp_matches(lower(substr(html, 1, 6000)), 'captcha|jsessionid|验证码') as challenge
    from pages
"""


@query("profile_signals", _SIGNALS_SQL)
def _(t):
    return profile.signals(t.pages).drop("html")


_MANY_SQL = f"""
    select page_id, url, n as script_count, case when url like '%/en/%' then 10 else text_len end as text_len,
           (page_id % 3 = 0) as has_ssr_json, (page_id % 5 = 0) as challenge
    from (select *, (page_id % 16)::int as n from ({_SIGNALS_SQL}))
"""
_RENDER_SQL = f"""
    select *, not challenge and script_count >= 8 and text_len < 800 as js_dynamic,
           case when challenge or (script_count >= 8 and text_len < 800 and not has_ssr_json) then 'playwright' else 'direct' end as render
    from ({_MANY_SQL})
"""


def _render(t):
    """Signals with some of their values varied, so that every branch is taken."""
    rows = profile.signals(t.pages).drop("html").withColumns(
        {
            "script_count": (F.col("page_id") % 16).cast("int"),
            "text_len": F.when(F.contains("url", F.lit("/en/")), 10).otherwise(F.col("text_len")),
            "has_ssr_json": F.col("page_id") % 3 == 0,
            "challenge": F.col("page_id") % 5 == 0,
        }
    )
    return profile.render_choice(rows)


@query("profile_render", _RENDER_SQL)
def _(t):
    return _render(t)


@query(
    "profile_host",
    f"""
    select host, sum(n)::bigint as n_pages, sum(c)::bigint as n_challenge, sum(s)::bigint as n_scripts, arg_max(render, (n, render)) as render
    from (select split_part(url, '/', 3) as host, render, count(*) as n, count_if(challenge) as c, sum(script_count) as s from ({_RENDER_SQL}) group by 1, 2)
    group by host
    """,
)
def _(t):
    return profile.host_profile(_render(t))


@query(
    "profile_paging",
    "select page_id, case when contains(url, 'page=2') then 'url_pattern' when contains(url, 'utm_') then 'next_button' else 'unknown' end as pagination from pages",
)
def _(t):
    """A paging link put into the pages whose URL says so."""
    link = F.when(F.contains("url", F.lit("page=2")), '<a href="/list?page=3">3</a>').when(
        F.contains("url", F.lit("utm_")), '<a class="btn next" href="/n">&raquo;</a>'
    ).otherwise("")
    pages = t.pages.withColumn("html", F.replace("html", F.lit("</nav>"), F.concat(link, F.lit("</nav>"))))
    return profile.paging(pages).select("page_id", "pagination")


@query(
    "container_candidates",
    """
    select page_id, 'article' as label, len(regexp_extract_all(html, '<article[ >]'))::bigint as n, 'article' as selector from pages where contains(html, '<article')
    """,
)
def _(t):
    return profile.container_candidates(t.pages).select("page_id", "label", "n", "selector")


@query("field_candidates", "select page_id, '链接' as names from pages where contains(url, 'page=2')")
def _(t):
    link = F.when(F.contains("url", F.lit("page=2")), '<a href="/list?page=3">3</a>').otherwise("")
    pages = t.pages.withColumn("html", F.replace("html", F.lit("</nav>"), F.concat(link, F.lit("</nav>"))))
    named = profile.field_candidates(pages).withColumn("names", F.array_join(F.map_keys("fields"), ","))
    return named.filter("names <> ''").select("page_id", "names")


# --- model-assisted extraction ------------------------------------------------------------


@query(
    "assist_prompt",
    """
    select doc_id, length(text)::bigint as n, left(text, 8000) as extract_text, left(text, 5000) as classify_text, left(text, 3000) as normalize_text
    from documents
    """,
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", F.length(text).cast("bigint").alias("n"),
        F.regexp_replace(assist.extract_prompt(text, ["title"])["user"], "^Text:\n", "").alias("extract_text"),
        assist.classify_prompt(text, ["a", "b"])["user"].alias("classify_text"),
        assist.normalize_prompt(text, "plain")["user"].alias("normalize_text"),
    )


@query(
    "assist_parse",
    "select event_id, case when event_type = 'signup' then null else (props->>'$.k')::bigint end as k from events",
)
def _(t):
    e = F.col("event_type")
    reply = (
        F.when(e == "error", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {x}.")))
        .when(e == "click", F.concat(F.lit("It is "), "props", F.lit(" as asked")))
        .when(e == "signup", F.lit("no JSON here"))
        .otherwise(F.col("props"))
    )
    return t.events.select("event_id", F.try_variant_get(assist.parse_reply(reply), "$.k", "bigint").alias("k"))


@query(
    "assist_category",
    """
    select event_id, case event_type when 'view' then 'view' when 'click' then 'click' else '<' || event_type || '>' end as category from events
    """,
)
def _(t):
    reply = F.concat(F.lit(' "<'), "event_type", F.lit('>" '))
    return t.events.select("event_id", assist.snap_category(reply, ["view", "click"]).alias("category"))


@query(
    "assist_merge",
    """
    select doc_id, case when lang = 'en' then 'English' else lang end as lang,
           case when lang = 'en' then n_chars::varchar end as size, source
    from documents
    """,
)
def _(t):
    reply = F.when(
        F.col("lang") == "en", F.concat(F.lit('{"lang":"English","size":'), "n_chars", F.lit("}"))
    ).otherwise("{}")
    rows = t.documents.select("doc_id", "lang", "source", F.parse_json(reply).alias("parsed"))
    return assist.merge_extracted(rows, "parsed", ["lang", "size"]).drop("parsed")


@query("assist_score", "select doc_id, source, least(length(text), 8000)::varchar as length from documents")
def _(t):
    """A stand-in scorer that answers with the length of its text; it is asked in batches."""

    def scorer(prompts):
        sizes = prompts["user"].str.len() - len("Text:\n")
        return '```json\n{"length": ' + sizes.astype(str) + "}\n```"

    out = assist.extract_fields(t.documents, ["length"], scorer, "text")
    return out.select("doc_id", "source", "length")


# --- the whole job ------------------------------------------------------------------------

# The upper case of ß is SS in Unicode (and Python and Java); DuckDB has a capital ß.

@query(
    "run_job",
    f"""
    with items as (
        select page_id as page_no, item_idx::int as item_idx, url, upper(replace(label, 'ß', 'ss')) as label, href from ({NAV_SQL})
    )
    select page_no, item_idx, url, label, href from (
        select *, row_number() over (partition by href order by page_no, item_idx) as rn from items
    ) where rn = 1
    """,
)
def _(t):
    """Configured extraction, post-processing and dedup over all pages."""
    config = {
        "name": "links", "first_url": "https://example.com/", "item_selector": "nav li",
        "fields": NAV_FIELDS, "postprocess": {"label": {"collapse_ws": True, "upper": True}},
        "dedup": {"key": "href"}, "concurrency": 8,
    }
    return run_job(t.pages.withColumnRenamed("page_id", "page_no"), config)


def _nav_job(**more):
    return {"name": "links", "first_url": "https://example.com/", "item_selector": "nav li", "fields": NAV_FIELDS, "concurrency": 8, **more}


@query(
    "run_job_next",
    f"""
    with items as (select page_id - (select min(page_id) from pages) + 1 as page_no, item_idx, label, href from ({NAV_SQL})),
    firsts as (select page_no, label from items where item_idx = 0),
    ends as (
        select min(a.page_no) as last from firsts a left join firsts b on b.page_no = a.page_no + 1
        where coalesce(b.label, '') = '' or b.label = a.label
    )
    select page_no, item_idx::int as item_idx, label as "标题", href from items, ends where page_no <= least(last, 10000)
    """,
)
def _(t):
    """Every page links to the one after it; the walk ends where the first item does not change."""
    first = t.pages.agg(F.min("page_id").alias("first"))
    place = F.col("page_id") - F.col("first")
    button = F.concat(F.lit('<a class="next" href="/'), place + 1, F.lit('">next</a>'))
    pages = t.pages.crossJoin(F.broadcast(first)).select(
        F.col("page_id").alias("page_no"), F.concat(F.lit("https://p.test/"), place).alias("url"), F.concat(button, "html").alias("html")
    )
    config = _nav_job(
        render="playwright", first_url="https://p.test/0", fields={"标题": "a::text", "href": "a::attr(href)"},
        pagination={"type": "next_button", "next_selector": "a.next", "max_pages": 10_000},
    )
    return run_job(pages, config).drop("url")


@query(
    "run_job_scroll",
    f"""
    with items as (
        select page_id - (select min(page_id) from pages) + 1 as page_no, item_idx, label, href,
               least(label, href) || chr(1) || greatest(label, href) as fp from ({NAV_SQL})
    ), new as (
        select * from items where page_no <= 10000 qualify row_number() over (partition by fp order by page_no, item_idx) = 1
    ), gaps as (select page_no, page_no - lag(page_no, 1, 0) over (order by page_no) as gap from (select distinct page_no from new)),
    ends as (select coalesce(min(page_no) filter (gap > 3), 1000000) as stop from gaps)
    select page_no, item_idx::int as item_idx, label, href from new, ends where page_no < stop
    """,
)
def _(t):
    """Pages as what is seen after each scroll."""
    first = t.pages.agg(F.min("page_id").alias("first"))
    pages = t.pages.crossJoin(F.broadcast(first)).select((F.col("page_id") - F.col("first") + 1).alias("page_no"), "url", "html")
    return run_job(pages, _nav_job(render="playwright", pagination={"type": "infinite_scroll", "max_scrolls": 10_000})).drop("url")


@query(
    "run_job_serial",
    f"""
    with ends as (select coalesce(min(page_id), 1000000000) as stop from pages where url like '%utm_source%')
    select page_id + 1 as page_no, item_idx::int as item_idx, label, href from ({NAV_SQL}), ends where page_id < stop and page_id between 0 and 9999
    """,
)
def _(t):
    """One page after the other: the first without items, here one with a tracking mark, ends the job."""
    html = F.when(F.col("url").contains("utm_source"), "").otherwise(F.col("html"))
    pages = t.pages.select((F.col("page_id") + 1).alias("page_no"), "url", html.alias("html"))
    plan = {"type": "url_pattern", "url_pattern": "https://example.com/{page}", "start_page": 1, "max_pages": 10_000}
    return run_job(pages, _nav_job(pagination=plan, concurrency=1)).drop("url")


@query(
    "run_job_resume",
    f"""
    select page_id as page_no, item_idx::int as item_idx, label, href from ({NAV_SQL}) where url not like '%page=2%'
    union all select page_id, 0, 'kept', url from pages where url like '%page=2%'
    """,
)
def _(t):
    """Pages that a checkpoint holds are taken from there."""
    kept = F.array(F.create_map(F.lit("label"), F.lit("kept"), F.lit("href"), F.col("url")))
    done = t.pages.filter(F.col("url").contains("page=2")).select(F.col("page_id").alias("page_no"), kept.alias("items"))
    return run_job(t.pages.withColumnRenamed("page_id", "page_no"), _nav_job(resume=True), checkpoint=done).drop("url")


@query(
    "run_job_captured",
    f"""
    select page_id as page_no, item_idx::int as item_idx, label, href from ({NAV_SQL}) where url not like '%page=2%'
    union all select page_id, i, 'r' || i, url from pages, (select unnest([0, 1, 2, 3])::int as i) where url like '%page=2%'
    """,
)
def _(t):
    """Pages with two captured responses of two items each: positions go on over the responses of a page."""
    item = lambda i: F.struct(F.lit(f"r{i}").alias("label"), F.col("url").alias("href"))
    both = F.array(*[F.struct(F.lit(k).alias("seq"), F.to_json(F.array(item(2 * k), item(2 * k + 1))).alias("body")) for k in (0, 1)])
    captured = t.pages.filter(F.col("url").contains("page=2")).select(F.col("page_id").alias("page_no"), "url", F.inline(both))
    config = _nav_job(api={"fields": {"label": "label", "href": "href"}})
    return run_job(t.pages.withColumnRenamed("page_id", "page_no"), config, responses=captured).drop("url")
