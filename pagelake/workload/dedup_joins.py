"""Dedup, bloom filters, enrichment, paging and order-dependent operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions.hashing import bloom_positions, bloom_shape
from pagelake.operators import bloom, dedup, enrich, ordered, paging, proxies, sketches
from pagelake.operators.sticky import BUCKETS, sticky_assign
from pagelake.operators.throttle import throttle
from pagelake.session import epoch_micros
from pagelake.sources.seen import SeenUrls
from pagelake.workload.registry import ORACLES, QUERIES, query

HOUR = 3_600_000_000
DAY = 24 * HOUR

_KEYED_SQL = "select doc_id, lang, source, case when lang = 'en' then ' ' || text || ' ' when lang = 'fr' then '   ' end as k from documents"


def _keyed(t):
    key = F.when(F.col("lang") == "en", F.concat(F.lit(" "), "text", F.lit(" "))).when(F.col("lang") == "fr", "   ")
    return t.documents.select("doc_id", "lang", "source", key.alias("k"))


@query(
    "dedup_safe",
    f"""
    select doc_id, lang, source, k from (
        select *, row_number() over (partition by regexp_replace(k, '^\\s+|\\s+$', '', 'g') order by doc_id) as rn from ({_KEYED_SQL})
    ) where rn = 1 or coalesce(trim(k), '') = ''
    """,
)
def _(t):
    return dedup.dedup_safe(_keyed(t), "k", ["doc_id"])


@query(
    "dedup_report",
    f"""
    select count(*) as total, kept, count(*) - kept as dropped
    from ({_KEYED_SQL}), (
        select (count(distinct regexp_replace(k, '^\\s+|\\s+$', '', 'g')) filter (trim(k) <> '') + count(*) filter (coalesce(trim(k), '') = ''))::bigint as kept
        from ({_KEYED_SQL})
    ) group by kept
    """,
)
def _(t):
    return dedup.dedup_report(_keyed(t), "k")


@query(
    "dedup_first",
    """
    select doc_id, text, quality from (
        select d.doc_id, d.text, l.quality, row_number() over (partition by text, quality order by d.doc_id) as rn
        from documents d left join labels l using (doc_id)
    ) where rn = 1
    """,
)
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "text", "quality")
    return dedup.dedup_first(rows, ["text", "quality"], ["doc_id"])


@query(
    "dedup_url",
    """
    select conv_id, turn, url, md5(regexp_replace(url, '#.*$', '')) as url_hash from (
        select conv_id, turn, 'https://chat.test/' || role || '/' || turn || '#' || conv_id as url,
               row_number() over (partition by role, turn order by conv_id, turn) as rn from conversations
    ) where rn = 1
    """,
)
def _(t):
    url = F.concat(F.lit("HTTPS://Chat.Test/"), "role", F.lit("/"), "turn", F.lit("#"), "conv_id")
    rows = t.conversations.select("conv_id", "turn", url.alias("url"))
    out = dedup.dedup_url(rows, "url", ["conv_id", "turn"])
    return out.withColumn("url", F.replace(F.col("url"), F.lit("HTTPS://Chat.Test"), F.lit("https://chat.test")))


_ADMIT_SQL = """

    select doc_id, url, md5(url) as url_hash from (
        select doc_id, url, row_number() over (partition by url order by doc_id) as rn
        from (select doc_id, 'https://docs.test/' || source || '/' || n_chars as url from documents)
    ) where rn = 1 and url not in (
        select 'https://docs.test/' || source || '/' || n_chars from documents join labels using (doc_id)
    )
"""


def _admission(t):
    url = F.concat(F.lit("https://docs.test/"), "source", F.lit("/"), "n_chars")
    return t.documents.select("doc_id", url.alias("url")), t.documents.join(t.labels, "doc_id").select("doc_id", url.alias("url"))


@query("admit_new", _ADMIT_SQL)
def _(t):
    batch, seen = _admission(t)
    return dedup.admit_new(batch, seen.select(F.md5("url").alias("url_hash")), "url", ["doc_id"])


@query("admit_stored", _ADMIT_SQL)
def _(t):
    """The same through a stored history with bloom filters in front of it."""
    batch, seen = _admission(t)
    store = SeenUrls(t.spark, t.scratch("seen"), slots=8)
    store.admit(seen, "url", ["doc_id"])
    return store.admit(batch, "url", ["doc_id"])


@query(
    "item_fp",
    """
    select c_custkey, least(c_mktsegment, c_name) || chr(1) || greatest(c_mktsegment, c_name) as fp from customer
    """,
)
def _(t):
    rows = t.customer.select(
        "c_custkey", F.lit(" ").alias("blank"), F.concat(F.lit(" "), "c_name").alias("n"), F.lit(None).cast("string").alias("none"),
        F.col("c_mktsegment").alias("m"), F.col("c_name").alias("again"), F.lit("fourth").alias("z"),
    )
    fp = dedup.item_fingerprint(["blank", "n", "none", "m", "again", "z"])
    return rows.select("c_custkey", fp.alias("fp"))


@query(
    "approx_distinct",
    """
    select event_type, count(distinct user_id) as users, count(distinct cast(ts as date))::bigint as days, true as within
    from events group by 1
    """,
)
def _(t):
    """Distinct users per event type from sketches kept per day, held against the exact count."""
    day = F.floor(epoch_micros("ts") / 86_400_000_000).alias("day")
    rows = t.events.select("event_type", "user_id", day)
    kept = sketches.SketchTable(t.spark, t.scratch("sketches"), "user_id", ["event_type", "day"])
    for half in (0, 1):
        kept.add(rows.filter(F.pmod("day", F.lit(2)) == half), f"half{half}")
    kept.add(rows, "half1")  # known by its name, so nothing changes
    kept.compact()
    days = kept.read()
    estimates = sketches.united(days, ["event_type"]).join(days.groupBy("event_type").agg(F.count("*").alias("days")), "event_type")
    exact = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(estimates, "event_type").select("event_type", "users", "days", sketches.within("sketch", "users").alias("within"))


# --- bloom --------------------------------------------------------------------------------

def _mod_sql(digest: str, words: int, bits: int | str) -> str:
    """A hex digest modulo ``bits`` as nested integer arithmetic."""
    out = "0::hugeint"
    for w in range(words):
        out = f"(({out}) * 4294967296 + ('0x' || substr({digest}, {w * 8 + 1}, 8))::bigint) % {bits}"
    return out


def _positions_sql(items: str, bits: int, hashes: int) -> str:
    return f"""
        select item, ((a + i * b) % {bits})::bigint as pos from (
            select item, ({_mod_sql('md5(item)', 4, bits)}) as a, ({_mod_sql('sha1(item)', 5, bits)}) as b,
                   unnest(generate_series(0, {hashes - 1})) as i
            from ({items})
        )
    """


_URLS_SQL = "select distinct url as item from pages"
_BIG = bloom_shape()


@query(
    "bloom_positions",
    f"select item, string_agg(pos::varchar, ',' order by pos) as positions from ({_positions_sql(_URLS_SQL, *_BIG)}) group by item",
)
def _(t):
    bits, hashes = bloom_shape()
    items = t.pages.select(F.col("url").alias("item")).distinct()
    return items.select(
        "item", F.array_join(F.array_sort(bloom_positions("item", bits, hashes)), ",").alias("positions")
    )


_DOC_URL_SQL = "'https://docs.test/' || source || '/' || n_chars"


def _doc_items(df):
    return df.select(F.concat(F.lit("https://docs.test/"), "source", F.lit("/"), "n_chars").alias("item"))


# The filters have the shape of the items they hold, counted first. Each query has its former name and that of
# the time when there was a second form of a fixed shape.


def _sized_sql(items: str, known: str) -> str:
    """Positions of items in a filter whose shape follows from the number of known items."""
    return f"""
        select item, ((a + i * b) % bits)::bigint as pos, bits, hashes from (
            select item, bits, hashes, ({_mod_sql('md5(item)', 4, 'bits')}) as a, ({_mod_sql('sha1(item)', 5, 'bits')}) as b,
                   unnest(generate_series(0, hashes - 1)) as i
            from ({items}), (
                select floor(size)::bigint as bits, floor(size / n * ln(2))::bigint as hashes
                from (select n, -n * ln(0.001) / pow(ln(2), 2) as size from (select greatest(count(*), 1) as n from ({known})))
            )
        )
    """


_DOC_ITEMS_SQL = f"select distinct {_DOC_URL_SQL} as item from documents"
_KNOWN_ITEMS_SQL = f"select distinct {_DOC_URL_SQL} as item from documents join labels using (doc_id)"


@query(
    "bloom_build",
    f"""
    select pos // 64 as word, count(distinct pos)::int as set_bits, sum(distinct (pos % 64))::bigint as places
    from ({_sized_sql(_DOC_ITEMS_SQL, _DOC_ITEMS_SQL)}) group by 1
    """,
)
def _(t):
    items = _doc_items(t.documents)
    words = bloom.build(items, "item", *bloom.shape_for(items, "item"))
    set_places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return words.select(
        "word", F.bit_count("bits").alias("set_bits"),
        F.aggregate(set_places, F.lit(0).cast("bigint"), lambda acc, i: acc + i).alias("places"),
    )


@query(
    "bloom_contains",
    f"""
    with known as ({_sized_sql(_KNOWN_ITEMS_SQL, _KNOWN_ITEMS_SQL)}), asked as ({_sized_sql(_DOC_ITEMS_SQL, _KNOWN_ITEMS_SQL)})
    select item, bool_and(pos in (select pos from known)) as maybe from asked group by item
    """,
)
def _(t):
    known = _doc_items(t.documents.join(t.labels, "doc_id"))
    shape = bloom.shape_for(known, "item")
    return bloom.contains(_doc_items(t.documents), "item", bloom.build(known, "item", *shape), *shape)


@query(
    "bloom_count",
    f"""
    select count(distinct pos)::bigint as set_bits,
           floor(-(any_value(bits)::double / any_value(hashes)) * ln(1 - count(distinct pos) / any_value(bits)::double)) as estimate
    from ({_sized_sql(_DOC_ITEMS_SQL, _DOC_ITEMS_SQL)})
    """,
)
def _(t):
    items = _doc_items(t.documents)
    shape = bloom.shape_for(items, "item")
    return bloom.count(bloom.build(items, "item", *shape), *shape)


for _name in ("bloom_build", "bloom_contains", "bloom_count"):
    QUERIES[f"{_name}_sized"], ORACLES[f"{_name}_sized"] = QUERIES[_name], ORACLES[_name]


# --- enrichment ---------------------------------------------------------------------------


def _customer_pages(t):
    return t.customer.select(
        F.concat(F.lit("https://shop.test/c/"), "c_custkey").alias("url"), "c_name", "c_mktsegment", "c_nationkey"
    )


def _linked_orders(t):
    link = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit("/c/"), "o_custkey"))
    return t.orders.select("o_orderkey", link.alias("link"), F.lit("old").alias("c_name"))


def _backfill(t, limit):
    link = F.concat(F.lit("https://shop.test"), F.col("link"))
    return enrich.detail_backfill(
        _linked_orders(t), _customer_pages(t), "link", ["c_name", "c_mktsegment"], ["o_orderkey"], limit,
        resolved=link, usable=F.col("c_nationkey") != 3,
    )


def _backfill_sql(limit: str) -> str:
    return f"""
        with items as (
            select o_orderkey, case when o_orderpriority = '5-LOW' then '' else '/c/' || o_custkey end as link, o_custkey,
                   case when o_orderpriority <> '5-LOW' then row_number() over (partition by o_orderpriority = '5-LOW' order by o_orderkey) end as rn
            from orders
        )
        select o_orderkey, link, coalesce(c.c_name, 'old') as c_name, c.c_mktsegment
        from items left join customer c on c_custkey = o_custkey and c_nationkey <> 3 and rn is not null {limit}
    """


@query("detail_backfill", _backfill_sql(""))
def _(t):
    return _backfill(t, 0)


@query("detail_backfill_limit", _backfill_sql("and rn <= 500"))
def _(t):
    return _backfill(t, 500)


@query(
    "author_enrich",
    """
    select o_orderkey, coalesce(c_name, '') as author_name, coalesce(c_mktsegment, '') as author_birth_date,
           coalesce(c_nationkey::varchar, '') as author_birth_place, '' as author_description
    from orders left join customer on c_custkey = o_custkey and c_nationkey <> 3
    """,
)
def _(t):
    quotes = t.orders.select("o_orderkey", F.concat(F.lit("https://shop.test/c/"), "o_custkey").alias("author_url"))
    authors = _customer_pages(t).filter("c_nationkey <> 3").select(
        F.col("url").alias("author_url"), F.concat(F.lit(" "), "c_name").alias("author_name"),
        F.concat("c_mktsegment", F.lit("\n")).alias("author_birth_date"),
        F.col("c_nationkey").cast("string").alias("author_birth_place"), F.lit(None).cast("string").alias("author_description"),
    )
    return enrich.author_enrich(quotes, authors).drop("author_url")


@query(
    "follow_links",
    "select o_orderkey, c_name, c_mktsegment from orders join customer on c_custkey = o_custkey where o_orderpriority <> '5-LOW'",
)
def _(t):
    links = _linked_orders(t).filter("link <> ''").select(
        "o_orderkey", F.concat(F.lit("https://SHOP.test"), "link", F.lit("#reviews")).alias("dst")
    )
    return enrich.follow_links(links, _customer_pages(t)).select("o_orderkey", "c_name", "c_mktsegment")


def _sticky_sql(rounds: int = 12) -> str:
    """Rounds written out; each has the buckets that were turned away by those before."""
    out = f"""
        with doms as materialized (
            select domain, ('0x' || substr(md5(domain), 1, 8))::bigint % {BUCKETS} as bucket
            from (select distinct split_part(url, '/', 3) as domain from pages)
        ),
        alive as materialized (select s_name as proxy from supplier where s_suppkey % 5 < 3),
        bound as materialized (
            select split_part(url, '/', 3) as domain, min(proxy) as proxy
            from (select url, printf('Supplier#%09d', page_id % 100) as proxy from pages where page_id % 3 = 0)
            where proxy in (select proxy from alive) group by 1
        ),
        w0 as materialized (select bucket, count(*) as n from doms anti join bound using (domain) group by 1),
        r0 as materialized (
            select alive.proxy, ceil((select count(*) from doms) * 1.25 / (select count(*) from alive)) - count(bound.domain) as room
            from alive left join bound using (proxy) group by 1
        )"""
    for k in range(rounds):
        out += f""",
        t{k} as materialized (
            select bucket, proxy, n, coalesce(sum(n) over (
                partition by proxy order by md5(bucket::varchar), bucket rows between unbounded preceding and 1 preceding), 0) < room as fits
            from (select bucket, n, proxy, room from w{k}, r{k} where room > 0
                  qualify row_number() over (partition by bucket order by md5(bucket || ':' || proxy) desc, proxy desc) = 1)
        ),
        w{k + 1} as materialized (select bucket, n from t{k} where not fits),
        r{k + 1} as materialized (
            select r{k}.proxy, room - coalesce(used, 0) as room
            from r{k} left join (select proxy, sum(n) as used from t{k} where fits group by 1) using (proxy)
        )"""
    placed = " union all ".join(f"select bucket, proxy from t{k} where fits" for k in range(rounds))
    return out + f"""
        select domain, coalesce(bound.proxy, placed.proxy) as proxy
        from doms left join bound using (domain) left join ({placed}) as placed using (bucket)
        """


@query("sticky_assign", _sticky_sql())
def _(t):
    domains = t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("domain"))
    table = t.supplier.select(F.col("s_name").alias("proxy"), (F.col("s_suppkey") % 5).alias("fails"))
    bindings = t.pages.filter("page_id % 3 = 0").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("domain"),
        F.format_string("Supplier#%09d", F.col("page_id") % 100).alias("proxy"),
    )
    return sticky_assign(domains, bindings, table)


# --- paging -------------------------------------------------------------------------------


_PAGES_SQL = "select user_id, epoch_us(ts) // 3600000000 as page_no, count(*) as n_items, bool_or(event_type = 'error' and value > 30) as failed from events group by 1, 2"


def _job_pages(t):
    page = F.floor(epoch_micros("ts") / HOUR).cast("bigint")
    return t.events.groupBy("user_id", page.alias("page_no")).agg(
        F.count("*").alias("n_items"), F.max((F.col("event_type") == "error") & (F.col("value") > 30)).alias("failed")
    )


@query(
    "page_stop_serial",
    f"""
    select user_id, page_no, n_items, failed from (
        select *, max(failed) over (partition by user_id order by page_no) as stopped from ({_PAGES_SQL})
    ) where not stopped
    """,
)
def _(t):
    return paging.page_stop_serial(_job_pages(t), ["user_id"])


@query("page_concurrent", f"select user_id, page_no, n_items from ({_PAGES_SQL})")
def _(t):
    return paging.page_concurrent(_job_pages(t), ("page_no", "user_id")).select("user_id", "page_no", "n_items")


@query(
    "next_walk",
    """
    with recursive link as (
        select a.event_id as src, b.event_id as dst from events a join events b on b.event_id = a.event_id + 1
        where a.event_type <> 'error' and a.user_id <> b.user_id
    ), walk as (
        select event_id as seed, event_id as id, 1 as pos from events where event_type = 'signup'
        union all select seed, dst, pos + 1 from walk join link on src = id where pos < 40
    )
    select 'e' || seed as seed, 'e' || id as url, pos::int as pos from walk
    """,
)
def _(t):
    """Each event links to the one after it; errors are disabled, one user in a row is no change."""
    pages = t.events.select(
        F.concat(F.lit("e"), "event_id").alias("url"), F.concat(F.lit("e"), F.col("event_id") + 1).alias("next_url"),
        (F.col("event_type") == "error").alias("disabled"), F.col("user_id").cast("string").alias("first_item"),
    )
    seeds = t.events.filter("event_type = 'signup'").select(F.concat(F.lit("e"), "event_id").alias("url"))
    return paging.next_walk(pages, seeds, 40)


@query(
    "scroll_accumulate",
    """
    with seen as (
        select user_id, event_type, min((day, event_id)) as f from (
            select *, (epoch_us(ts) // 86400000000 - 19723)::bigint + 1 as day from events
        ) where day <= 25 group by 1, 2
    ), flat as (select user_id, event_type, f[1] as day, f[2] as event_id from seen),
    gaps as (
        select user_id, day, day - lag(day, 1, 0) over (partition by user_id order by day) as gap
        from (select distinct user_id, day from flat)
    ), stops as (select user_id, min(day) as stop from gaps where gap > 3 group by user_id)
    select user_id, event_type, day, event_id from flat left join stops using (user_id) where stop is null or day < stop
    """,
)
def _(t):
    """Days are snapshots of what a user shows; each kind of event is an item."""
    day = F.floor(epoch_micros("ts") / DAY).cast("bigint") - 19723 + 1
    rows = t.events.select("user_id", "event_type", "event_id", day.alias("day"))
    return paging.scroll_accumulate(rows, "user_id", "day", "event_id", "event_type", max_scrolls=25)


# --- ordered ------------------------------------------------------------------------------


@query(
    "pacing_plan",
    """
    select event_id, (rn * 1200000000 + max(t - rn * 1200000000) over (partition by event_type order by t, event_id))::bigint as slot from (
        select *, epoch_us(ts) as t, row_number() over (partition by event_type order by epoch_us(ts), event_id) as rn from events
    )
    """,
)
def _(t):
    rows = t.events.select("event_id", "event_type", epoch_micros("ts").alias("t"))
    return ordered.paced(rows, ["event_type"], "t", "event_id", 1_200_000_000).select("event_id", "slot")


@query(
    "alert_throttle",
    """
    with recursive keyed as (
        select event_id, event_type as k, epoch_us(ts) as t from events where event_type <> 'view'
    ), chain as (
        select a.event_id, a.k, a.t, b.event_id as next_id
        from (select *, t + 7200000000 as due from keyed) a asof left join (select * from keyed) b on a.k = b.k and a.due <= b.t
    ), passed as (
        select event_id, next_id from chain where event_id in (select arg_min(event_id, (t, event_id)) from keyed group by k)
        union all select c.event_id, c.next_id from passed p join chain c on c.event_id = p.next_id
    )
    select event_id, event_type from events where event_type = 'view' or event_id in (select event_id from passed)
    """,
)
def _(t):
    """One alert per kind in two hours; kind ``view`` has no key and is never held back."""
    rows = t.events.select(
        "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("k"),
        epoch_micros("ts").alias("t"),
    )
    return throttle(rows, "k", "t", "event_id", 2 * HOUR).select("event_id", "event_type")


@query(
    "proxy_evict",
    """
    with runs as (
        select user_id, epoch_us(ts) as t, event_id, event_type not in ('error', 'click') as ok,
               sum((event_type not in ('error', 'click'))::int) over (partition by user_id order by ts, event_id) as run
        from events
    ), fails as (
        select *, row_number() over (partition by user_id, run order by t, event_id) as rn from runs where not ok
    )
    select user_id as proxy, min(t) as evicted_at from fails where rn = 3 group by 1
    """,
)
def _(t):
    checks = t.events.select(
        F.col("user_id").alias("proxy"), epoch_micros("ts").alias("t"), F.col("event_id").alias("id"),
        (~F.col("event_type").isin("error", "click")).alias("ok"),
    )
    return proxies.evicted(checks)


@query(
    "running_totals",
    """
    select event_id, (sum(user_id) over w)::bigint as users, max(value) over w as top from events
    window w as (partition by event_type order by event_id)
    """,
)
def _(t):
    out = ordered.running(
        t.events.select("event_id", "event_type", "user_id", "value"), ["event_type"], ["event_id"], 1000,
        sums={"users": F.col("user_id")}, maxima={"top": F.col("value")},
    )
    return out.select("event_id", "users", "top")


@query("number_rows", "select event_id, row_number() over (order by value desc, event_id) as row_no from events")
def _(t):
    rows = t.events.select("event_id", "value")
    return ordered.number_rows(rows, [F.desc("value"), F.col("event_id")]).select("event_id", "row_no")
