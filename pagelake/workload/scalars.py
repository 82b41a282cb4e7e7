"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import hashing, http, jsonpath, redaction, text, urls
from pagelake.operators import ordered
from pagelake.workload.registry import query

@query("clean_text", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as cleaned from documents")
def _(t):
    return t.documents.select("doc_id", text.clean_text("text").alias("cleaned"))


@query(
    "text_fields",
    r"select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from conversations",
)
def _(t):
    return t.conversations.select("conv_id", "turn", text.collapse("text").alias("text"))


@query(
    "url_fingerprint",
    """
    select page_id, md5(regexp_replace(url, '#.*$', '')) as url_hash,
           md5(regexp_replace(url, '[?#].*$', '') || '?a=1&z=%C3%A9') as query_hash
    from pages
    """,
)
def _(t):
    shuffled = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?z=%c3%a9&empty=&a=1#top"))
    return t.pages.select(
        "page_id", urls.url_fingerprint("url").alias("url_hash"), urls.url_fingerprint(shuffled).alias("query_hash")
    )


@query(
    "sanitize_ident",
    r"""
    with names as (
        select p_partkey as id, 'name' as kind, p_name as name from part
        union all select p_partkey, 'brand', p_brand from part
        union all select c_custkey, 'customer', '  ' || c_name || ' 书名 ' from customer
    ), forms as (
        select *, trim(name) as raw,
               regexp_replace(lower(trim(name)), '[\s.-]+', '_', 'g') as as_is,
               regexp_replace(regexp_replace(
                   lower(regexp_replace(trim(name), '[^a-zA-Z0-9_]', '_', 'g')),
                   '_+', '_', 'g'), '^_|_$', '', 'g') as legal
        from names
    )
    select id, kind, substr(case when legal = as_is then legal
        else (case when legal = '' then 'col' else legal end) || '_' || substr(sha1(raw), 1, 6) end, 1, 48) as ident
    from forms
    """,
)
def _(t):
    names = (
        t.part.select(F.col("p_partkey").alias("id"), F.lit("name").alias("kind"), F.col("p_name").alias("name"))
        .unionByName(t.part.select(F.col("p_partkey").alias("id"), F.lit("brand").alias("kind"), F.col("p_brand").alias("name")))
        .unionByName(
            t.customer.select(
                F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"),
                F.concat(F.lit("  "), "c_name", F.lit(" 书名 ")).alias("name"),
            )
        )
    )
    return names.select("id", "kind", text.sanitize_identifier("name").alias("ident"))


@query("short_hash", "select p_partkey, substr(sha1(p_name), 1, 6) as h6, substr(sha1(p_brand), 1, 12) as h12 from part")
def _(t):
    return t.part.select(
        "p_partkey", text.short_hash("p_name").alias("h6"), text.short_hash("p_brand", 12).alias("h12")
    )


@query(
    "extract_numbers",
    r"select doc_id, array_to_string(regexp_extract_all(text, '\d+\.?\d*'), '|') as numbers from documents",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(text.extract_numbers("text"), "|").alias("numbers"))


@query(
    "safe_name",
    r"""
    select page_id, coalesce(nullif(trim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g')), ''), 'result') as url_name,
           coalesce(nullif(trim(regexp_replace(split_part(url, '#', 2), '[\\/:*?"<>|]', '_', 'g')), ''), 'result') as anchor_name
    from pages
    """,
)
def _(t):
    return t.pages.select(
        "page_id",
        text.safe_name("url").alias("url_name"),
        text.safe_name(F.split_part("url", F.lit("#"), F.lit(2))).alias("anchor_name"),
    )


@query(
    "host_key",
    """
    select page_id, lower(split_part(url, '/', 3)) as host,
           lower(split_part(url, '/', 3)) || ':8080' as odd_port,
           lower(split_part(url, '/', 3)) as own_port
    from pages
    """,
)
def _(t):
    def with_port(port):
        return F.regexp_replace("url", "^(https?://)([^/]+)", "$1user:pw@$2:" + port)

    own = F.when(F.col("url").startswith("https"), with_port("443")).otherwise(with_port("80"))
    return t.pages.select(
        "page_id", urls.host_key("url").alias("host"),
        urls.host_key(with_port("8080")).alias("odd_port"), urls.host_key(own).alias("own_port"),
    )


@query("domain", "select page_id, split_part(url, '/', 3) as domain from pages")
def _(t):
    return t.pages.select("page_id", urls.domain("url").alias("domain"))


@query(
    "signature",
    """
    select p_partkey, substr(sha256('{"name":"' || p_name || '","size":' || p_size || '}'), 1, 16) as sig from part
    """,
)
def _(t):
    contract = F.concat(F.lit('{"name":"'), "p_name", F.lit('","size":'), F.col("p_size").cast("string"), F.lit("}"))
    return t.part.select("p_partkey", hashing.signature_column(contract).alias("sig"))


def _grouped(amount):
    """A number as text with a thousands separator and two decimals."""
    cents = F.round(F.abs(amount) * 100).cast("bigint")
    whole = ((cents - cents % 100) / 100).cast("bigint")
    thousands = ((whole - whole % 1000) / 1000).cast("bigint")
    return F.concat(
        thousands.cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"),
        F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"),
    )


@query(
    "type_cast",
    """
    select o_orderkey, cents // 100 as as_int, cents / 100.0::double as as_float,
           o_orderstatus = 'F' as as_bool, null::bigint as bad_int
    from (select *, round(o_totalprice * 100)::bigint as cents from orders)
    """,
)
def _(t):
    shown = t.orders.withColumn("shown", _grouped(F.col("o_totalprice")))
    flag = F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no")
    return shown.select(
        "o_orderkey",
        text.cast_value("shown", "int").alias("as_int"),
        text.cast_value("shown", "float").alias("as_float"),
        text.cast_value(flag, "bool").alias("as_bool"),
        text.cast_value("o_orderpriority", "int").alias("bad_int"),
    )


@query(
    "to_numeric",
    """
    select c_custkey, (round(abs(c_acctbal) * 100)::bigint) / 100.0::double as amount,
           null::double as name_number, c_nationkey::double as nation_number
    from customer
    """,
)
def _(t):
    return t.customer.select(
        "c_custkey",
        text.to_numeric(_grouped(F.col("c_acctbal"))).alias("amount"),
        text.to_numeric("c_name").alias("name_number"),
        text.to_numeric(F.concat(F.lit(" "), "c_nationkey", F.lit("e0 "))).alias("nation_number"),
    )


@query("digits_only", "select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as digits from customer")
def _(t):
    return t.customer.select("c_custkey", text.digits_only("c_name").alias("digits"))


@query(
    "chunk",
    """
    select o_orderkey, ((row_number() over (order by o_orderdate, o_orderkey) - 1) // 500)::bigint as chunk from orders
    """,
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return ordered.chunk(rows, ["o_orderdate", "o_orderkey"], 500).select("o_orderkey", "chunk")


@query(
    "dedup_key",
    "select o_orderkey, 'https://shop.test/o/' || o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d') as k from orders",
)
def _(t):
    url = F.concat(F.lit("https://shop.test/o/"), F.col("o_orderkey").cast("string"))
    key = text.template("{url}_{date}", {"url": url, "date": F.date_format("o_orderdate", "yyyy-MM-dd")})
    return t.orders.select("o_orderkey", key.alias("k"))


_STATUS_SQL = """case event_type when 'error' then 500 when 'signup' then 404 when 'click' then 429 else 200 end"""


def _status():
    e = F.col("event_type")
    return F.when(e == "error", 500).when(e == "signup", 404).when(e == "click", 429).otherwise(200)


@query(
    "retry_class",
    f"""
    select event_id, case {_STATUS_SQL} when 500 then 'retry' when 429 then 'retry' when 404 then 'never' else 'pass' end as class
    from events
    """,
)
def _(t):
    return t.events.select("event_id", http.retry_class(_status()).alias("class"))


@query(
    "backoff",
    f"""
    select event_id, least(pow(2, n), 30)::double as delay, (2.0 * pow(2, n))::double as fetch_wait,
           case when {_STATUS_SQL} not in (500, 429) then 'as_is' when n + 1 > 3 then 'give_up' else 'retry' end as action
    from (select *, (user_id % 7)::int as n from events)
    """,
)
def _(t):
    n = (F.col("user_id") % 7).cast("int")
    return t.events.select(
        "event_id",
        http.retry_delay(n).alias("delay"),
        http.fetch_backoff(n).alias("fetch_wait"),
        http.retry_plan(_status(), n, 3)["action"].alias("action"),
    )


@query(
    "json_detect",
    r"""
    select 'event' as kind, event_id as id, true as is_json from events
    union all
    select 'document', doc_id, coalesce(regexp_matches(text, '^\s*[\[{]') and json_valid(text), false) from documents
    """,
)
def _(t):
    rows = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("text"))
    rows = rows.unionByName(t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))
    return rows.select("kind", "id", jsonpath.is_json("text").alias("is_json"))


@query(
    "json_path",
    """
    select event_id, (props->>'$.k')::bigint as k, event_type as second, null::varchar as missing from events
    """,
)
def _(t):
    body = F.concat(
        F.lit('{"a":{"b":['), "props", F.lit(',["x","'), "event_type", F.lit('"]]}}')
    )
    v = t.events.select("event_id", jsonpath.parse(body).alias("v"))
    return v.select(
        "event_id",
        jsonpath.get("v", "a.b[0].k", "bigint").alias("k"),
        jsonpath.get("v", "a.b[1][1]", "string").alias("second"),
        jsonpath.get("v", "a.c[0]", "string").alias("missing"),
    )


@query(
    "safe_get",
    "select event_id, (props->>'$.k')::bigint as k, -1::bigint as absent, 'none' as deep from events",
)
def _(t):
    v = t.events.select("event_id", jsonpath.parse("props").alias("v"))
    return v.select(
        "event_id",
        jsonpath.get_or("v", ["k"], 0, "bigint").alias("k"),
        jsonpath.get_or("v", ["missing"], -1, "bigint").alias("absent"),
        jsonpath.get_or("v", ["k", "x"], "none").alias("deep"),
    )


@query(
    "redact_url",
    """
    select page_id, regexp_replace(url, '#.*$', '') || (case when contains(url, '?') then '&' else '?' end) || 'token=&k=1' as safe,
           true as redacted, false as plain_redacted
    from pages
    """,
)
def _(t):
    open_url = F.regexp_replace("url", "^(https?://)", "$1joe:s3cret@")
    open_url = F.concat(
        F.regexp_replace(open_url, "#.*$", ""),
        F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("token=abc%20d&k=1"),
    )
    return t.pages.select(
        "page_id",
        redaction.redact_url(open_url).alias("safe"),
        redaction.holds_secret(open_url).alias("redacted"),
        redaction.holds_secret("url").alias("plain_redacted"),
    )


@query(
    "redact_logs",
    """
    select event_id, 'GET https://a.test/' || event_type || '?token=&k=' || user_id || ' took ' || user_id || ' ms' as line from events
    """,
)
def _(t):
    line = F.concat(
        F.lit("GET https://u:p@a.test/"), "event_type", F.lit("?token=t"), "event_id", F.lit("&k="), "user_id",
        F.lit(" took "), "user_id", F.lit(" ms"),
    )
    return t.events.select("event_id", redaction.redact_text(line).alias("line"))


@query(
    "redact_headers",
    """
    select event_id, case when event_type = 'error' then '[REDACTED]' end as auth,
           'https://ok.test/' as referer, event_type = 'error' as redacted
    from events
    """,
)
def _(t):
    headers = F.when(
        F.col("event_type") == "error",
        F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), "props"), F.lit("Referer"), F.lit("https://ok.test/")),
    ).otherwise(F.create_map(F.lit("Referer"), F.lit("https://ok.test/")))
    safe = t.events.select("event_id", redaction.redact_headers(headers).alias("r"))
    return safe.select(
        "event_id",
        F.try_element_at("r.headers", F.lit("Authorization")).alias("auth"),
        F.try_element_at("r.headers", F.lit("Referer")).alias("referer"),
        "r.redacted",
    )
