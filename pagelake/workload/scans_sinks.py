"""Sources, sinks and stored-table operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import dedup, metrics, paging, upsert
from pagelake.session import epoch_micros
from pagelake.sources import checkpoint, files, pages, store
from pagelake.workload.registry import query

RUN_TS = "2024-06-01 00:00:00"

# The columns of the given tables, as the statistics query must report them.
COLUMNS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
                "l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "pages": "page_id,url,html",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}


@query("src_pages", "select page_id, url, length(html)::bigint as n_chars from pages where length(html) > 0")
def _(t):
    rows = pages.read_pages(t.spark, t.path("pages"))
    return rows.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("src_jsonl", "select event_id, event_type, value, props from events")
def _(t):
    path = t.scratch("jsonl")
    rows = t.events.select("event_id", "event_type", "value", "props")
    files.write_raw_jsonl(rows, path, F.col("event_type"), "20240601")
    back = files.read_jsonl(t.spark, path, "event_id bigint, event_type string, value double, props string")
    return back.select("event_id", "event_type", "value", "props")


@query("src_csv_preview")
def _(t):
    path = t.scratch("csv")
    files.write_csv(t.customer, path)
    return files.read_csv_preview(t.spark, path)


@query(
    "src_union_schema",
    """
    select event_id as id, event_type, value from events
    union all by name select o_orderkey as id, o_orderstatus, o_totalprice as value from orders
    union all by name select doc_id as id, lang from documents
    """,
)
def _(t):
    return files.union_records(
        t.events.select(F.col("event_id").alias("id"), "event_type", "value"),
        t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_totalprice").alias("value")),
        t.documents.select(F.col("doc_id").alias("id"), "lang"),
    )


def _raw(t):
    """Documents as raw records."""
    return t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("site_name"),
        F.concat(F.lit("https://docs.test/"), "doc_id").alias("url"),
        F.when(F.col("lang") == "en", "crawled").otherwise("cleaned").alias("status"),
    )


_RAW_SQL = """
    select doc_id as id, source as site_name, 'https://docs.test/' || doc_id as url,
           case when lang = 'en' then 'crawled' else 'cleaned' end as status from documents
"""


@query(
    "raw_query",
    f"select * from ({_RAW_SQL}) where site_name = 'src1' and status = 'cleaned' order by id desc limit 100 offset 5",
)
def _(t):
    return pages.query_site(_raw(t), "src1", limit=100, offset=5, status="cleaned")


@query(
    "raw_pending",
    f"select * from ({_RAW_SQL}) where site_name = 'src2' and status = 'crawled' order by id desc limit 1000",
)
def _(t):
    return pages.pending_clean(_raw(t), "src2")


@query(
    "cleaned_query",
    "select o_orderkey as id, o_orderstatus as site_name, o_totalprice from orders where o_orderstatus = 'F'"
    " order by o_orderkey desc limit 50 offset 10",
)
def _(t):
    cleaned = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("site_name"), "o_totalprice")
    return pages.query_site(cleaned, "F", limit=50, offset=10)


@query(
    "src_list",
    r"""
    with lines as (
        select doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') as entry
        from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    )
    select entry, min(doc_id) as doc_id from lines where entry <> '' and not starts_with(entry, '#') group by entry
    """,
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return files.text_entries(lines, "line", ["doc_id", "line_no"]).select("entry", "doc_id")


@query(
    "seed_pages",
    """
    select p_partkey, page_no, 'https://shop.test/' || p_partkey || '/list?page=' || page_no as url
    from (select p_partkey, unnest(generate_series(p_size::bigint, p_size::bigint + p_size % 10)) as page_no from part)
    """,
)
def _(t):
    jobs = t.part.select(
        "p_partkey",
        F.concat(F.lit("https://shop.test/"), "p_partkey", F.lit("/list?page={page}")).alias("url_pattern"),
        F.col("p_size").alias("start_page"), (F.col("p_size") % 10 + 1).alias("max_pages"),
    )
    return paging.seeds_of_jobs(jobs).select("p_partkey", "page_no", "url")


@query(
    "seed_distinct",
    "select distinct regexp_replace(url, '[?#].*$', '') as url from pages union select distinct 'https://docs.test/' || source from documents",
)
def _(t):
    both = t.pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url")).unionByName(
        t.documents.select(F.concat(F.lit("https://docs.test/"), "source").alias("url"))
    )
    return files.distinct_seeds(both)


@query(
    "dataset_stats",
    " union all ".join(
        f"select '{name}' as table_name, count(*) as n_rows, {len(cols.split(','))} as n_columns, '{cols}' as columns from {name}"
        for name, cols in COLUMNS.items()
    ),
)
def _(t):
    return metrics.dataset_stats({name: getattr(t, name) for name in COLUMNS})


# --- checkpoints --------------------------------------------------------------------------


@query(
    "ckpt_load",
    """
    select conv_id, page_no, role, n_chars from (
        select conv_id, turn // 2 + 1 as page_no, role, length(text)::bigint as n_chars,
               row_number() over (partition by conv_id, turn // 2 order by turn desc) as rn from conversations
    ) where rn = 1
    """,
)
def _(t):
    page = (F.col("turn") - F.col("turn") % 2) / 2 + 1
    good = F.to_json(
        F.struct(page.cast("bigint").alias("page"), F.array(F.struct("role", "text")).alias("items"))
    )
    # Each valid line is followed by ones that must not count.
    bad = [F.lit("{broken"), F.lit('{"page":0,"items":[]}'), F.lit('{"page":1,"items":["x"]}'), F.lit("")]
    lines = t.conversations.select(
        "conv_id", "turn", F.posexplode(F.array(good, *bad)).alias("k", "value")
    ).select("conv_id", (F.col("turn") * 10 + F.col("k")).alias("line_no"), "value")
    loaded = checkpoint.parse_lines(lines, keep=("conv_id",))
    first = F.get("items", 0)
    return loaded.select(
        "conv_id", "page_no", first["role"].alias("role"), F.length(first["text"]).cast("bigint").alias("n_chars")
    )


@query(
    "ckpt_save",
    """
    select sig, page_no, seq, text from (
        select conv_id as sig, turn // 2 + 1 as page_no, turn as seq, text,
               row_number() over (partition by conv_id, turn // 2 order by role = 'user', turn desc) as rn
        from conversations
    ) where rn = 1
    """,
)
def _(t):
    page = ((F.col("turn") - F.col("turn") % 2) / 2 + 1).cast("bigint")
    rows = t.conversations.select(F.col("conv_id").alias("sig"), page.alias("page_no"), F.col("turn").alias("seq"), "text", "role")
    old = rows.filter("role = 'user'").drop("role")
    new = rows.filter("role <> 'user'").drop("role")
    return upsert.merge_checkpoint(old, new, "seq")


@query(
    "resume_plan",
    """
    select conv_id as sig, turn as page_no, case when role = 'user' then 'reuse' else 'fetch' end as action from conversations
    """,
)
def _(t):
    planned = t.conversations.select(F.col("conv_id").alias("sig"), F.col("turn").alias("page_no"))
    done = t.conversations.filter("role = 'user'").select(F.col("conv_id").alias("sig"), F.col("turn").alias("page_no"))
    return paging.resume_plan(planned, done)


# --- upserts and appends ------------------------------------------------------------------


def _customer_url(key):
    return F.concat(F.lit("https://shop.test/c/"), key)


def customer_records(t):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.lit("shop").alias("site_name"), _customer_url("c_custkey").alias("url"),
        F.md5(_customer_url("c_custkey")).alias("url_hash"), F.col("c_name").alias("raw_data"),
        F.lit("cleaned").alias("status"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def order_records(t):
    return t.orders.select(
        F.lit("shop").alias("site_name"), _customer_url("o_custkey").alias("url"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), "o_orderstatus").alias("raw_data"), "o_orderkey",
    )


_RAW_UPSERT_SQL = """
    with last as (
        select o_custkey, max(o_orderkey) as k, arg_max(o_orderkey || '/' || o_orderstatus, o_orderkey) as raw
        from orders group by o_custkey
    )
    select c_custkey as id, 'shop' as site_name, 'https://shop.test/c/' || coalesce(c_custkey, o_custkey) as url,
           md5('https://shop.test/c/' || coalesce(c_custkey, o_custkey)) as url_hash, coalesce(raw, c_name) as raw_data,
           case when o_custkey is null then 'cleaned' else 'crawled' end as status,
           case when c_custkey is null then '2024-06-01' else '2024-01-01' end as created,
           case when o_custkey is null then '2024-01-01' else '2024-06-01' end as updated
    from customer full join last on c_custkey = o_custkey
"""


def _days(df):
    return df.select(
        "id", "site_name", "url", "url_hash", "raw_data", "status",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query("raw_upsert", _RAW_UPSERT_SQL)
def _(t):
    return _days(upsert.raw_upsert(customer_records(t), order_records(t), "o_orderkey", RUN_TS))


@query("store_upsert", _RAW_UPSERT_SQL)
def _(t):
    """The same through a stored table: saved, then changed by a second batch."""
    table = store.TableStore(t.spark, t.scratch("store"), buckets=4)
    table.load(customer_records(t))
    table.save(order_records(t), "o_orderkey", RUN_TS)
    return _days(table.read())


@query(
    "cleaned_upsert",
    """
    with last as (
        select o_custkey, arg_max(o_orderkey, o_orderkey) as k, arg_max(o_totalprice, o_orderkey) as price from orders group by o_custkey
    )
    select 'shop' as site_name, 'https://shop.test/c/' || coalesce(c_custkey, o_custkey) as url,
           case when c_custkey is null then '2024-06-01' else '2024-01-01' end as cleaned,
           c_name, coalesce(k, c_custkey) as item_no, price as total_price
    from customer full join last on c_custkey = o_custkey
    """,
)
def _(t):
    existing = t.customer.select(
        F.lit("shop").alias("site_name"), _customer_url("c_custkey").alias("url"),
        F.md5(_customer_url("c_custkey")).alias("url_hash"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("cleaned_at"), "c_name", F.col("c_custkey").alias("item_no"),
    )
    batch = t.orders.select(
        F.lit("shop").alias("site_name"), _customer_url("o_custkey").alias("url"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").alias("item-no"), F.col("o_totalprice").alias("Total Price"),
        F.lit("x").alias("cleaned_at"),
    )
    merged = upsert.cleaned_upsert(existing, batch, "seq", RUN_TS)
    return merged.select(
        "site_name", "url", F.date_format("cleaned_at", "yyyy-MM-dd").alias("cleaned"), "c_name", "item_no", "total_price"
    )


@query(
    "schema_evolve",
    """
    select c_custkey as id, c_name as name, c_mktsegment as segment from customer
    union all by name select s_suppkey as id, s_name as name, s_acctbal as balance from supplier
    """,
)
def _(t):
    return upsert.evolve(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    )


@query(
    "idempotent_append",
    """
    select text, lang, source from documents
    except select text, lang, source from documents join labels using (doc_id) where quality = 1
    """,
)
def _(t):
    rows = t.documents.select("text", "lang", "source")
    stored = t.documents.join(t.labels.filter("quality = 1"), "doc_id").select("text", "lang", "source")
    return upsert.idempotent_append(stored, rows)


@query(
    "append_lineitem",
    """
    select l_partkey::varchar as l_partkey, l_returnflag, l_linestatus from lineitem
    except select l_partkey::varchar, l_returnflag, 'O' from lineitem where l_linestatus = 'O'
    """,
)
def _(t):
    """Into a stored table: what the second append brings is read back."""
    rows, path = t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus"), t.scratch("items")
    store.append_new(t.spark, rows.filter("l_linestatus = 'O'"), path)
    store.append_new(t.spark, rows, path)
    return store.appended(t.spark, path, last=True)


@query(
    "raw_set_status",
    """
    select r.id, r.site_name, case when l.doc_id is null then r.status when l.quality = 1 then 'done' else 'failed' end as status,
           l.doc_id is not null as touched
    from (select doc_id as id, source as site_name, case when lang = 'en' then 'crawled' else 'cleaned' end as status from documents) r
    left join labels l on l.doc_id = r.id
    """,
)
def _(t):
    raw = _raw(t).withColumns(
        {"url_hash": F.md5("url"), "updated_at": F.lit("2024-01-01 00:00:00").cast("timestamp")}
    )
    updates = t.labels.select(
        F.md5(F.concat(F.lit("https://docs.test/"), "doc_id")).alias("url_hash"),
        F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"), F.col("doc_id").alias("v"),
    )
    out = upsert.set_status(raw, updates, "v", RUN_TS)
    return out.select("id", "site_name", "status", (F.month("updated_at") == 6).alias("touched"))


@query(
    "key_audit",
    "select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def _(t):
    return upsert.key_audit(t.lineitem, ["l_orderkey", "l_partkey"])


# --- sinks, read back ---------------------------------------------------------------------


@query("sink_jsonl", "select event_type as site, '20240601' as day, count(*) as n, max(event_id) as last from events group by 1")
def _(t):
    path = t.scratch("jsonl")
    files.write_raw_jsonl(t.events.select("event_id", "event_type", "props"), path, F.col("event_type"), "20240601")
    back = t.spark.read.schema("event_id bigint, site string, dt string").json(path)
    return back.groupBy("site", F.col("dt").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("sink_parquet", "select doc_id, text, lang, source, n_chars from documents")
def _(t):
    path = t.scratch("parquet")
    files.write_parquet(t.documents, path, ["lang"])
    return t.spark.read.parquet(path).select("doc_id", "text", "lang", "source", "n_chars")


@query("sink_csv", "select c_custkey, c_name, c_mktsegment from customer")
def _(t):
    path = t.scratch("csv")
    files.write_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path)
    return t.spark.read.schema("c_custkey bigint, c_name string, c_mktsegment string").option("header", True).csv(path)


@query("log_append", "select event_type as task_id, count(*) as n, max(epoch_us(ts)) as last from events group by 1")
def _(t):
    path = t.scratch("logs")
    files.append_logs(
        t.events.select(F.col("event_type").alias("task_id"), epoch_micros("ts").alias("created_at"), F.col("props").alias("text")), path, "20240601"
    )
    back = t.spark.read.parquet(path)
    return back.groupBy("task_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))


@query(
    "latest_wins",
    """
    select event_type, user_id, event_id, value from (
        select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as rn from events
    ) where rn = 1
    """,
)
def _(t):
    rows = t.events.select("event_type", "user_id", "event_id", "value", "ts")
    return dedup.latest_wins(rows, ["event_type", "user_id"], ["ts", "event_id"]).drop("ts")
