"""Metrics, alerts, ledgers and frontier over the given tables.

Events stand for requests (kind = site, value = latency, user = proxy), orders for tasks
and frontier entries, line items for task pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import alerts, frontier, ledger, metrics, ordered, proxies
from pagelake.session import epoch_micros
from pagelake.workload.registry import query

ERROR = "警告: restart"


# --- metrics ------------------------------------------------------------------------------


@query("raw_count", "select source as site_name, lang as status, count(*) as n from documents group by 1, 2")
def _(t):
    return metrics.count_by(t.documents.withColumnsRenamed({"source": "site_name", "lang": "status"}), "site_name", "status")


@query(
    "m_requests",
    "select event_type as site, case when event_type = 'error' then 500 else 200 end as status_code, count(*) as n from events group by 1, 2",
)
def _(t):
    rows = t.events.select(
        F.col("event_type").alias("site"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code")
    )
    return metrics.count_by(rows, "site", "status_code")


@query(
    "m_requests_rollup",
    "select event_type as site, count(*) as n, 0 as is_total from events group by 1 union all select null, count(*), 1 from events",
)
def _(t):
    return metrics.requests_rollup(t.events.withColumnRenamed("event_type", "site"))


@query(
    "m_latency_hist",
    """
    select event_type as site, le, count_if(le = '+Inf' or value <= try_cast(le as double))::bigint as n,
           count(*) as total, round(sum(value), 4) as sum_latency
    from events, (select unnest(['0.1', '0.5', '1.0', '2.0', '5.0', '10.0', '30.0', '+Inf']) as le) group by 1, 2
    """,
)
def _(t):
    out = metrics.latency_histogram(t.events.withColumnsRenamed({"event_type": "site", "value": "latency"}))
    return out.withColumn("sum_latency", F.round("sum_latency", 4))


@query(
    "m_counters",
    """
    select user_id, count_if(event_type = 'purchase')::bigint as scraped, count_if(event_type = 'view')::bigint as cleaned,
           count_if(event_type = 'error')::bigint as errors, count_if(event_type = 'error' and value > 30)::bigint as timeouts
    from events group by 1
    """,
)
def _(t):
    e = F.col("event_type")
    kinds = {
        "scraped": e == "purchase", "cleaned": e == "view", "errors": e == "error",
        "timeouts": (e == "error") & (F.col("value") > 30),
    }
    return metrics.counters(t.events, kinds, "user_id")


@query("m_gauges", "select event_type as site, arg_max(value, (ts, event_id)) as value from events group by 1")
def _(t):
    return metrics.gauges(t.events.withColumnRenamed("event_type", "site"), "value", ["ts", "event_id"], "site")


@query(
    "success_rate",
    "select user_id::varchar as site, round(avg(case when event_type <> 'error' then 1.0::double else 0 end), 6) as rate, count(*) as n from events group by 1",
)
def _(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("site"), "event_type")
    return metrics.success_rate(rows, F.col("event_type") != "error").withColumn("rate", F.round("rate", 6))


@query(
    "alerts",
    """
    with rates as (select user_id::varchar as site, avg(case when event_type <> 'error' then 1.0::double else 0 end) as rate, count(*) as n from events group by 1),
    sizes as (select o_orderpriority as site, count(*) as size from orders where o_orderstatus = 'O' group by 1)
    select 'low_success' as kind, 'critical' as level, site, round(rate, 6) as value, 'low_success_' || site as dedup_key from rates where rate < 0.8
    union all
    select 'queue_backlog', 'warning', site, size::double, 'queue_backlog_' || site from sizes where size > 100
    union all
    select 'proxy_exhausted', 'critical', null, 0, 'proxy_exhausted' from (select count(*) as c from supplier where s_acctbal > 1e9) where c = 0
    """,
)
def _(t):
    rates = metrics.success_rate(
        t.events.select(F.col("user_id").cast("string").alias("site"), "event_type"), F.col("event_type") != "error"
    )
    sizes = t.orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("site")).agg(F.count("*").alias("size"))
    alive = t.supplier.filter("s_acctbal > 1e9").agg(F.count("*").alias("available"))
    rows = alerts.low_success(rates).unionByName(alerts.queue_backlog(sizes, 100)).unionByName(alerts.proxy_exhausted(alive))
    return rows.withColumn("value", F.round("value", 6))


@query(
    "proxy_health",
    """
    select user_id as proxy, count(*) as checks, round(avg(case when event_type <> 'error' then 1.0::double else 0 end), 6) as alive_share,
           round(avg(value) filter (event_type <> 'error'), 6) as avg_speed
    from events group by 1
    """,
)
def _(t):
    checks = t.events.select(
        F.col("user_id").alias("proxy"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed")
    )
    out = proxies.health(checks)
    return out.withColumns({c: F.round(c, 6) for c in ("alive_share", "avg_speed")})


@query(
    "proxy_anonymity",
    "select event_id, case event_type when 'view' then 'anonymous' when 'error' then 'unknown' else 'elite' end as anonymity from events",
)
def _(t):
    e = F.col("event_type")
    headers = F.when(e == "view", F.create_map(F.lit("Via"), "props")).otherwise(F.create_map(F.lit("Accept"), "props"))
    error = F.when(e == "error", F.lit("timeout"))
    return t.events.select("event_id", proxies.anonymity(headers, error).alias("anonymity"))


@query(
    "run_summary",
    "select count(*) as n_items, 6 as n_fields, (max(epoch_us(ts)) // 1000000 - min(epoch_us(ts)) // 1000000)::double as elapsed from events",
)
def _(t):
    seconds = F.floor(epoch_micros("ts") / 1_000_000)
    span = t.events.agg((F.max(seconds) - F.min(seconds)).cast("double").alias("elapsed"))
    summary = metrics.run_summary(t.events, t.events.columns, 0.0, 0.0).drop("elapsed")
    # Both sides are one row.
    return summary.join(F.broadcast(span))


# --- task ledger --------------------------------------------------------------------------

_PAGES_SQL = """
    select l_orderkey as task_id, l_linenumber as page_no, l_partkey as updated_at,
           case l_returnflag when 'R' then 'failed' when 'A' then 'completed' else case l_linestatus when 'O' then 'reused' else 'running' end end as status,
           case when l_returnflag = 'R' then 0 else l_quantity::bigint end as item_count
    from lineitem
"""


def _task_pages(t):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return t.lineitem.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("page_no"), F.col("l_partkey").alias("updated_at"),
        F.when(flag == "R", "failed").when(flag == "A", "completed").when(line == "O", "reused").otherwise("running").alias("status"),
        F.when(flag == "R", 0).otherwise(F.col("l_quantity").cast("bigint")).cast("bigint").alias("item_count"),
    )


_TASKS_SQL = """
    select o_orderkey as task_id, 'task ' || o_custkey as name, epoch_us(o_orderdate) / 1000000.0::double as created_at,
           case o_orderpriority when '1-URGENT' then 'running' when '2-HIGH' then 'completed' when '3-MEDIUM' then 'failed'
                when '5-LOW' then 'pending' else 'partial' end as status,
           case when o_orderstatus = 'F' then '{"pagination":{"type":"url_pattern"}}' when o_orderstatus = 'O' then '{"_checkpoint_scope":"s1"}' else 'bad' end as config_json,
           o_orderstatus = 'P' as has_redacted_secrets
    from orders
"""


def _tasks(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("task_id"), F.concat(F.lit("task "), "o_custkey").alias("name"),
        (epoch_micros("o_orderdate") / F.lit(1000000.0)).alias("created_at"),
        F.when(p == "1-URGENT", "running").when(p == "2-HIGH", "completed").when(p == "3-MEDIUM", "failed")
        .when(p == "5-LOW", "pending").otherwise("partial").alias("status"),
        F.when(s == "F", '{"pagination":{"type":"url_pattern"}}').when(s == "O", '{"_checkpoint_scope":"s1"}')
        .otherwise("bad").alias("config_json"),
        (s == "P").alias("has_redacted_secrets"),
    )


_STATS_SQL = f"""
    select task_id, count(*) as total_pages, count_if(status = 'failed')::bigint as failed_pages,
           count_if(status in ('completed', 'empty', 'reused'))::bigint as done_pages
    from ({_PAGES_SQL}) group by 1
"""


@query("task_page_stats", _STATS_SQL)
def _(t):
    return ledger.page_stats(_task_pages(t))


@query(
    "task_status",
    f"""
    select p.task_id, failed_pages, item_count, case when o_orderstatus = 'P' then 'cancelled' when failed_pages > 0 and item_count = 0 then 'failed'
           when failed_pages > 0 then 'partial' else 'completed' end as status
    from (select task_id, count_if(status = 'failed')::bigint as failed_pages, sum(item_count)::bigint as item_count from ({_PAGES_SQL}) group by 1) p
    left join orders on o_orderkey = p.task_id
    """,
)
def _(t):
    cancelled = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("task_id"))
    return ledger.task_status(_task_pages(t), cancelled)


_FLAGS_SQL = f"""
    select *, status in ('completed', 'partial', 'failed') as terminal, status in ('pending', 'running') as can_cancel,
           status in ('partial', 'failed') and not has_redacted_secrets as can_retry,
           case when contains(config_json, 'url_pattern') then 'resume_pages' else 'rerun' end as retry_action
    from ({_TASKS_SQL})
"""


@query("task_flags", _FLAGS_SQL)
def _(t):
    return ledger.task_flags(_tasks(t))


@query(
    "task_summary",
    f"""
    select f.task_id, status, terminal, can_retry, coalesce(total_pages, 0) as total_pages, coalesce(failed_pages, 0) as failed_pages,
           coalesce(done_pages, 0) as done_pages
    from ({_FLAGS_SQL}) f left join ({_STATS_SQL}) s on s.task_id = f.task_id
    """,
)
def _(t):
    return ledger.task_summary(_tasks(t), _task_pages(t)).select(
        "task_id", "status", "terminal", "can_retry", "total_pages", "failed_pages", "done_pages"
    )


@query("tasks_recent", f"select task_id, status, created_at from ({_TASKS_SQL}) order by created_at desc, task_id limit 50")
def _(t):
    return ledger.tasks_recent(_tasks(t)).select("task_id", "status", "created_at")


@query("log_tail", "select event_id as id, props as text from events order by event_id desc limit 1000")
def _(t):
    return ledger.log_tail(t.events.select(F.col("event_id").alias("id"), F.col("props").alias("text")))


@query("preview", "select * from orders order by o_totalprice desc, o_orderkey limit 200")
def _(t):
    return ledger.preview(t.orders, [F.desc("o_totalprice"), "o_orderkey"])


@query("item_cap", "select page_id, url from pages order by page_id limit 25")
def _(t):
    return ordered.page_of(t.pages.select("page_id", "url"), ["page_id"], 25)


@query(
    "task_evict",
    f"""
    select task_id, status from (
        select *, row_number() over (partition by status in ('completed', 'partial', 'failed') order by created_at, task_id) as rn,
               count(*) over () as n
        from ({_TASKS_SQL})
    ) where status not in ('completed', 'partial', 'failed') or rn > n - 8000
    """,
)
def _(t):
    return ledger.evict_terminal(_tasks(t), keep=8000).select("task_id", "status")


@query(
    "ledger_sweep",
    f"""
    select p.task_id, page_no, case when p.status = 'running' and t.status in ('running', 'pending') then 'interrupted' else p.status end as status,
           case when t.status in ('running', 'pending') then 'interrupted' else t.status end as task_status,
           case when t.status in ('running', 'pending') then coalesce(case when t.status = 'pending' then 'early' end, '{ERROR}') end as error
    from ({_PAGES_SQL}) p join ({_TASKS_SQL}) t on t.task_id = p.task_id
    """,
)
def _(t):
    tasks = _tasks(t).withColumns(
        {"ended_at": F.lit(None).cast("double"), "error": F.when(F.col("status") == "pending", "early")}
    )
    swept, pages = ledger.restart_sweep(tasks, _task_pages(t), 1.0, ERROR)
    return pages.join(swept.select("task_id", F.col("status").alias("task_status"), "error"), "task_id").select(
        "task_id", "page_no", "status", "task_status", "error"
    )


@query(
    "page_status_upsert",
    """
    select task_id, page_no, status, error from (
        select l_suppkey as task_id, l_linenumber as page_no, l_returnflag as status, nullif(l_linestatus, 'O') as error,
               row_number() over (partition by l_suppkey, l_linenumber order by l_shipdate desc, l_orderkey desc, l_partkey desc) as rn
        from lineitem
    ) where rn = 1
    """,
)
def _(t):
    reports = t.lineitem.select(
        F.col("l_suppkey").alias("task_id"), F.col("l_linenumber").alias("page_no"), F.col("l_returnflag").alias("status"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("error"),
        "l_shipdate", "l_orderkey", "l_partkey",
    )
    out = ledger.page_status_upsert(reports, ["l_shipdate", "l_orderkey", "l_partkey"])
    return out.select("task_id", "page_no", "status", "error")


@query(
    "task_detail",
    f"""
    select task_id, task_status, part, seq, status, text from (
        select t.task_id, t.status as task_status, 'page' as part, page_no::bigint as seq, p.status, null::varchar as text
        from ({_TASKS_SQL}) t join ({_PAGES_SQL}) p on p.task_id = t.task_id
        union all
        select t.task_id, t.status, 'log', event_id, null, props from ({_TASKS_SQL}) t join (
            select *, row_number() over (partition by user_id order by event_id desc) as rn from events
        ) e on e.user_id = t.task_id where rn <= 1000
    )
    """,
)
def _(t):
    logs = t.events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("id"), F.col("props").alias("text"))
    pages = _task_pages(t).withColumn("error", F.lit(None).cast("string"))
    return ledger.task_detail(_tasks(t), pages, logs)


@query(
    "retry_plan",
    f"""
    select substr(sha1('run1/' || task_id), 1, 12) as task_id, task_id as parent_task_id, 'pending' as status, true as resume,
           case when contains(config_json, '_checkpoint_scope') then 's1' else task_id::varchar end as checkpoint_scope,
           case when contains(config_json, 'url_pattern') then 'resume_pages' else 'rerun' end as retry_action, config_json
    from ({_TASKS_SQL}) where status in ('partial', 'failed') and not has_redacted_secrets
    """,
)
def _(t):
    return ledger.retry_plan(_tasks(t), "run1")


_TRANSITIONS_SQL = """
    with e as (
        select user_id as task_id, event_id as seq,
               case event_type when 'error' then 'cancel' when 'signup' then 'insert' else 'update' end as event,
               case event_type when 'signup' then 'pending' when 'click' then 'running' when 'view' then 'completed' when 'purchase' then 'failed' end as status
        from events
    ), b as (
        select *, last_value(status ignore nulls) over (partition by task_id order by seq) as before from e
    )
"""


def _task_events(t):
    kind = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "cancel").when(kind == "signup", "insert").otherwise("update").alias("event"),
        F.when(kind == "click", "running").when(kind == "view", "completed").when(kind == "purchase", "failed").alias("status"),
    )


def _users(t):
    return t.events.select(F.col("user_id").alias("task_id")).distinct().withColumn("status", F.lit("completed"))


@query(
    "task_transitions",
    _TRANSITIONS_SQL
    + """
    select task_id, case when before in ('pending', 'running') and event = 'cancel' then 'cancelling' else coalesce(before, 'completed') end as status
    from b where seq in (select max(seq) from b group by task_id)
    """,
)
def _(t):
    after, _refused = ledger.task_transitions(_users(t), _task_events(t), rows=1000)
    return after.select("task_id", "status")


@query(
    "task_refused",
    _TRANSITIONS_SQL
    + """
    select task_id, seq, coalesce(before, 'completed') as status_then from b
    where event = 'cancel' and coalesce(before, 'completed') not in ('pending', 'running')
    """,
)
def _(t):
    _after, refused = ledger.task_transitions(_users(t), _task_events(t), rows=1000)
    return refused


@query(
    "update_task",
    """
    select o_orderkey as task_id, coalesce(s, 'running') as status, coalesce(q, 0)::bigint as item_count, o_custkey as owner
    from orders left join (
        select l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey)) filter (l_returnflag <> 'N') as s,
               arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey)) as q
        from lineitem group by 1
    ) on l_orderkey = o_orderkey
    """,
)
def _(t):
    tasks = t.orders.select(
        F.col("o_orderkey").alias("task_id"), F.lit("running").alias("status"), F.lit(0).cast("bigint").alias("item_count"),
        F.col("o_custkey").alias("owner"),
    )
    updates = t.lineitem.select(
        F.col("l_orderkey").alias("task_id"), F.nullif("l_returnflag", F.lit("N")).alias("status"),
        F.col("l_quantity").cast("bigint").alias("item_count"), F.lit(-1).cast("bigint").alias("owner"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("v"),
    )
    return ledger.update_task(tasks, updates, "v")


@query(
    "clean_queue",
    """
    select o_orderkey as raw_id, coalesce(s, 'pending') as status, coalesce(n, 0)::bigint as retry_count
    from orders left join (
        select l_orderkey, arg_max(case l_returnflag when 'R' then 'failed' when 'A' then 'done' else 'processing' end, (l_shipdate, l_linenumber, l_partkey)) as s,
               count_if(l_returnflag = 'R') as n
        from lineitem group by 1
    ) on l_orderkey = o_orderkey
    """,
)
def _(t):
    flag = F.col("l_returnflag")
    events = t.lineitem.select(
        F.col("l_orderkey").alias("raw_id"), F.when(flag == "R", "failed").when(flag == "A", "done").otherwise("processing").alias("status"),
        "l_shipdate", "l_linenumber", "l_partkey",
    )
    return ledger.clean_queue(t.orders.select(F.col("o_orderkey").alias("raw_id")), events, ["l_shipdate", "l_linenumber", "l_partkey"])


@query("retry_giveup", "select l_partkey as url, count(*) as attempts, count(*) > 30 as gave_up from lineitem group by 1")
def _(t):
    return ledger.retry_giveup(t.lineitem.withColumnRenamed("l_partkey", "url"), max_retries=30)


# --- frontier -----------------------------------------------------------------------------

_FRONTIER_SQL = """
    select md5('https://shop.test/o/' || o_orderkey) as url_hash, 'https://shop.test/o/' || o_orderkey as url, o_orderstatus as site,
           ascii(o_orderpriority) - 48 as priority, o_custkey % 3 as depth, epoch_us(o_orderdate) / 1000000.0::double as created_at,
           case when o_orderpriority in ('1-URGENT', '5-LOW') then 'processing' else 'queued' end as state
    from orders
"""


def _frontier(t):
    url = F.concat(F.lit("https://shop.test/o/"), "o_orderkey")
    return t.orders.select(
        F.md5(url).alias("url_hash"), url.alias("url"), F.col("o_orderstatus").alias("site"),
        (F.ascii("o_orderpriority") - 48).alias("priority"), (F.col("o_custkey") % 3).alias("depth"),
        F.lit(None).cast("map<string,string>").alias("meta"), (epoch_micros("o_orderdate") / F.lit(1000000.0)).alias("created_at"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), "processing").otherwise("queued").alias("state"),
    )


@query(
    "frontier_admit",
    """
    select 'https://shop.test/p/' || l_partkey as url, min(l_orderkey) as first_order, 0 as priority, 'queued' as state
    from lineitem where l_partkey not in (select p_partkey from part where p_size < 25) group by l_partkey
    """,
)
def _(t):
    def url(c):
        return F.concat(F.lit("https://shop.test/p/"), c)

    batch = t.lineitem.select(url("l_partkey").alias("url"), F.col("l_orderkey").alias("first_order"), "l_linenumber", "l_suppkey")
    seen = t.part.filter("p_size < 25").select(F.md5(url("p_partkey")).alias("url_hash"))
    out = frontier.admit(batch, seen, ["first_order", "l_linenumber", "l_suppkey"], 1.0)
    return out.select("url", "first_order", "priority", "state")


def _next_sql(order: str) -> str:
    return f"""
        select site, url from (
            select *, row_number() over (partition by site order by {order}) as rn from ({_FRONTIER_SQL}) where state = 'queued'
        ) where rn <= 20
    """


@query(
    "frontier_next",
    f"""
    select 'fifo' as mode, * from ({_next_sql('created_at, url_hash')})
    union all select 'lifo', * from ({_next_sql('created_at desc, url_hash desc')})
    union all select 'priority', * from ({_next_sql("priority desc, url || chr(34) desc")})
    """,
)
def _(t):
    out = None
    for mode in ("fifo", "lifo", "priority"):
        part = frontier.next_tasks(_frontier(t), mode, 20).select(F.lit(mode).alias("mode"), "site", "url")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "frontier_apply",
    f"""
    with e as (
        select md5('https://shop.test/o/' || l_orderkey) as url_hash,
               arg_max(case l_returnflag when 'R' then 'fail' when 'A' then 'complete' else 'pop' end, (l_shipdate, l_linenumber, l_partkey)) as event,
               count_if(l_returnflag = 'R')::int as fails
        from lineitem group by l_orderkey
    )
    select f.url, case when fails > 0 then greatest(priority - fails, 0) else priority end as priority,
           case event when 'fail' then 'queued' when 'pop' then 'processing' else state end as state
    from ({_FRONTIER_SQL}) f left join e using (url_hash) where event is null or event <> 'complete'
    """,
)
def _(t):
    flag = F.col("l_returnflag")
    events = t.lineitem.select(
        F.md5(F.concat(F.lit("https://shop.test/o/"), "l_orderkey")).alias("url_hash"),
        F.when(flag == "R", "fail").when(flag == "A", "complete").otherwise("pop").alias("event"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("seq"),
    )
    return frontier.apply_events(_frontier(t), events).select("url", "priority", "state")


@query(
    "frontier_recover",
    f"""
    select url, case when state = 'processing' and created_at < 900000000 - 300 then 'queued' else state end as state,
           state = 'processing' and created_at < 900000000 - 300 as recovered
    from ({_FRONTIER_SQL}) where not (state = 'processing' and depth = 2)
    """,
)
def _(t):
    # A task whose creation time cannot be read is dropped while in work.
    lost = (F.col("depth") == 2) & (F.col("state") == "processing")
    rows = _frontier(t).withColumn("created_at", F.when(~lost, F.col("created_at")))
    return frontier.recover_stuck(rows, 900_000_000.0).select("url", "state", "recovered")


@query("frontier_sizes", f"select site, state, count(*) as n from ({_FRONTIER_SQL}) group by 1, 2")
def _(t):
    return frontier.sizes(_frontier(t))


@query("frontier_clear", f"select url, site from ({_FRONTIER_SQL}) where site <> 'F'")
def _(t):
    return frontier.clear(_frontier(t), ["F"]).select("url", "site")


@query(
    "union_all",
    "select o_orderkey as id, 'order' as kind, o_custkey as ref from orders union all select l_orderkey, 'line', l_partkey from lineitem"
    " union all select event_id, 'event', null from events",
)
def _(t):
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_custkey").alias("ref"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind"), F.col("l_partkey").alias("ref"))
    events = t.events.select(F.col("event_id").alias("id"), F.lit("event").alias("kind"))
    return orders.unionByName(lines).unionByName(events, allowMissingColumns=True)
