"""Streaming forms over the given tables: files in, all that is there, results on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.session import epoch_micros
from pagelake.sources.intake import stream_files
from pagelake.sources.seeds import stream_seeds
from pagelake.sources.store import TableStore
from pagelake.streaming import flows
from pagelake.workload.registry import query

RUN_TS = "2024-06-01 00:00:00"


def _stream(t, name):
    # As a pattern, so that a table of one file and a folder of files both serve as a stream.
    return stream_files(t.spark, t.path(name) + "*", getattr(t, name).schema)


def _landed(t, stream):
    """Run an append stream to its end; the result is on shared files."""
    return flows.drain_to_files(stream, t.scratch("out"), t.scratch("ckpt"))


@query("stream_intake", "select event_type, count(*) as n, max(event_id) as last from events group by 1")
def _(t):
    rows = _landed(t, _stream(t, "events").select("event_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("stream_seeds", "select url as seed, count(*) as n from pages group by 1")
def _(t):
    """URLs appended to a seed list between two runs of one stream; the second takes up where the first stopped."""
    folder, out, ckpt = t.scratch("seeds"), t.scratch("out"), t.scratch("ckpt")
    for rest in (0, 1):
        t.pages.filter(F.col("page_id") % 2 == rest).select("url").write.mode("append").text(folder)
        taken = flows.drain_to_files(stream_seeds(t.spark, folder, part_bytes=1 << 16), out, ckpt)
    return taken.groupBy("seed").agg(F.count("*").alias("n"))


@query(
    "stream_clean",
    r"""
    select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text, lang, regexp_replace(source, '^src', 'S') as source
    from documents where n_chars >= 300 or lang <> 'en'
    """,
)
def _(t):
    rules = {
        lang: ([{"type": "filter", "condition": "n_chars >= 300"}] if lang == "en" else [])
        + [{"type": "replace", "source": "source", "pattern": "^src", "replacement": "S"}]
        for lang in ("en", "fr", "de", "es")
    }
    return _landed(t, flows.clean(_stream(t, "documents"), rules, "lang")).select("doc_id", "text", "lang", "source")


@query("stream_dedup", "select distinct md5('https://u.test/' || user_id) as url_hash from events")
def _(t):
    rows = _stream(t, "events").select(
        F.concat(F.lit("https://U.test/"), "user_id").alias("url"), F.timestamp_micros(epoch_micros("ts")).alias("at")
    )
    return _landed(t, flows.dedup(rows, "url", "at", "60 days")).select("url_hash")


@query(
    "stream_metrics",
    """
    with w as (
        select epoch_us(ts) // 3600000000 * 3600000000 as w, event_type, value, event_type <> 'error' as ok from events
    )
    select w as window_us, event_type, count(*) as requests, round(avg(case when ok then 1.0::double else 0 end), 6) as rate,
           count_if(value <= 5)::bigint as le_5
    from w where w + 3600000000 <= (select max(epoch_us(ts)) - 60000000 from events) group by 1, 2
    """,
)
def _(t):
    """Hourly windows that the watermark has closed; what is still open at the end is not out yet."""
    rows = _stream(t, "events").select(F.timestamp_micros(epoch_micros("ts")).alias("at"), "event_type", "value")
    out = flows.windowed_metrics(rows, "at", "event_type", F.col("event_type") != "error", "value", window="1 hour")
    return _landed(t, out).select(
        F.unix_micros("window_start").alias("window_us"), "event_type", "requests", F.round("rate", 6).alias("rate"),
        F.col("le_5_0").alias("le_5"),
    )


@query(
    "stream_throttle",
    """
    with recursive keyed as (select event_id, event_type as k, epoch_us(ts) as t from events),
    chain as (
        select a.event_id, b.event_id as next_id
        from (select *, t + 7200000000 as due from keyed) a asof left join (select * from keyed) b on a.k = b.k and a.due <= b.t
    ), passed as (
        select event_id, next_id from chain where event_id in (select arg_min(event_id, (t, event_id)) from keyed group by k)
        union all select c.event_id, c.next_id from passed p join chain c on c.event_id = p.next_id
    )
    select event_id from passed
    """,
)
def _(t):
    rows = _stream(t, "events").select("event_id", "event_type", epoch_micros("ts").alias("t"))
    out = flows.throttle(rows, "event_type", "t", "event_id", 7_200_000_000)
    return _landed(t, out).select(F.col("id").alias("event_id"))


@query(
    "stream_stuck",
    """
    with steps as (
        select user_id, event_type in ('view', 'click') as is_pop, epoch_us(ts) // 1000 as t from events
    ), followed as (
        select *, lead(t) over (partition by user_id order by t, is_pop) as next from steps
    )
    select user_id::varchar as task, t as popped_ms from followed
    where is_pop and coalesce(next - t >= 43200000, t + 43200000 <= (select max(t) - 60000 from steps))
    """,
)
def _(t):
    """Views and clicks after which a user did nothing for twelve hours, as far as the stream can tell at its end."""
    rows = _stream(t, "events").select(
        "user_id", F.when(F.col("event_type").isin("view", "click"), "pop").otherwise("complete").alias("event"),
        F.timestamp_micros(epoch_micros("ts")).alias("at"),
    )
    out = _landed(t, flows.stuck_since(rows, "user_id", "event", "at", 43_200_000))
    return out.select("task", F.unix_millis("popped_at").alias("popped_ms"))


@query(
    "stream_upsert",
    """
    select event_type as site_name, md5('https://u.test/' || user_id) as url_hash, arg_max(props, event_id) as raw_data
    from events group by event_type, user_id
    """,
)
def _(t):
    store = TableStore(t.spark, t.scratch("store"), buckets=4)
    rows = _stream(t, "events").select(
        F.col("event_type").alias("site_name"), F.concat(F.lit("https://u.test/"), "user_id").alias("url"),
        F.col("props").alias("raw_data"), "event_id",
    )
    flows.drain(flows.upsert_sink(rows, store, "event_id", RUN_TS, t.scratch("ckpt")))
    return store.read().select("site_name", "url_hash", "raw_data")


@query(
    "stream_archive",
    """
    select 'archive' as place, count(*) as n from documents
    union all select 'table', count(distinct (source, text)) from documents
    """,
)
def _(t):
    path, store = t.scratch("raw"), TableStore(t.spark, t.scratch("store"), buckets=4)
    rows = _stream(t, "documents").select(
        F.col("source").alias("site_name"), F.concat(F.lit("https://d.test/"), F.md5("text")).alias("url"),
        F.col("text").alias("raw_data"), "doc_id",
    )
    flows.drain(flows.archive_sink(rows, path, store, "doc_id", "site_name", "20240601", RUN_TS, t.scratch("ckpt")))
    archive = t.spark.read.schema("doc_id bigint").json(f"{path}/batch=*")
    return archive.agg(F.count("*").alias("n")).select(F.lit("archive").alias("place"), "n").unionByName(
        store.read().agg(F.count("*").alias("n")).select(F.lit("table").alias("place"), "n")
    )


@query("stream_log", "select event_type as task_id, count(*) as n from events group by 1")
def _(t):
    path = t.scratch("logs")
    rows = _stream(t, "events").select(
        F.col("event_type").alias("task_id"), F.col("props").alias("text"), F.date_format("ts", "yyyyMMdd").alias("dt")
    )
    flows.drain(flows.log_sink(rows, path, t.scratch("ckpt")))
    return t.spark.read.parquet(path).groupBy("task_id").agg(F.count("*").alias("n"))


