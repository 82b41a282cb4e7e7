"""Cleaning rules, post-processing and batch transforms over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import rules
from pagelake.workload.registry import query


def _run(df, *rule_list, **options):
    return df.transform(rules.compile_rules(rule_list, strict=True, **options))


@query(
    "rule_map",
    "select c_custkey, c_name as title, c_mktsegment as c_acctbal from customer",
)
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return _run(
        rows,
        {"type": "field_map", "source": "c_name", "target": "title"},
        {"type": "field_map", "source": "c_mktsegment", "target": "c_acctbal"},
        {"type": "field_map", "source": "absent", "target": "x"},
    )


@query("rule_drop", "select c_custkey, c_name from customer")
def _(t):
    return _run(
        t.customer,
        *[{"type": "drop", "source": c} for c in ("c_acctbal", "c_mktsegment", "c_nationkey", "absent")],
    )


@query(
    "rule_regex",
    r"""
    select p_partkey, p_brand, regexp_extract(p_brand, 'Brand#(\d+)', 1) as brand_no,
           case when regexp_matches(p_name, '^(red|blue) ') then regexp_extract(p_name, '^(red|blue) (\w+)', 2) else p_type end as p_type
    from part
    """,
)
def _(t):
    return _run(
        t.part.select("p_partkey", "p_brand", "p_name", "p_type"),
        {"type": "regex_extract", "source": "p_brand", "target": "brand_no", "pattern": r"Brand#(\d+)"},
        {"type": "regex_extract", "source": "p_name", "target": "p_type", "pattern": r"^(red|blue) (\w+)", "group": 2},
        {"type": "drop", "source": "p_name"},
    )


@query(
    "rule_replace",
    r"""
    select c_custkey, regexp_replace(c_name, 'Customer#0*(\d+)', '$C-\1!') as c_name,
           regexp_replace(c_mktsegment, '[AEIOU]', '', 'g') as short
    from customer
    """,
)
def _(t):
    return _run(
        t.customer.select("c_custkey", "c_name", "c_mktsegment"),
        {"type": "replace", "source": "c_name", "pattern": r"Customer#0*(\d+)", "replacement": r"$C-\1!"},
        {"type": "replace", "source": "c_mktsegment", "target": "short", "pattern": "[AEIOU]", "replacement": ""},
        {"type": "drop", "source": "c_mktsegment"},
    )


@query("rule_trim", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def _(t):
    return _run(t.documents.select("doc_id", "text"), {"type": "trim", "source": "text"})


@query(
    "rule_cast",
    r"""
    select o_orderkey, trunc(o_totalprice)::bigint as o_totalprice,
           null::double as o_orderpriority, o_orderpriority as o_orderpriority__raw, o_orderstatus = 'F' as flag
    from orders
    """,
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", F.format_number("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("0").alias("flag"),
    )
    out = _run(
        rows,
        {"type": "type_cast", "source": "o_totalprice", "cast_type": "int"},
        {"type": "type_cast", "source": "flag", "cast_type": "bool"},
    )
    return _run(out, {"type": "type_cast", "source": "o_orderpriority", "cast_type": "float"}, keep_raw=True)


@query(
    "rule_default",
    """
    select d.doc_id, case when coalesce(l.quality, 0) = 0 then 7 else l.quality end as quality,
           case when d.lang = 'en' then 'english' else d.lang end as lang, 'new' as state
    from documents d left join labels l using (doc_id)
    """,
)
def _(t):
    rows = t.documents.select(
        "doc_id", F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("lang")
    ).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return _run(
        rows,
        {"type": "default", "source": "quality", "default": 7},
        {"type": "default", "source": "lang", "default": "english"},
        {"type": "default", "target": "state", "default": "new"},
    )


@query(
    "rule_split",
    """
    select p_partkey, array_to_string(string_split(p_name, ' '), '|') as words, len(string_split(p_name, ' '))::int as n,
           array_to_string(string_split(p_brand, '#'), '|') as brand
    from part
    """,
)
def _(t):
    out = _run(
        t.part.select("p_partkey", "p_name", "p_brand"),
        {"type": "split", "source": "p_name", "target": "words", "separator": " "},
        {"type": "split", "source": "p_brand", "target": "brand", "separator": "#"},
    )
    return out.select(
        "p_partkey", F.array_join("words", "|").alias("words"), F.size("words").alias("n"),
        F.array_join("brand", "|").alias("brand"),
    )


@query(
    "rule_join",
    """
    select d.doc_id, d.lang || '/' || d.source || '/' || coalesce(l.quality::varchar, '') || '/' as k
    from documents d left join labels l using (doc_id)
    """,
)
def _(t):
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return _run(
        rows, {"type": "join", "source": "lang, source,quality,absent", "target": "k", "separator": "/"}
    ).select("doc_id", "k")


@query(
    "rule_filter",
    """
    select p_partkey, p_name, p_brand, p_type, p_size from part
    where p_size >= 5 and p_size <= 45 and p_size > 6 and p_size < 44
      and p_type <> 'SMALL' and contains(p_name, 'e') and p_brand <> 'Brand#7'
    union all by name
    select p_partkey, p_name, p_brand, p_type, p_size from part where p_type = 'SMALL'
    """,
)
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")

    def keep(*conditions):
        return _run(rows, *[{"type": "filter", "condition": c} for c in conditions])

    several = keep(
        "p_size >= 5", "p_size <= 45", "p_size > 6", "p_size < 44", "p_type != SMALL",
        "p_name contains e", "p_brand != 'Brand#7'", "p_name >= 60", "absent > 3", "",
    )
    return several.unionByName(keep('p_type == "SMALL"'))


@query(
    "postprocess",
    r"""
    select c_custkey, regexp_replace(replace(c_name, 'Customer', ''), '[^0-9]', '', 'g') as digits,
           lower(replace(c_mktsegment, 'HOLD', '')) as segment, 'A B' as spaced,
           regexp_replace(c_name, 'CUSTOMER#0+(\d)', 'No \1', 'i') as renamed
    from customer
    """,
)
def _(t):
    rows = t.customer.select(
        "c_custkey", F.concat(F.lit("　 "), "c_name", F.lit("\t")).alias("digits"), F.col("c_mktsegment").alias("segment"),
        F.lit("  a \n　b ").alias("spaced"), F.col("c_name").alias("renamed"),
    )
    return rules.postprocess(
        rows,
        {
            "digits": {"remove": "Customer", "digits_only": True},
            "segment": {"remove": "HOLD", "lower": True, "upper": True},
            "spaced": {"collapse_ws": True, "upper": True},
            "renamed": {"regex_replace": [r"CUSTOMER#0+(\d)", r"No \1"], "ignorecase": True},
            "absent": {"lower": True},
        },
    )


_SITE_RULES = {
    "en": [
        {"type": "filter", "condition": "n_chars >= 300"},
        {"type": "regex_extract", "source": "text", "target": "head", "pattern": r"^(\w+)"},
        {"type": "replace", "source": "source", "pattern": "^src", "replacement": "S"},
    ],
    "fr": [
        {"type": "field_map", "source": "source", "target": "head"},
        {"type": "default", "target": "source", "default": "none"},
    ],
}

_CLEAN_SITE_SQL = r"""
    select doc_id, lang, n_chars, trim(regexp_replace(text, '\s+', ' ', 'g')) as text,
           case lang when 'en' then regexp_replace(source, '^src', 'S') when 'fr' then 'none' else source end as source,
           case lang when 'en' then nullif(regexp_extract(text, '^([\p{L}\p{N}_]+)', 1), '') when 'fr' then source end as head
    from documents where lang <> 'en' or n_chars >= 300
"""


@query("clean_site", _CLEAN_SITE_SQL)
def _(t):
    return rules.clean_site(t.documents, _SITE_RULES, site="lang")


@query(
    "clean_batch",
    f"""
    with cleaned as ({_CLEAN_SITE_SQL})
    select doc_id, lang, n_chars, text, source, head from (
        select *, row_number() over (partition by text order by doc_id) as rn from cleaned
    ) where rn = 1
    """,
)
def _(t):
    return rules.clean_batch(t.documents, _SITE_RULES, ["doc_id"], site="lang", url="text")


@query(
    "batch_transform",
    r"""
    select id, body, chars, source from (
        select doc_id as id, trim(regexp_replace(text, '\s+', ' ', 'g')) as body, n_chars::double as chars, source,
               row_number() over (partition by trim(regexp_replace(text, '\s+', ' ', 'g')) order by doc_id) as rn
        from documents
    ) where rn = 1
    """,
)
def _(t):
    return rules.batch_transform(
        t.documents,
        field_mapping={"doc_id": "id", "text": "body", "n_chars": "chars"},
        drop_fields=["lang", "absent"],
        text_fields=["body"],
        numeric_fields=["chars"],
        dedup_by="body",
        order=["id"],
    )


@query("site_projection", "select c_custkey as id, c_name as title, c_acctbal from customer")
def _(t):
    return rules.site_projection(
        t.customer, {"c_custkey": "id", "c_name": "title"}, ["c_nationkey", "c_mktsegment"]
    )
