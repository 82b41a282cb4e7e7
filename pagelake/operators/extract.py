"""Rows out of HTML pages: selectors run inside Arrow-batched tasks, the rest is native."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import text as tx
from pagelake.functions import urls
from pagelake.operators import dom
from pagelake.session import ship, spread

# The box that is the page itself, whatever elements it has.
PAGE = ""

STRING_LIST = T.ArrayType(T.StringType())
STRING_MAP = T.MapType(T.StringType(), T.StringType())


@dataclass(frozen=True)
class Field:
    """What to read from a box.

    ``text``: all text below all matches, joined; ``attr``: attribute of the first
    match; ``first``: first own text node or null; ``all``: every own text node;
    ``attr_all``: the attribute of every match that has it; ``pairs``: a table,
    ``css`` naming the rows and ``key``/``value`` the two cells.
    """

    css: str
    mode: str = "text"
    attr: str = ""
    key: str = "th"
    value: str = "td"

    @property
    def type(self) -> T.DataType:
        if self.mode in ("all", "attr_all"):
            return STRING_LIST
        return T.ArrayType(
            T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
        ) if self.mode == "pairs" else T.StringType()


def field(spec: str | Field) -> Field:
    """``css::attr(name)``, ``css::text`` or plain ``css``."""
    if isinstance(spec, Field):
        return spec
    attr = re.search(r"::attr\((\w+)\)\s*$", spec)
    if attr:
        return Field(spec[: attr.start()].strip(), "attr", attr.group(1))
    return Field(re.sub(r"::text$", "", spec).strip())


def _read(box: dom.Node, f: Field):
    nodes = dom.select(box, f.css)
    if f.mode == "text":
        return dom.joined_text(nodes)
    if f.mode == "attr":
        return nodes[0].attrs.get(f.attr, "").strip() if nodes else ""
    if f.mode == "first":
        return next(iter(dom.own_texts(nodes)), None)
    if f.mode == "all":
        return dom.own_texts(nodes)
    if f.mode == "attr_all":
        return [n.attrs[f.attr] for n in nodes if f.attr in n.attrs]
    if f.mode == "pairs":
        cells = ((_read(n, Field(f.key, "first")), _read(n, Field(f.value, "first"))) for n in nodes)
        return [{"k": k.strip(), "v": v.strip()} for k, v in cells if k and v]
    raise ValueError(f"unknown field mode {f.mode!r}")


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def extract_boxes(
    pages: DataFrame,
    item_selector: str,
    fields: Mapping[str, str | Field],
    keep: Iterable[str] = ("page_id", "url"),
    html: str = "html",
) -> DataFrame:
    """One row per box: ``keep`` columns, ``item_idx``, one column per field (nothing dropped).

    ``PAGE`` as the selector takes each page as one box.
    """
    keep = list(keep)
    wanted = {name: field(spec) for name, spec in fields.items()}
    if item_selector != PAGE:
        dom.compile_selector(item_selector)
    for f in wanted.values():
        if f.css:
            dom.compile_selector(f.css)
    types = {f.name: f for f in pages.schema.fields}
    schema = T.StructType(
        [types[k] for k in keep]
        + [T.StructField("item_idx", T.IntegerType())]
        + [T.StructField(name, f.type) for name, f in wanted.items()]
    )
    arrow = _arrow_schema(schema)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in arrow.names}
            for row in batch.to_pylist():
                if not row[html]:
                    continue
                for i, box in enumerate(dom.select(dom.parse_html(row[html]), item_selector)):
                    for k in keep:
                        out[k].append(row[k])
                    out["item_idx"].append(i)
                    for name, f in wanted.items():
                        out[name].append(_read(box, f))
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    ship(pages.sparkSession)
    return spread(pages.select(*dict.fromkeys([*keep, html]))).mapInArrow(boxes, schema)


def extract_items(
    pages: DataFrame,
    item_selector: str,
    fields: Mapping[str, str | Field],
    keep: Iterable[str] = ("page_id", "url"),
    html: str = "html",
) -> DataFrame:
    """Boxes to rows, without the rows whose fields are all blank."""
    rows = extract_boxes(pages, item_selector, fields, keep, html)
    return drop_blank_rows(rows, list(fields))


def drop_blank_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """Drop the rows where every field is missing or white space only."""
    types = dict(df.dtypes)

    def filled(name: str) -> Column:
        c = F.col(f"`{name}`")
        if types[name].startswith(("array", "map")):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return ~tx.is_blank(c)

    keep = F.lit(False)
    for name in fields:
        keep = keep | filled(name)
    return df.filter(keep)


def select_counts(
    pages: DataFrame, selectors: Mapping[str, str], keep: Iterable[str] = ("page_id", "url")
) -> DataFrame:
    """Per page, how many elements each selector matches (long form, zeros left out)."""
    keep = list(keep)
    for css in selectors.values():
        dom.compile_selector(css)
    types = {f.name: f for f in pages.schema.fields}
    schema = T.StructType(
        [types[k] for k in keep]
        + [T.StructField("label", T.StringType()), T.StructField("n", T.LongType())]
    )
    arrow = _arrow_schema(schema)
    wanted = dict(selectors)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in arrow.names}
            for row in batch.to_pylist():
                root = dom.parse_html(row["html"] or "")
                for label, css in wanted.items():
                    n = len(dom.select(root, css))
                    if n:
                        for k in keep:
                            out[k].append(row[k])
                        out["label"].append(label)
                        out["n"].append(n)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return spread(pages.select(*dict.fromkeys([*keep, "html"]))).mapInArrow(counts, schema)


# --- shaping of what was read, all native -------------------------------------------------


def pairs_to_map(pairs: Column | str) -> Column:
    """Table pairs to a map; of equal keys the later one wins."""
    pairs = tx.col(pairs)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    # array_position finds the first, so look from the end for the last.
    back = F.reverse(pairs)
    values = F.transform(
        keys, lambda k: F.element_at(F.filter(back, lambda p: p["k"] == k), 1)["v"]
    )
    return F.map_from_arrays(keys, values)


def last_crumb(crumbs: Column | str) -> Column:
    """The last breadcrumb where there is more than one, else ''."""
    crumbs = tx.col(crumbs)
    return F.when(F.size(crumbs) > 1, F.element_at(crumbs, -1)).otherwise("")


def with_lineage(df: DataFrame, spider: str, run_ts: str) -> DataFrame:
    """Which job made the row, and when (the run's own time, not the clock)."""
    return df.withColumns({"spider_name": F.lit(spider), "crawled_at": F.lit(run_ts)})


def with_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.withColumn("tag_count", F.size(tags))


BOOK_FIELDS = {
    "title": Field("div.product_main h1", "first"),
    "price": Field("p.price_color", "first"),
    "availability": Field("p.instock.availability", "all"),
    "rating": Field("p.star-rating", "attr", "class"),
    "info": Field("table.table-striped tr", "pairs"),
    "description": Field("div#product_description + p", "first"),
    "breadcrumb": Field("ul.breadcrumb li a", "all"),
}


def product_items(pages: DataFrame, keep: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """Product detail pages to item rows, with the defaults of a product feed."""
    raw = extract_boxes(pages, PAGE, BOOK_FIELDS, keep).drop("item_idx")
    info = pairs_to_map("info")

    def of(name: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(info, F.lit(name)), F.lit(default))

    return raw.select(
        *keep,
        "title",
        "price",
        of("Price (incl. tax)", "").alias("price_num"),
        F.lit("GBP").alias("currency"),
        tx.strip(F.array_join("availability", " ")).alias("availability"),
        F.replace("rating", F.lit("star-rating "), F.lit("")).alias("rating"),
        of("UPC", "").alias("upc"),
        last_crumb("breadcrumb").alias("category"),
        "description",
        of("Tax", "").alias("tax"),
        of("Number of reviews", "0").alias("reviews"),
    )


QUOTE_FIELDS = {
    "content": Field("span.text", "first"),
    "author": Field("small.author", "first"),
    "tags": Field("div.tags a.tag", "all"),
    "author_link": Field("span a", "attr", "href"),
}


def quote_items(pages: DataFrame, keep: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """Quote list pages to rows with their tags and the resolved author link."""
    rows = with_tags(extract_boxes(pages, "div.quote", QUOTE_FIELDS, keep))
    link = F.when(F.col("author_link") != "", urls.resolve_link("url", "author_link"))
    return rows.withColumn("author_url", link).drop("author_link")


def outlinks(
    pages: DataFrame, selectors: Mapping[str, str], native_links: bool = False
) -> DataFrame:
    """Links of each kind as ``(page_id, src, dst, kind, link_idx)``.

    All kinds are read in one pass over a page. ``native_links`` keeps resolution
    inside the JVM where links are known to be absolute or root-relative.
    """
    fields = {kind: Field(css, "attr_all", "href") for kind, css in selectors.items()}
    per_page = extract_boxes(pages, PAGE, fields).drop("item_idx")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("hrefs")) for k in fields])
    links = (
        per_page.select("page_id", F.col("url").alias("src"), F.inline(kinds))
        .select("page_id", "src", "kind", F.posexplode("hrefs").alias("link_idx", "href"))
    )
    resolve = urls.resolve_root_relative if native_links else urls.resolve_link
    return links.select("page_id", "src", resolve("src", "href").alias("dst"), "kind", "link_idx")
