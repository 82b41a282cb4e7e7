"""Rows out of JSON responses, all on VARIANT columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import jsonpath
from pagelake.functions.text import col, strip

VARIANTS = "array<variant>"
OBJECT = "map<string,variant>"


def _text(variant: Column) -> Column:
    return F.coalesce(strip(F.try_variant_get(variant, "$", "string")), F.lit(""))


def _is_array(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", VARIANTS).isNotNull()


def _lists_of(obj: Column) -> Column:
    return F.map_filter(obj, lambda _k, v: _is_array(v))


def _zipped(df: DataFrame, lists: str, fields: Mapping[str, str]) -> tuple[DataFrame, Column]:
    """The fields' lists as columns of their own, and their zip to the longest."""
    empty = F.array().cast(VARIANTS)
    names = [f"_f{i}" for i in range(len(fields))]
    df = df.withColumns(
        {
            n: F.coalesce(F.try_variant_get(F.try_element_at(F.col(lists), F.lit(path)), "$", VARIANTS), empty)
            for n, path in zip(names, fields.values())
        }
    )
    return df, F.arrays_zip(*names)


def _records(items: Column, fields: Mapping[str, str]) -> Column:
    """Elements to structs of text; a scalar element fills every field with itself."""
    known = F.transform(
        items, lambda x: F.struct(x.alias("x"), F.try_variant_get(x, "$", OBJECT).isNotNull().alias("o"))
    )
    return F.transform(
        known,
        lambda e: F.struct(
            *[F.when(e["o"], jsonpath.as_text(e["x"], path)).otherwise(_text(e["x"])).alias(name)
              for name, path in fields.items()]
        ),
    )


def _zipped_records(zipped: Column, fields: Mapping[str, str]) -> Column:
    return F.transform(
        zipped, lambda z: F.struct(*[_text(z[f"_f{i}"]).alias(name) for i, name in enumerate(fields)])
    )


def _item_rows(df: DataFrame, keep: list[str], items: Column, fields: Mapping[str, str]) -> DataFrame:
    """Arrays of field structs to rows, without blank ones.

    The texts are made before the explode and filtered after it, so they are made once:
    Spark would push the filter through a projection and compute them twice.
    """
    rows = df.select(*keep, F.posexplode(items).alias("item_idx", "_e"))
    filled = F.lit(False)
    for name in fields:
        filled = filled | (F.col("_e")[name] != "")
    return rows.filter(filled).select(*keep, "item_idx", *[F.col("_e")[name].alias(name) for name in fields])


def locate_items(df: DataFrame, text: str, item_path: str) -> DataFrame:
    """Find the items of JSON responses, in this order of places:

    a list at ``item_path``; a list at the root; lists among the top values; lists in the
    first nested object that has any. The first two come as ``_listed``, the others,
    which are zipped, as ``_lists``. Each step is a column of its own, so that a response
    is parsed once and looked at further only if the step before found nothing.
    """
    df = df.withColumn("_root", jsonpath.parse(text)).filter(
        F.col(text).rlike(r"(?U)^[\s\x1c-\x1f]*[\[{]") & F.col("_root").isNotNull()
    )
    at_path = jsonpath.get("_root", item_path, VARIANTS) if item_path else F.lit(None).cast(VARIANTS)
    df = df.withColumn("_listed", F.coalesce(at_path, F.try_variant_get("_root", "$", VARIANTS)))
    # from_json keeps the order of keys in the text, VARIANT sorts them.
    df = df.withColumn("_top", F.when(F.col("_listed").isNull(), F.from_json(text, OBJECT)))
    df = df.withColumn("_lists", _lists_of(F.col("_top")))
    nested = F.filter(
        F.transform(
            F.filter(F.map_values("_top"), lambda v: F.try_variant_get(v, "$", OBJECT).isNotNull()),
            lambda v: _lists_of(F.from_json(F.try_variant_get(v, "$", "string"), OBJECT)),
        ),
        lambda m: F.size(m) > 0,
    )
    deeper = F.when(F.size("_lists") > 0, F.col("_lists")).otherwise(F.get(nested, 0))
    return df.withColumn("_lists", deeper)


def json_items(
    responses: DataFrame,
    fields: Mapping[str, str],
    item_path: str = "",
    text: str = "text",
    keep: Iterable[str] = ("page_id",),
) -> DataFrame:
    """JSON responses to rows ``(keep…, item_idx, fields…)``; other responses give none."""
    keep = list(keep)
    if not fields:
        raise ValueError("JSON extraction needs fields")
    located = locate_items(responses.select(*dict.fromkeys([*keep, text])), text, item_path)
    zipped, zip_column = _zipped(located, "_lists", fields)
    items = F.when(F.col("_listed").isNotNull(), _records(F.col("_listed"), fields)).otherwise(
        _zipped_records(zip_column, fields)
    )
    return _item_rows(zipped, keep, items, fields)


def json_records(
    df: DataFrame, variant: str, fields: Mapping[str, str], item_path: str = "",
    keep: Iterable[str] = ("page_id",), objects_only: bool = False,
) -> DataFrame:
    """The declared form: the list is known to be at ``item_path`` (or the root).

    ``objects_only`` is the rule for captured responses: other entries are skipped.
    """
    keep = list(keep)
    array = jsonpath.get(variant, item_path, VARIANTS) if item_path else F.try_variant_get(
        col(variant), "$", VARIANTS
    )
    items = _records(array, fields)
    if objects_only:
        blank = F.struct(*[F.lit("").alias(name) for name in fields])
        is_object = F.transform(array, lambda x: F.try_variant_get(x, "$", OBJECT).isNotNull())
        # Skipped entries keep their place, so that positions stay those of the response.
        items = F.transform(F.arrays_zip(items.alias("r"), is_object.alias("o")), lambda p: F.when(p["o"], p["r"]).otherwise(blank))
    return _item_rows(df.select(*keep, variant), keep, items, fields)


def parallel_arrays(
    df: DataFrame, variant: str, fields: Mapping[str, str], item_path: str = "",
    keep: Iterable[str] = ("page_id",),
) -> DataFrame:
    """The declared form of zipped arrays below one object."""
    keep = list(keep)
    whole = jsonpath.get(variant, item_path, OBJECT) if item_path else F.try_variant_get(col(variant), "$", OBJECT)
    zipped, zip_column = _zipped(df.select(*keep, whole.alias("_lists")), "_lists", fields)
    return _item_rows(zipped, keep, _zipped_records(zip_column, fields), fields)


def prefer_api(api_rows: DataFrame, page_rows: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows from captured responses where a page has any, else the rows read from the page."""
    keys = [on] if isinstance(on, str) else list(on)
    covered = api_rows.select(*keys).distinct()
    rest = page_rows.join(covered, keys, "left_anti")
    return api_rows.unionByName(rest, allowMissingColumns=True)
