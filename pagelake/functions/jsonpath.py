"""Dot paths such as ``data.items[0].name`` over VARIANT columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.text import col, strip


def quoted(name: str) -> str:
    """A key as a path step; VARIANT paths know two quotes and no escapes."""
    if "'" not in name:
        return f"['{name}']"
    if '"' not in name:
        return f'["{name}"]'
    raise ValueError(f"a key with both kinds of quotes cannot be addressed: {name!r}")


def path_to_variant(path: str) -> str:
    """``a.b[0]`` to ``$['a']['b'][0]``; brackets that hold no number are ignored."""
    out = "$"
    for token in path.split("."):
        name = re.sub(r"\[.*?\]", "", token)
        if name:
            out += quoted(name)
        out += "".join(f"[{int(i)}]" for i in re.findall(r"\[(\d+)\]", token))
    return out


def parse(text: Column | str) -> Column:
    """JSON text as a value, null if it does not parse; of a repeated key the last value counts."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(col(text))


def is_json(text: Column | str) -> Column:
    """Starts like an object or array and parses."""
    text = col(text)
    return F.coalesce(text.rlike(r"(?U)^[\s\x1c-\x1f]*[\[{]") & parse(text).isNotNull(), F.lit(False))


def get(variant: Column | str, path: str, kind: str = "variant") -> Column:
    """Value at a path, null where any step is missing."""
    if not path:
        return F.lit(None).cast(kind if kind != "variant" else "string")
    return F.try_variant_get(col(variant), path_to_variant(path), kind)


def as_text(variant: Column | str, path: str) -> Column:
    """Value at a path as stripped text; missing and null give ''. Nested values are JSON."""
    return F.coalesce(strip(get(variant, path, "string")), F.lit(""))


def get_or(variant: Column | str, keys: list[str], default, kind: str = "string") -> Column:
    """Walk nested objects by key; a missing key gives the default."""
    path = "$" + "".join(quoted(k) for k in keys)
    return F.coalesce(F.try_variant_get(col(variant), path, kind), F.lit(default).cast(kind))
