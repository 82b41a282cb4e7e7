"""URL functions over plain regular expressions, so that no odd URL raises."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelake.functions.text import col


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    """Path with its ``;params``, without query and fragment."""
    return F.regexp_extract(
        col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )


def query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)


def _decode(c: Column) -> Column:
    # A percent sign that starts no escape stands for itself; its neighbours are decoded.
    whole = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), F.replace(c, F.lit("+"), F.lit(" ")))


def unescaped(c: Column) -> Column:
    """Text with its percent escapes resolved; a plus sign and half-broken escapes stand for themselves."""
    return F.when(F.contains(c, F.lit("%")), _decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def _encode(c: Column) -> Column:
    encoded = F.url_encode(c)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query_text(query_part: Column) -> Column:
    """Query pairs without blank values, decoded, sorted and encoded again."""
    pairs = F.filter(F.split(query_part, "&"), lambda p: p.rlike("=."))
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=(?s:(.*))$", 1)).alias("v"),
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(decoded),
            lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])),
        ),
        "&",
    )


def normalize_url(url: Column | str) -> Column:
    """Lower scheme and host, query pairs without blank values sorted, no fragment.

    Most URLs have no query, so the pieces are cut with plain string functions and the
    pairs are looked at only where there are any.
    """
    whole = F.substring_index(col(url), "#", 1)
    head = F.substring_index(whole, "?", 1)
    asked = F.substr(whole, F.length(head) + 2)
    origin = F.regexp_extract(head, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/]*)?", 0)
    text = F.when(F.contains(asked, F.lit("=")), _query_text(asked)).otherwise("")
    return F.concat(
        F.lower(origin),
        F.substr(head, F.length(origin) + 1),
        F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
    )


def url_fingerprint(url: Column | str) -> Column:
    """MD5 of the normalised URL: the key of every URL dedup and upsert."""
    return F.md5(normalize_url(F.coalesce(col(url), F.lit(""))))


def host_key(url: Column | str) -> Column:
    """Lower host name, with the port where it is not the scheme's own; bad URL gives ''."""
    place = F.regexp_replace(netloc(url), r"^.*@", "")
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
    host = F.regexp_replace(host, r"^\[|\]$", "")
    port_text = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    port = F.when(port_text.rlike(r"^\d+$"), port_text.try_cast("int"))
    own = F.when(scheme(url) == "https", 443).otherwise(80)
    bad = (port_text != "") & (port.isNull() | (port > 65535))
    return (
        F.when(col(url).isNull() | bad | (host == ""), F.lit(""))
        .when(port.isNotNull() & (port != 0) & (port != own), F.concat(host, F.lit(":"), port.cast("string")))
        .otherwise(host)
    )


def domain(url: Column | str) -> Column:
    """The third piece between slashes, as a cheap grouping key."""
    return F.coalesce(F.split_part(col(url), F.lit("/"), F.lit(3)), F.lit(""))


def redactable(url: Column | str) -> Column:
    return col(url).rlike("://[^/?#@]*@")


def resolve_root_relative(base: Column | str, link: Column | str) -> Column:
    """Native link resolution where links are absolute or start with one slash."""
    link = col(link)
    origin = F.concat(F.lower(scheme(base)), F.lit("://"), netloc(base))
    return (
        F.when(link.startswith("http"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
    )


@F.pandas_udf(StringType())
def _urljoin(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from urllib.parse import urljoin

    for bases, links in batches:
        out = []
        for base, link in zip(bases, links):
            try:
                out.append(urljoin(base or "", link or ""))
            except ValueError:
                out.append(link)
        yield pd.Series(out, dtype=object)


def resolve_link(base: Column | str, link: Column | str) -> Column:
    """Any link against its page: links starting ``http`` stay, others follow RFC 3986."""
    link = col(link)
    return F.when(link.startswith("http"), link).otherwise(_urljoin(col(base), link))
