"""Scalar text and number functions as native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and the longest identifier kept.
# Java needs (?U) for Unicode spaces and leaves out the four separators U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"
IDENTIFIER_LENGTH = 48
TRUE_WORDS = ("true", "1", "yes", "是")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NON_FINITE = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(col(c), f"(?U)^{WS}+|{WS}+$", "")


def collapse(c: Column | str) -> Column:
    """Turn every run of white space into one space and strip the ends."""
    return F.trim(F.regexp_replace(col(c), f"(?U){WS}+", " "))


def clean_text(c: Column | str) -> Column:
    return F.coalesce(collapse(c), F.lit(""))


def clean_text_or_null(c: Column | str) -> Column:
    """As :func:`clean_text` but a missing value stays missing."""
    return collapse(c)


def short_hash(c: Column | str, length: int = 6) -> Column:
    return F.substring(F.sha1(col(c).cast("string")), 1, length)


def sanitize_identifier(c: Column | str, fallback: str = "col") -> Column:
    """A legal, stable identifier; a lossy rewrite gets a short hash of the original."""
    raw = strip(F.coalesce(col(c).cast("string"), F.lit("")))
    as_is = F.regexp_replace(F.lower(raw), f"(?U)(?:{WS}|[-.])+", "_")
    legal = F.lower(F.regexp_replace(raw, "[^a-zA-Z0-9_]", "_"))
    legal = F.regexp_replace(F.regexp_replace(legal, "_+", "_"), "^_|_$", "")
    stem = F.when(legal == "", F.lit(fallback)).otherwise(legal)
    tagged = F.concat(stem, F.lit("_"), short_hash(raw))
    return F.substring(F.when(legal == as_is, legal).otherwise(tagged), 1, IDENTIFIER_LENGTH)


def extract_numbers(c: Column | str) -> Column:
    return F.coalesce(
        F.regexp_extract_all(col(c), F.lit(r"(?U)\d+\.?\d*"), F.lit(0)),
        F.array().cast("array<string>"),
    )


def safe_name(c: Column | str, default: str = "result") -> Column:
    cleaned = strip(F.regexp_replace(col(c), r'[\\/:*?"<>|]', "_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def to_double(c: Column | str) -> Column:
    """Text to double where the text is a plain number, else null.

    ``try_cast`` alone also takes Java forms such as ``1d``, hence the guard.
    """
    text = col(c).cast("string")
    value = text.try_cast("double")
    return F.when(text.rlike(NUMBER) | text.rlike(NON_FINITE), value)


def to_numeric(c: Column | str) -> Column:
    """Column form: thousands separators removed, anything unreadable is null."""
    return to_double(F.replace(col(c).cast("string"), F.lit(","), F.lit("")))


def cast_value(c: Column | str, kind: str) -> Column:
    """The four casts of a cleaning rule; an unreadable value is null."""
    c = col(c)
    if kind == "int":
        number = to_numeric(c)
        return F.when(~F.isnan(number), number.try_cast("bigint"))
    if kind == "float":
        return to_numeric(c)
    if kind == "str":
        return c.cast("string")
    if kind == "bool":
        return F.lower(c.cast("string")).isin(*TRUE_WORDS)
    raise ValueError(f"unknown cast: {kind!r}")


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\p{Nd}]", "")


def is_blank(c: Column | str) -> Column:
    """Missing or nothing but white space."""
    return strip(F.coalesce(col(c).cast("string"), F.lit(""))) == ""


def template(pattern: str, values: Mapping[str, Column | str]) -> Column:
    """Compile ``{url}_{date}`` into a concat; an unknown placeholder is refused here."""
    parts: list[Column] = []
    at = 0
    for hole in re.finditer(r"\{(\w+)\}", pattern):
        if hole.group(1) not in values:
            raise ValueError(f"unknown placeholder {hole.group(0)} in {pattern!r}")
        if hole.start() > at:
            parts.append(F.lit(pattern[at : hole.start()]))
        parts.append(F.coalesce(col(values[hole.group(1)]).cast("string"), F.lit("")))
        at = hole.end()
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


def java_pattern(pattern: str) -> str:
    """A Python-style pattern for the JVM: Unicode classes, named groups by their numbers."""
    numbers = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", lambda m: f"(?:\\{numbers[m[1]]})", plain)


def java_replacement(replacement: str, groups: int, names: Mapping[str, int] | None = None) -> str:
    r"""Python replacement text (``\1``, ``\g<1>``, ``\g<name>``) in Java form, checked against the groups."""
    out: list[str] = []
    at = 0
    while at < len(replacement):
        ref = re.match(r"\\(?:g<(\w+)>|(\d{1,2}))", replacement[at:])
        if ref:
            named = ref.group(1) or ref.group(2)
            if not named.isdigit() and named not in (names or {}):
                raise ValueError(f"group {named} is not in the pattern")
            number = int(named) if named.isdigit() else names[named]
            if number > groups:
                raise ValueError(f"group {number} is not in the pattern")
            # A bare $1 followed by a digit would read as $10.
            following = replacement[at + ref.end() : at + ref.end() + 1]
            out.append(f"${number}" + ("\\" if following.isdigit() else ""))
            at += ref.end()
        elif replacement[at : at + 2] in ("\\n", "\\t", "\\r"):
            out.append({"n": "\n", "t": "\t", "r": "\r"}[replacement[at + 1]])
            at += 2
        elif replacement[at : at + 2] == "\\\\":
            out.append("\\\\")
            at += 2
        else:
            char = replacement[at]
            out.append("\\" + char if char in "$\\" else char)
            at += 1
    return "".join(out)
