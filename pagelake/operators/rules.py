"""Cleaning rules compiled into one chain of projections and filters, without UDFs."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, fields as dataclass_fields
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import text as tx
from pagelake.operators.dedup import dedup_first

log = logging.getLogger(__name__)

# The rule types, and the condition operators in the order they are looked for.
RULE_TYPES = (
    "field_map", "drop", "regex_extract", "replace", "trim",
    "type_cast", "filter", "default", "split", "join",
)
CONDITION_OPERATORS = ("contains", "==", "!=", ">=", "<=", ">", "<")


class RuleError(ValueError):
    """A rule that cannot be compiled."""


@dataclass(frozen=True)
class Rule:
    type: str
    source: str = ""
    target: str = ""
    pattern: str = ""
    replacement: str = ""
    cast_type: str = ""
    default: Any = None
    separator: str = ""
    condition: str = ""
    group: int = 1

    def __post_init__(self) -> None:
        if self.type not in RULE_TYPES:
            raise RuleError(f"unknown rule type {self.type!r}")

    @classmethod
    def of(cls, rule: Rule | Mapping[str, Any]) -> Rule:
        if isinstance(rule, Rule):
            return rule
        known = {f.name for f in dataclass_fields(cls)}
        return cls(**{k: v for k, v in rule.items() if k in known})

    @property
    def into(self) -> str:
        return self.target or self.source


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _has_value(c: Column, dtype: T.DataType) -> Column:
    """Python truth of a value: not missing, not '', 0, false or empty."""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        filled = F.size(c) > 0
    elif isinstance(dtype, T.BooleanType):
        filled = c
    elif isinstance(dtype, T.NumericType):
        filled = c != 0
    elif isinstance(dtype, T.StringType):
        filled = c != ""
    else:
        filled = c.isNotNull()
    return F.coalesce(filled, F.lit(False))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def condition(expression: str, columns: Iterable[str]) -> Column:
    """``score >= 60`` as a Column; sizes are compared only where both sides are numbers."""
    for op in CONDITION_OPERATORS:
        if op not in expression:
            continue
        name, value = (part.strip() for part in expression.split(op, 1))
        value = value.strip("'\"")
        have = _text(_c(name)) if name in set(columns) else F.lit("")
        if op == "==":
            return have == value
        if op == "!=":
            return have != value
        if op == "contains":
            return F.contains(have, F.lit(value))
        try:
            limit = float(value)
        except ValueError:
            return F.lit(True)
        number, bound = tx.to_double(have), F.lit(limit)
        outcome = {">=": number >= bound, "<=": number <= bound, ">": number > bound, "<": number < bound}[op]
        # In Spark NaN is the largest double; here it compares false with everything.
        outcome = outcome & ~F.isnan(number) & F.lit(limit == limit)
        return F.coalesce(outcome, F.lit(True))
    return F.lit(True)


def _java_compile(pattern: str) -> None:
    """Raises ValueError where the JVM refuses a pattern; without a session nothing is checked."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(tx.java_pattern(pattern))
    except Py4JJavaError as e:
        raise ValueError(str(e.java_exception.getMessage())) from e


def _checked_pattern(rule: Rule) -> int:
    """Number of groups of the pattern; a bad pattern or group is found before the job runs."""
    try:
        groups = re.compile(rule.pattern).groups
    except re.error as e:
        raise RuleError(f"{rule.type}: bad pattern {rule.pattern!r}: {e}") from e
    try:
        # What runs is Java's engine, so it has the last word.
        _java_compile(rule.pattern)
    except ValueError as e:
        raise RuleError(f"{rule.type}: bad pattern {rule.pattern!r}: {e}") from e
    if rule.type == "regex_extract" and not 0 <= rule.group <= groups:
        raise RuleError(f"{rule.type}: no group {rule.group} in {rule.pattern!r}")
    return groups


def _assign(df: DataFrame, name: str, value: Column, guard: Column | None) -> DataFrame:
    """Set a column, on the guarded rows only if there is a guard."""
    if guard is None:
        return df.withColumn(name, value)
    new_type = df.select(value.alias("v")).schema["v"].dataType
    if name not in df.columns:
        return df.withColumn(name, F.when(guard, value))
    old = _c(name)
    if df.schema[name].dataType != new_type:
        value, old = value.cast("string"), old.cast("string")
    return df.withColumn(name, F.when(guard, value).otherwise(old))


def _apply(df: DataFrame, rule: Rule, guard: Column | None, keep_raw: bool) -> DataFrame:
    has_source = rule.source in df.columns
    source = _c(rule.source) if has_source else None
    source_type = df.schema[rule.source].dataType if has_source else None
    target_now = _c(rule.into) if rule.into in df.columns else None

    if rule.type == "field_map":
        if not has_source or rule.into == rule.source:
            return df
        if guard is not None:
            moved = _assign(df, rule.into, source, guard)
            return moved.withColumn(rule.source, F.when(~guard, _c(rule.source)))
        if rule.into in df.columns:
            df = df.drop(rule.into)
        return df.withColumnRenamed(rule.source, rule.into)

    if rule.type == "drop":
        if not has_source:
            return df
        return df.drop(rule.source) if guard is None else df.withColumn(rule.source, F.when(~guard, source))

    if rule.type in ("regex_extract", "replace"):
        groups = _checked_pattern(rule)
        if not has_source:
            return df
        value, pattern = source.cast("string"), tx.java_pattern(rule.pattern)
        if rule.type == "regex_extract":
            hit = _has_value(source, source_type) & value.rlike(pattern)
            new = F.regexp_extract(value, pattern, rule.group)
        else:
            hit = _has_value(source, source_type)
            try:
                new = F.regexp_replace(value, pattern, tx.java_replacement(rule.replacement, groups, re.compile(rule.pattern).groupindex))
            except ValueError as e:
                raise RuleError(str(e)) from e
        otherwise = target_now.cast("string") if target_now is not None else F.lit(None).cast("string")
        return _assign(df, rule.into, F.when(hit, new).otherwise(otherwise), guard)

    if rule.type == "trim":
        if target_now is None:
            return df
        return _assign(df, rule.into, tx.clean_text_or_null(target_now.cast("string")), guard)

    if rule.type == "type_cast":
        if target_now is None or rule.cast_type not in ("int", "float", "str", "bool"):
            return df
        if keep_raw:
            df = _assign(df, f"{rule.into}__raw", target_now.cast("string"), guard)
        return _assign(df, rule.into, tx.cast_value(_c(rule.into), rule.cast_type), guard)

    if rule.type == "default":
        value = F.lit(rule.default)
        if target_now is None:
            return _assign(df, rule.into, value, guard)
        dtype = df.schema[rule.into].dataType
        # A default that is no value of the column's type turns the column into text.
        fits = df.sparkSession.range(1).select(value.try_cast(dtype).isNotNull()).first()[0]
        if rule.default is not None and not fits:
            target_now, value = target_now.cast("string"), value.cast("string")
        else:
            value = value.cast(dtype)
        return _assign(df, rule.into, F.when(_has_value(_c(rule.into), dtype), target_now).otherwise(value), guard)

    if rule.type == "split":
        if not has_source or not rule.separator:
            return df
        # Spark splits on a pattern, so the separator is quoted.
        literal = "\\Q" + rule.separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        parts = F.when(_has_value(source, source_type), F.split(source.cast("string"), literal))
        return _assign(df, rule.into, parts, guard)

    if rule.type == "join":
        if not rule.target:
            raise RuleError("join: no target")
        names = [name.strip() for name in rule.source.split(",")]
        parts = [_text(_c(n)) if n in df.columns else F.lit("") for n in names]
        return _assign(df, rule.target, F.concat_ws(rule.separator, *parts), guard)

    keep = condition(rule.condition, df.columns)
    return df.filter(keep if guard is None else ~guard | keep)


def compile_rules(
    rules: Iterable[Rule | Mapping[str, Any]], strict: bool = False, keep_raw: bool = False
) -> Callable[[DataFrame], DataFrame]:
    """Rules in order as one DataFrame transform, for ``df.transform(compile_rules(...))``.

    A rule that cannot be compiled leaves the rows as they are and is logged, or is
    raised with ``strict``. ``keep_raw`` keeps the text before a cast in ``<name>__raw``.
    """
    compiled = [Rule.of(r) for r in rules]

    def transform(df: DataFrame, guard: Column | None = None) -> DataFrame:
        for rule in compiled:
            try:
                df = _apply(df, rule, guard, keep_raw)
            except RuleError as e:
                if strict:
                    raise
                log.warning("rule skipped: %s", e)
        return df

    return transform


def postprocess(
    df: DataFrame, rules: Mapping[str, Mapping[str, Any]]
) -> DataFrame:
    """Per text field, in fixed order: strip, collapse, remove, regex, case, digits."""
    out = {}
    for name, rule in rules.items():
        if name not in df.columns or not isinstance(df.schema[name].dataType, T.StringType):
            continue
        c = _c(name)
        if rule.get("strip", True):
            c = tx.strip(c)
        if rule.get("collapse_ws"):
            c = tx.collapse(c)
        if rule.get("remove"):
            c = F.replace(c, F.lit(str(rule["remove"])), F.lit(""))
        if rule.get("regex_replace"):
            pattern, replacement = rule["regex_replace"]
            groups = re.compile(pattern).groups
            flag = "(?i)" if rule.get("ignorecase") else ""
            c = F.regexp_replace(
                c, flag + tx.java_pattern(pattern), tx.java_replacement(replacement, groups, re.compile(pattern).groupindex)
            )
        if rule.get("lower"):
            c = F.lower(c)
        elif rule.get("upper"):
            c = F.upper(c)
        if rule.get("digits_only"):
            c = tx.digits_only(c)
        out[name] = c
    return df.withColumns(out) if out else df


def clean_strings(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """White-space cleaning of every text column; missing stays missing."""
    skip = set(skip)
    return df.withColumns(
        {
            f.name: tx.clean_text_or_null(_c(f.name))
            for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip
        }
    )


def clean_site(
    df: DataFrame,
    site_rules: Mapping[str, Iterable[Rule | Mapping[str, Any]]],
    site: str = "site",
    strict: bool = False,
    order: Iterable[str] = (),
) -> DataFrame:
    """Each site's own rules, then text cleaning; rows of other sites are only cleaned.

    One pass over the input for all sites: a rule becomes an assignment guarded by the
    site column, so the plan does not read the table once per site.
    """
    for name, rules in site_rules.items():
        guard = F.coalesce(_c(site) == name, F.lit(False))
        df = compile_rules(rules, strict)(df, guard)
    return clean_strings(df, skip=[site, *order])


def clean_batch(
    df: DataFrame,
    site_rules: Mapping[str, Iterable[Rule | Mapping[str, Any]]],
    order: list[str],
    site: str = "site",
    url: str = "url",
) -> DataFrame:
    """Clean, then keep the first row per URL."""
    return dedup_first(clean_site(df, site_rules, site, order=order), [url], order)


def batch_transform(
    df: DataFrame,
    field_mapping: Mapping[str, str] | None = None,
    drop_fields: Iterable[str] = (),
    text_fields: Iterable[str] = (),
    numeric_fields: Iterable[str] = (),
    dedup_by: str = "",
    order: list[str] | None = None,
) -> DataFrame:
    """Rename, drop, clean text, read numbers, dedup: in this order."""
    if field_mapping:
        df = df.withColumnsRenamed(dict(field_mapping))
    df = df.drop(*drop_fields)
    df = df.withColumns(
        {n: tx.collapse(_c(n).cast("string")) for n in text_fields if n in df.columns}
    )
    df = df.withColumns({n: tx.to_numeric(_c(n)) for n in numeric_fields if n in df.columns})
    if dedup_by and dedup_by in df.columns:
        if not order:
            raise ValueError("dedup needs order columns")
        df = dedup_first(df, [dedup_by], order)
    return df


def site_projection(
    df: DataFrame, field_mapping: Mapping[str, str], drop_fields: Iterable[str] = ()
) -> DataFrame:
    """The field mapping and dropped fields of a site's configuration."""
    rules = [Rule("field_map", s, t) for s, t in field_mapping.items()]
    return compile_rules([*rules, *[Rule("drop", d) for d in drop_fields]])(df)
