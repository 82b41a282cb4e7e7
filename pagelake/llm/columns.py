"""Column expressions for positions and words, used by the operators that stay in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas in it refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of longs, by ``merge`` from 0.

    Totals of blocks first, so that an array of n values takes n * n / 128 steps at most,
    without copying arrays.
    """

    def fold(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), merge)

    def from_blocks(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int")
        starts = F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(v, F.lit(1), b * BLOCK)))
        return let(
            starts,
            lambda s: F.transform(
                v,
                lambda _, i: merge(
                    F.get(s, F.floor(i / BLOCK).cast("int")),
                    fold(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
                ),
            ),
        )

    return let(values, from_blocks)


def found_at(text: Column, pattern: str) -> Column:
    """Matches of a pattern as an array of (start, end, match), in code points, end exclusive.

    The gaps between matches give the positions; the pattern must not match the empty text.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: (F.length(g) + F.length(x)).cast("long"))
        return F.zip_with(
            running(steps, lambda a, b: a + b),
            m,
            lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("match")),
        )

    return let(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """ASCII letters and digits and everything beyond ASCII, lower-cased and joined by one space."""
    return F.trim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words(joined: Column) -> Column:
    """The words of ``plain_words`` as an array, empty where there are none."""
    return F.filter(F.split(joined, " "), lambda w: w != "")
