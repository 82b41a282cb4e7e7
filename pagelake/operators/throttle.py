"""Emit an event only if the last emitted one of its key is old enough.

Whether an event passes depends on which earlier one passed, so a plain window cannot
say it. A key is cut into blocks of so many moments. Pass 1 reduces every block, on its own, to
a step function: from the time at which the key may emit again to the last emission inside the
block. Pass 2 composes the functions of neighbouring blocks up a tree, then walks down it to find
how each block is entered. Pass 3 plays every block from there. No task sees more than one
block, or the functions of ``FAN`` neighbours; a function has at most as many steps as one
interval has moments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as tx
from pagelake.operators import ordered

#: Moments in a block, and functions that one task composes.
ROWS, FAN = 100_000, 64
NEVER = np.iinfo(np.int64).min


def _next_allowed(t: np.ndarray, interval: int) -> np.ndarray:
    return np.searchsorted(t, t + interval, side="left")


def _last_emissions(t: np.ndarray, interval: int) -> np.ndarray:
    """For every moment of a block the last one emitted in it, if that moment is: pointers doubled to their ends."""
    at = np.arange(len(t))
    after = _next_allowed(t, interval)
    jump = np.where(after < len(t), after, at)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return t[jump]
        jump = further


def _turns(upto: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A step function by its turning points only."""
    ends = np.append(leave[1:] != leave[:-1], True) if len(leave) else np.zeros(0, bool)
    return upto[ends], leave[ends]


def _enter(free_at: np.ndarray, upto: np.ndarray, leave: np.ndarray, interval: int) -> np.ndarray:
    """When the key is free after a block, for times at which it is free before it."""
    i = np.searchsorted(upto, free_at, side="left")
    inside = i < len(upto)
    out = free_at.copy()
    out[inside] = leave[i[inside]] + interval
    return out


def throttle(
    events: DataFrame, key: str, at: str, event_id: str, interval: int, rows: int = ROWS, fan: int = FAN
) -> DataFrame:
    """The events that pass; ``at`` and ``interval`` in one whole unit (e.g. microseconds).

    Events with a blank key always pass. ``event_id`` must be unique and breaks ties.
    """
    if interval <= 0:
        return events
    blank = tx.is_blank(F.col(key))
    # Of several events of a key at one moment only the first can pass.
    moments = events.filter(~blank).groupBy(F.col(key).alias("k"), F.col(at).alias("t")).agg(F.min(event_id).alias("id"))
    moments = ordered.blocks(moments, ["k"], "t", rows).withColumnRenamed("_block", "b").drop("_g")
    id_type = dict(moments.dtypes)["id"]
    function = "k string, b bigint, upto array<bigint>, leave array<bigint>"

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        # An earlier emission holds back the start of a block for less than one interval.
        last = min(len(t), int(np.searchsorted(t, t[0] + interval, side="left")) + 1)
        upto, leave = _turns(t[:last], _last_emissions(t, interval)[:last])
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "b": [pdf["b"].iloc[0]], "upto": [upto], "leave": [leave]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        starts, free_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = int(pdf["upto"].iloc[0][0])
        for upto, leave in zip(pdf["upto"], pdf["leave"]):
            # The group is entered before its first moment and an interval have passed.
            new = np.searchsorted(upto, first + interval, side="left") + 1 if not len(starts) or starts[-1] < first + interval else 0
            starts, free_at = np.append(starts, upto[:new]), np.append(free_at, upto[:new])
            free_at = _enter(free_at, upto, leave, interval)
        upto, leave = _turns(starts, free_at - interval)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "b": [pdf["up"].iloc[0]], "upto": [upto], "leave": [leave]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        free_at, entered = np.array([pdf["free_at"].iloc[0]]), []
        for upto, leave in zip(pdf["upto"], pdf["leave"]):
            entered.append(int(free_at[0]))
            free_at = _enter(free_at, upto, leave, interval)
        return pd.DataFrame({"k": pdf["k"], "b": pdf["b"], "free_at": entered})

    levels = [moments.select("k", "b", "t").groupBy("k", "b").applyInPandas(exits, function)]
    count = (moments.agg(F.max("b")).first()[0] or 0) + 1
    while count > fan:
        levels.append(_up(levels[-1], fan).groupBy("k", "up").applyInPandas(compose, function))
        count = -(-count // fan)
    entry = "k string, b bigint, free_at bigint"
    entries = levels[-1].withColumn("free_at", F.lit(int(NEVER))).groupBy("k").applyInPandas(walk, entry)
    for level in reversed(levels[:-1]):
        parent = entries.withColumnRenamed("b", "up")
        entries = _up(level, fan).join(parent, ["k", "up"]).groupBy("k", "up").applyInPandas(walk, entry)

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t = pdf["t"].to_numpy()
        after = _next_allowed(t, interval)
        i, taken = int(np.searchsorted(t, pdf["free_at"].iloc[0], side="left")), []
        while i < len(t):
            taken.append(i)
            i = int(after[i])
        return pdf.iloc[taken][["id"]]

    passed = (
        moments.join(entries, ["k", "b"])
        .groupBy("k", "b")
        .applyInPandas(play, f"id {id_type}")
        .select(F.col("id").alias("_id"), F.lit(True).alias("_passed"))
    )
    joined = events.join(passed, F.col(event_id) == F.col("_id"), "left")
    return joined.filter(blank | F.coalesce("_passed", F.lit(False))).drop("_id", "_passed")


def _up(functions: DataFrame, fan: int) -> DataFrame:
    return functions.withColumn("up", F.floor(F.col("b") / fan).cast("bigint"))
