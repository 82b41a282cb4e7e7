"""Keyed state of the streaming operators. Imports nothing of this package, as it is pickled by value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Before the id of an alert that has no key.
LONE = "\u0000"


def throttle_in_order(times: np.ndarray, last: int | None, interval: int) -> tuple[list[int], int | None]:
    """Indexes that pass in one ordered run of times, and the last emission (streaming form)."""
    passed, times = [], np.asarray(times)
    i = 0 if last is None else int(np.searchsorted(times, last + interval, side="left"))
    while i < len(times):
        passed.append(i)
        last = int(times[i])
        i = max(i + 1, int(np.searchsorted(times, last + interval, side="left")))
    return passed, last


class Throttle(StatefulProcessor):
    """One number per key: when it last emitted. It is dropped when it can hold nothing back any more."""

    def __init__(self, interval: int, event_time: bool, idle_ms: int | None):
        self.interval, self.event_time, self.idle_ms = interval, event_time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last bigint", None if self.event_time else self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        # Only the two numbers of a key's rows are held; a micro-batch bounds how many.
        parts = [(pdf["t"].to_numpy(), pdf["id"].to_numpy()) for pdf in rows]
        t, ids = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((ids, t))
        t, ids = t[order], ids[order]
        if key[0].startswith(LONE):
            yield pd.DataFrame({"k": key[0], "t": t, "id": ids})
            return
        last = self.last.get()[0] if self.last.exists() else None
        passed, last = throttle_in_order(t, last, self.interval)
        self.last.update((last,))
        if self.event_time:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(last + self.interval) // 1000))
        yield pd.DataFrame({"k": key[0], "t": t[passed], "id": ids[passed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class Stuck(StatefulProcessor):
    """The pop of a task that is still open, until it ends or its time is up, in event or processing time."""

    def __init__(self, timeout_ms: int, event_time: bool):
        self.timeout_ms, self.event_time = timeout_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        parts = [(pdf["at"].to_numpy(), pdf["is_pop"].to_numpy()) for pdf in rows]
        at, pops = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((pops, at))  # of one moment, what ends comes before what starts
        now = self.open.get()[0] if self.open.exists() else None
        stuck = []
        for t, pop in zip(at[order].tolist(), pops[order].tolist()):
            if self.event_time and now is not None and t - now >= self.timeout_ms:
                stuck.append(now)
            now = t if pop else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is None:
            self.open.clear()
        else:
            self.open.update((now,))
            start = now if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(start + self.timeout_ms)
        if stuck:
            yield pd.DataFrame({"task": key[0], "at": stuck})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.open.exists():
            at = self.open.get()[0]
            self.open.clear()
            yield pd.DataFrame({"task": [key[0]], "at": [at]})

    def close(self) -> None:
        pass
