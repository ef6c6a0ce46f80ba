"""The minute-by-minute schedule of searches as a stream: which search is started at which tick.

A search is due at the first full minute at or after its last completed run plus its interval; one that never ran is due at
once. A started search is open until its run finishes; ticks in between start nothing. A finished run closes it, and a
completed one moves the last run. Messages wait in the search's state until the watermark has passed them, so the schedule
is that of all messages in order of time, whatever the order of their arrival; a timer wakes the search at its next message
or tick.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
STARTS = "search_id string, due_micros long"
MESSAGE = "micros long, seq long, kind string, interval_minutes long, active boolean, last_run_micros long"


@dataclass
class Plan:
    """What is known of a search; times are microseconds."""

    interval: int | None = None
    active: bool = False
    last_run: int | None = None
    open: bool = False
    since: int = 0

    def next_tick(self) -> int | None:
        """The minute at which it is started next, if nothing comes in between."""
        if self.interval is None or not self.active or self.open:
            return None
        due = self.since if self.last_run is None else max(self.since, self.last_run + self.interval)
        return -(-due // MINUTE) * MINUTE

    def take(self, at: int, kind: str, interval: int | None, active: bool | None, last_run: int | None) -> None:
        """define: interval and activity from now on (an open run stays open; the last run counts for a new search).
        complete and fail finish an open run, and mean nothing else."""
        if kind == "define":
            if self.interval is None:
                self.last_run = last_run
            self.interval, self.active = interval * MINUTE, bool(active)
        elif self.open:
            self.open = False
            self.last_run = at if kind == "complete" else self.last_run
        else:
            return
        self.since = at

    def run(self, messages: list[tuple], until: int) -> list[int]:
        """The ticks at which it is started, up to and with `until`; messages (micros, seq, kind, ...) in order, all up to
        then. A message comes before the tick of its own moment."""
        out = []
        for message in [*messages, None]:
            limit = message[0] - 1 if message else until
            tick = self.next_tick()
            if tick is not None and tick <= limit:
                out.append(tick)
                self.open = True
            if message:
                self.take(message[0], *message[2:])
        return out


class Scheduler(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", MESSAGE)
        self.plan = handle.getValueState("plan", "interval long, active boolean, last_run long, open boolean, since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        of = {"long": int, "string": str, "boolean": bool}
        columns = {name: of[kind] for name, kind in (c.split() for c in MESSAGE.split(", "))}  # pandas turns longs with nulls to doubles
        self.waiting.appendList([tuple(None if pd.isna(x) else kind(x) for x, kind in zip(r, columns.values(), strict=True)) for r in every[list(columns)].itertuples(index=False, name=None)])
        self.handle.registerTimer(-(-int(every["micros"].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready, later = [m for m in waiting if m[0] <= watermark], [m for m in waiting if m[0] > watermark]
        plan = Plan(*self.plan.get()) if self.plan.exists() else Plan()
        starts = plan.run(ready, watermark)
        self.plan.update((plan.interval, plan.active, plan.last_run, plan.open, plan.since))
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        wake = [t for t in (later[0][0] if later else None, plan.next_tick()) if t is not None]
        if wake:
            self.handle.registerTimer(-(-max(min(wake), watermark + 1000) // 1000))
        if starts:
            yield pd.DataFrame({"search_id": [key[0]] * len(starts), "due_micros": starts})

    def close(self) -> None:
        pass


def schedule(messages: DataFrame, delay: str) -> DataFrame:
    """(search_id, due_micros) of every start, from a stream of messages (search_id, micros, seq, kind, interval_minutes,
    active, last_run_micros), kind being define, complete or fail; micros count from 1970. Messages later than `delay`
    behind the latest are left out."""
    timed = messages.withColumn("at", F.timestamp_micros("micros")).withWatermark("at", delay)
    return timed.groupBy("search_id").transformWithStateInPandas(Scheduler(), STARTS, "Append", "EventTime")
