"""Change points of price series whose observations arrive late and out of order.

Series share buckets. Rows wait in the state of their bucket until the watermark passes them; a timer at the earliest waiting row
wakes the bucket, which then takes all rows that the watermark has passed in order of (time, seq). As nothing at or before a
watermark is let in any more, that order is final: the result is the batch result of all rows that came in time, whatever
the order of their arrival. State is the waiting rows and the last prices. With `idle`, a series that is silent for as long
in event time is forgotten, and begins anew with its next price.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stallmark.streaming.buckets import before, bucketed, pack, unpack

WAITING = pa.schema([("listing_id", pa.string()), ("seq", pa.int64()), ("micros", pa.int64()), ("price", pa.float64())])
LAST = pa.schema([("listing_id", pa.string()), ("micros", pa.int64()), ("price", pa.float64())])
CHANGE = "listing_id string, seq long, micros long, price double"


class OrderedChanges(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "waiting binary, last binary")

    def _held(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if not self.state.exists():
            return WAITING.empty_table().to_pandas(), LAST.empty_table().to_pandas()
        return tuple(unpack(x) for x in self.state.get())

    def _hold(self, waiting: pd.DataFrame, last: pd.DataFrame) -> None:
        if waiting.empty and last.empty:
            self.state.clear()
        else:
            self.state.update((pack(waiting, WAITING), pack(last, LAST)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        waiting, last = self._held()
        self._hold(pd.concat([waiting, every[WAITING.names]], ignore_index=True), last)
        self.handle.registerTimer(-(-int(every["micros"].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, last = self._held()
        ready = waiting["micros"] <= watermark
        rows = before(waiting[ready], last, ["price", "micros"], ["micros", "seq"])
        later, last = waiting[~ready], rows[rows["_end"]]
        if self.idle_ms is not None:
            rows.loc[rows["micros"] - rows["_micros"] >= self.idle_ms * 1000, "_price"] = float("nan")
            last = last[last["micros"] + self.idle_ms * 1000 > watermark]  # what comes now comes after a silence
        self._hold(later, last)
        if len(later):
            self.handle.registerTimer(-(-int(later["micros"].min()) // 1000))
        if self.idle_ms is not None and len(last):
            self.handle.registerTimer(-(-int(last["micros"].min()) // 1000) + self.idle_ms)
        changed = rows[rows["_new"] & rows["price"].notna() & (rows["price"] != rows["_price"])]
        if len(changed):
            yield changed[WAITING.names].astype({"seq": "int64"})

    def close(self) -> None:
        pass


def ordered_price_changes(stream: DataFrame, delay: str, idle_ms: int | None = None, buckets: int = 64) -> DataFrame:
    """(listing_id, seq, micros, price) of the points at which a series' price changed, from a stream of (listing_id, seq,
    micros, price) in any order; micros count from 1970. Rows later than `delay` behind the latest are left out. Series
    are kept in `buckets` states, a number that a checkpoint fixes."""
    timed = stream.withColumn("at", F.timestamp_micros("micros")).withWatermark("at", delay)
    return bucketed(timed, buckets).transformWithStateInPandas(OrderedChanges(idle_ms), CHANGE, "Append", "EventTime")
