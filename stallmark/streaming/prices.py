"""Streams of price observations: repeats dropped within a watermark, change points by keyed state, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from stallmark.streaming.buckets import before, bucketed, pack, unpack

LAST = pa.schema([("listing_id", pa.string()), ("price", pa.float64())])
CHANGE = StructType([StructField("listing_id", StringType()), StructField("seq", LongType()), StructField("observed_at", TimestampNTZType()), StructField("price", DoubleType())])


def first_within(df: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key to arrive; state is kept for as long as the watermark asks."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


class LastPrice(StatefulProcessor):
    """State of a bucket of listings: the last price seen of each (null is one)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "last binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = unpack(self.state.get()[0]) if self.state.exists() else LAST.empty_table().to_pandas()
        every = before(pd.concat(list(rows)), last, ["price"], ["observed_at", "seq"])
        self.state.update((pack(every[every["_end"]], LAST),))
        changed = every[every["_new"] & every["price"].notna() & (every["price"] != every["_price"])]
        if len(changed):
            yield changed[CHANGE.fieldNames()].astype({"seq": "int64"})

    def close(self) -> None:
        pass


def price_changes(stream: DataFrame, buckets: int = 64) -> DataFrame:
    """Change points of a stream of (listing_id, seq, observed_at, price); micro-batches come in order of time. Listings are
    kept in `buckets` states, a number that a checkpoint fixes."""
    return bucketed(stream, buckets).transformWithStateInPandas(LastPrice(), CHANGE, "Append", "None")


def write_outbox(messages: DataFrame, path: str, checkpoint: str, key: str = "notification_id"):
    """Appends each message of a stream once, by key, to an outbox table that a sender reads."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            old = spark.read.parquet(path).select(key)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(old, key, "left_anti")
        new.write.mode("append").parquet(path)

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
