"""Sketches of bounded size that tasks fill and the driver merges: they save work and never decide a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.llm.kernels import mix

#: Bits a member, and the most members a filter is made for: beyond that it would not be worth its broadcast (32 MB).
EACH, MOST_MEMBERS = 16, 1 << 24


class Filter:
    """Says of a long whether it may be in the set; never no for a member. Without bits it says yes to all."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits
        self.power = 0 if bits is None else int(len(bits)).bit_length() + 2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(x), bool)
        a, b = places(x, self.power)
        hit = lambda i: (self.bits[i >> 3] >> (i & 7)) & 1
        return (hit(a) & hit(b)).astype(bool)


def places(x: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each long among 2 ** power bits."""
    h = mix(x.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return (h >> np.uint64(64 - power)).astype(np.int64), (h & np.uint64((1 << power) - 1)).astype(np.int64)


def fill(longs: DataFrame, members: int) -> Filter:
    """The filter of a one-column DataFrame of longs, of which there are about `members`: its size follows from their
    number, and above MOST_MEMBERS it lets all through, so that what comes after it does all the work. Tasks send the
    words of their bitmaps that have bits, at most one a member; equal words meet in an aggregate."""
    if members > MOST_MEMBERS:
        return Filter(None)
    power = max(16, (members * EACH - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (power - 3), np.uint8)
        for b in batches:
            for at in places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), power):
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        words = own.view(np.int64)
        full = np.flatnonzero(words)
        for i in range(0, len(full), 1 << 16):
            part = full[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part])], ["word", "bits"])

    got = longs.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (power - 6), np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return Filter(words.view(np.uint8))


class Counts:
    """The values seen most often, in bounded space: counts of a summary cut back to `most` entries."""

    def __init__(self, most: int = 1 << 15):
        self.most, self.value, self.count = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, x: np.ndarray) -> None:
        value, count = np.unique(x, return_counts=True)
        if len(self.value):
            at = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
            met = self.value[at] == value
            self.count[at[met]] += count[met]
            value, count = value[~met], count[~met]
        fresh = count > 1
        value, count = np.concatenate([self.value, value[fresh]]), np.concatenate([self.count, count[fresh]])
        if len(value) > self.most:
            keep = count >= np.partition(count, -self.most)[-self.most]
            value, count = value[keep], count[keep]
        order = np.argsort(value)
        self.value, self.count = value[order], count[order]


class Frequent:
    """Estimated counts of frequent values; 1 for all others."""

    def __init__(self, value: np.ndarray, count: np.ndarray):
        order = np.argsort(value)
        self.value, self.count = value[order], count[order]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return np.ones(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.value, x), len(self.value) - 1)
        return np.where(self.value[at] == x, self.count[at], 1)
