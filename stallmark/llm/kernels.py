"""Vectorised text kernels that run inside Arrow batches: words, rolling hashes, sliding minima.

A word is a run of bytes outside space and \\t\\n\\v\\f\\r. All hashes are 64-bit, and equal words or word sequences hash
alike. Words are hashed under a key that each application draws anew (stallmark.session), so nobody can write words that
collide; sequences combine the values of their words by place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15 | 1)
STEP = U(0xD6E8FEB86659FD93)
CHUNK = 1 << 15
#: The application's key, in the environment of the driver and of Python workers.
KEY = bytes.fromhex(os.environ.get("STALLMARK_HASH_KEY", ""))
#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


POW, INV = _powers(BASE, CHUNK), _powers(U(_inverse(BASE)), CHUNK)


def segment_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each buf[start:end]; starts and ends ascend. The same in every application, and easy to collide:
    good for features, not to tell words apart."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(out):
        lo = start[i]
        j = max(int(np.searchsorted(end, lo + CHUNK, "right")), i + 1)
        hi = end[j - 1]
        pw, inv = (POW, INV) if hi - lo <= CHUNK else (_powers(BASE, hi - lo), _powers(U(_inverse(BASE)), hi - lo))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + U(1)) * pw[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inv[s]
        i = j
    return mix(out ^ (end - start).astype(np.uint64) * STEP)


def _position_keys(block: int) -> np.ndarray:
    """Random odd or even longs for CHUNK places from block * CHUNK on; nobody who lacks the key knows any of them."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(KEY, "big") or 1, counter=[0, 0, 0, block])).integers(0, 1 << 64, CHUNK, np.uint64)


PLACES = _position_keys(0)


def keyed_hashes(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte strings of these sizes on end: each byte (plus one) times the random long of its place, added up
    modulo 2**64. Two different strings differ at some place by d with |d| <= 256, so their sums are equal for one in
    2**56 choices of the keys at most, whatever the strings."""
    out = np.zeros(len(size), np.uint64)
    upto, i = np.cumsum(size), 0
    while i < len(size):
        done = int(upto[i - 1]) if i else 0
        j = max(int(np.searchsorted(upto, done + CHUNK, "right")), i + 1)
        n = size[i:j].astype(np.int64)
        if n[0] <= CHUNK:
            first = (np.cumsum(n) - n).astype(np.int32)
            place = np.arange(int(upto[j - 1]) - done, dtype=np.int32)
            place -= np.repeat(first, n)
            value = PLACES.take(place, mode="clip")
            value *= flat[done : upto[j - 1]].astype(np.uint64) + U(1)
            some = np.flatnonzero(n)  # reduceat needs strings that are not empty
            out[i + some] = np.add.reduceat(value, first[some]) if len(some) else 0
        else:  # one long string
            for block, lo in enumerate(range(done, int(upto[i]), CHUNK)):
                part = flat[lo : min(lo + CHUNK, int(upto[i]))].astype(np.uint64) + U(1)
                out[i : i + 1] += (part * _position_keys(block)[: len(part)]).sum(dtype=np.uint64)
        i = j
    return mix(out)


class Words:
    """The words of a string array: byte buffer, begin and end of each word, and the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        buf = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        ink = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(buf), bool)
        before[:1], before[1:] = False, ink[:-1]
        after = np.empty(len(buf), bool)
        after[-1:], after[:-1] = False, ink[1:]
        self.start = np.flatnonzero(ink & (~before | edge[:-1]))
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # the words of text i are first[i]:first[i + 1]

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return keyed_hashes(self.buf[~SPACE[self.buf]], self.end - self.start)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours of h (len(h) - k + 1 of them, at least 0)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, size, out, done, q = h, 1, None, 0, int(STEP)
    while size <= k:
        if k & size:
            part = have[done : done + n]
            out = part.copy() if out is None else out * U(pow(q, size, 1 << 64)) + part
            done += size
        if size * 2 <= k:
            have = have[:-size] * U(pow(q, size, 1 << 64)) + have[size:]
        size *= 2
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each h[start:end]. Each value is mixed with its place in the span before they are added up."""
    out = np.empty(len(start), np.uint64)
    size = (end - start).astype(np.int64)
    upto = np.cumsum(size)
    i = 0
    while i < len(start):
        done = int(upto[i - 1]) if i else 0
        j = max(int(np.searchsorted(upto, done + CHUNK, "right")), i + 1)
        n = size[i:j]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        total = np.concatenate([[U(0)], np.cumsum(mix(h[np.repeat(start[i:j], n) + place] + place.astype(np.uint64) * STEP), dtype=np.uint64)])
        out[i:j] = total[first + n] - total[first]
        i = j
    return mix(out ^ size.astype(np.uint64) * BASE)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts hold about limit bytes (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(values: np.ndarray, lengths: np.ndarray, of: pa.DataType) -> pa.ListArray:
    """A list array with lengths[i] of the values in row i."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, of))


def plain(docs: DataFrame, id_col: str, text_col: str, replaced: tuple[str, ...]) -> tuple[DataFrame, list[str], list[str]]:
    """docs as id, text (a string) and c0, c1, ..., which no name of theirs can clash with; the names that the result has
    in the end and the columns that go there. `replaced` are names, in any case, that the result gives anew."""
    at = {name: next(i for same in (str, str.lower) for i, c in enumerate(docs.columns) if same(c) == same(name)) for name in (id_col, text_col)}
    given = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    left = [i for i, c in enumerate(docs.columns) if c.lower() not in replaced or i in at.values()]
    name = {at[id_col]: "id", at[text_col]: "text"}
    columns = [name.get(i, f"c{i}") for i in left]
    rows = given.select(*(F.col(f"c{i}").cast("string").alias("text") if c == "text" else F.col(f"c{i}").alias(c) for i, c in zip(left, columns, strict=True)))
    return rows, [docs.columns[i] for i in left], columns


def picked(df: DataFrame, **of: str) -> DataFrame:
    """The columns of df named by the values, under the names of the keys: a name is met as it stands, else in any case."""
    at = [next(i for same in (str, str.lower) for i, c in enumerate(df.columns) if same(c) == same(name)) for name in of.values()]
    given = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return given.select(*(F.col(f"c{i}").alias(name) for name, i in zip(of, at, strict=True)))
