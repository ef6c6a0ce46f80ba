"""Removal of lines that an equal or nearly equal line precedes.

Lines are compared by their words (white space does not count). A line goes if a line with the same words, or with
one word changed, added or taken away, stands at an earlier place (document id, line number) of the input. Equal
lines count whatever their length; one word counts from `near_words` words on, five being where the similarity of the lines
is 0.8. Longer lines that differ by more than one word stay: variants without two words grow with the square
of the line. With `min_chars` above 0, shorter lines always stay.

1. Equal lines: the first place of every content, by a partial aggregate.
2. Candidates: two lines one word apart have equal first halves or equal last halves (of the shorter line's length).
   Halves that two contents share go to a filter sized by their number; only lines it lets through go on.
3. Deletion neighbourhood: each candidate emits its hash and those of the line without word i; those that no second line
   has are counted out first, again by a filter. Lines that differ in
   word i share the variant without it, so each (variant, i) needs only its first line; a line with one word more has
   the other line among its variants, so each variant needs the first whole line and the first shortened one. These are
   aggregates: no pair of a group is emitted but those with its first line.
4. Each such pair is verified on the words; a content with a verified earlier neighbour goes everywhere.

Defined results: null texts stay null and empty texts empty; rows without id are returned unchanged and precede
nothing; rows that repeat an id stand at the same place, so none goes for the other; blank lines stay; an empty table
gives no rows; other columns are passed through, n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stallmark.llm.kernels import STEP, Words, mix, plain, ragged, signed, slices, span_hashes
from stallmark.llm.scratch import materialize, release, spread_join
from stallmark.llm.sketches import Filter, fill

U = np.uint64


class Lines:
    """The lines with words of some texts: text number, line number, and word range."""

    def __init__(self, texts: pa.Array, min_chars: int):
        w = Words(texts)
        self.hashes = w.hashes()
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        breaks = np.flatnonzero(w.buf == 10)
        line = np.searchsorted(breaks, w.start) - np.searchsorted(breaks, w.offsets)[doc]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(doc))
        long = (w.end[end - 1] - w.start[start] >= min_chars) if len(start) else np.zeros(0, bool)
        self.start, self.end = start[long], end[long]
        self.doc, self.line = doc[self.start], line[self.start]

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        other = mix(self.hashes + STEP)
        return signed(span_hashes(self.hashes, self.start, self.end)), signed(span_hashes(other, self.start, self.end))

    def halves(self, near_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(line index, key): first and last half for its own length and for one word less."""
        n = self.end - self.start
        at = np.flatnonzero(n >= near_words)
        s, e, n = self.start[at], self.end[at], n[at]
        keys = []
        for less in (0, 1):
            size = n - less
            half = size // 2
            for side, h in ((1, span_hashes(self.hashes, s, s + half)), (2, span_hashes(self.hashes, e - half, e))):
                keys.append(mix(h ^ (size * 4 + side).astype(np.uint64) * STEP))
        return np.tile(at, 4), np.concatenate(keys)


def variants(words: np.ndarray) -> np.ndarray:
    """Hashes of a word sequence without its word i, for every i, and of the whole as the last."""
    n = len(words)
    q = np.cumprod(np.full(n + 1, STEP, np.uint64), dtype=np.uint64)
    x = (words ^ U(0xA5A5A5A5A5A5A5A5)) * q[:n]
    left = np.concatenate([[U(0)], np.cumsum(x)])
    moved = (words ^ U(0xA5A5A5A5A5A5A5A5)) * np.concatenate([[U(1)], q[: n - 1]])  # one place to the left
    right = np.concatenate([np.cumsum(moved[::-1])[::-1], [U(0)]])
    return mix(np.append(left[:n] + right[1:], left[n]) + np.append(np.full(n, n - 1), n).astype(np.uint64))


def _places(min_chars: int, near_words: int):
    """Content, place and half keys of every line; lines under near_words words have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                lines = Lines(b.column(1), min_chars)
                c = lines.contents()
                at, key = lines.halves(near_words)
                n = np.zeros(len(lines.start), np.int64)
                n[at] = 4
                keys = ragged(signed(np.ascontiguousarray(key.reshape(4, -1).T).ravel()), n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), b.column(0).take(pa.array(lines.doc)), pa.array(lines.line.astype(np.int32)), keys], ["c", "c2", "doc", "line", "keys"])

    return run


def _candidates(min_chars: int, near_words: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may: Filter = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                lines = Lines(b.column(1), min_chars)
                at, key = lines.halves(near_words)
                at = np.unique(at[may(signed(key))])
                c = lines.contents()
                words = [lines.hashes[s:e] for s, e in zip(lines.start[at], lines.end[at], strict=True)]
                flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0][at]), pa.array(c[1][at]), b.column(0).take(pa.array(lines.doc[at])), pa.array(lines.line[at].astype(np.int32)), ragged(signed(flat), np.array([len(x) for x in words], np.int64), pa.int64())],
                    ["c", "c2", "doc", "line", "words"],
                )

    return run


def _variants(column: pa.Array) -> list[np.ndarray]:
    """The variants of each line of word hashes."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [variants(flat[offsets[i] : offsets[i + 1]]) for i in range(len(column))]


def _variant_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(_variants(b.column(0)))))], ["v"])


def _neighbourhood(shared):
    """Variants that more than one line may have, with slot (the word left out, -1 for the whole line) and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may: Filter = shared.value
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                keys = _variants(b.column(4))
                v = signed(np.concatenate(keys))
                met = np.flatnonzero(may(v))
                slot = np.concatenate([np.append(np.arange(len(k) - 1), -1) for k in keys]).astype(np.int32)[met]
                rows = b.select([0, 1, 2, 3]).take(pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in keys])[met]))
                yield pa.RecordBatch.from_arrays([pa.array(v[met]), pa.array(slot), *rows.columns], ["v", "slot", "c", "c2", "doc", "line"])

    return run


def one_apart(a: list[int], b: list[int]) -> bool:
    """Whether the word edit distance is 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    n, p, s = min(len(a), len(b)), 0, 0
    while p < n and a[p] == b[p]:
        p += 1
    while s < n and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, w = b.column(2).to_pylist(), b.column(3).to_pylist()
        keep = pa.array([one_apart(x, y) for x, y in zip(a, w, strict=True)], pa.bool_())
        yield b.select([0, 1]).filter(keep)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, whole.schema.names[-2]):
            texts, gone = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            out, n, removed = [], [], []
            for text, lines in zip(texts, gone, strict=True):
                parts = [] if text is None else text.split("\n")
                n.append(len(parts))
                removed.append(len(lines or ()))
                if lines:
                    lines = set(lines)
                    text = "\n".join(p for i, p in enumerate(parts) if i not in lines)
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*b.schema.names[:-1], "n_lines", "n_removed"])


def repeated_lines(docs: DataFrame, min_chars: int = 0, near_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lines): the numbers of the lines to remove."""
    sc = docs.sparkSession.sparkContext
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    places = materialize(rows.mapInArrow(_places(min_chars, near_words), "c long, c2 long, doc long, line int, keys array<long>"), "line-places")
    written = places
    halves = places.select(F.explode("keys").alias("key"), "c")
    places = places.drop("keys")
    keys = materialize(halves.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z").select("key"), "line-halves")
    shared = sc.broadcast(fill(keys, keys.count()))
    release(keys)
    near = rows.mapInArrow(_candidates(min_chars, near_words, shared), "c long, c2 long, doc long, line int, words array<long>")
    near = near.groupBy("c", "c2").agg(F.min(F.struct("doc", "line")).alias("at"), F.any_value("words").alias("words"))
    near = materialize(near.select("c", "c2", "at.doc", "at.line", "words"), "line-candidates")
    met = near.select("words").mapInArrow(_variant_keys, "v long").groupBy("v").count().where("count > 1").select("v")
    met = materialize(met, "line-met")
    known = sc.broadcast(fill(met, met.count()))
    release(met)
    entries = materialize(near.mapInArrow(_neighbourhood(known), "v long, slot int, c long, c2 long, doc long, line int"), "line-variants")
    place = F.struct("doc", "line", "c", "c2")
    same = entries.where("slot >= 0").groupBy("v", "slot").agg(F.min(place).alias("w"), F.count("*").alias("k")).where("k > 1").select("v", "slot", "w")
    changed = entries.join(same, ["v", "slot"])
    ends = entries.groupBy("v").agg(F.min(F.when(F.col("slot") < 0, place)).alias("full"), F.min(F.when(F.col("slot") >= 0, place)).alias("less")).where("full is not null and less is not null")
    shorter = entries.join(ends, "v").withColumn("w", F.when(F.col("slot") < 0, F.col("less")).otherwise(F.col("full")))
    pairs = changed.select("c", "c2", "doc", "line", "w").unionByName(shorter.select("c", "c2", "doc", "line", "w"))
    pairs = pairs.where(F.struct("w.doc", "w.line") < F.struct("doc", "line")).select("c", "c2", F.col("w.c").alias("d"), F.col("w.c2").alias("d2")).distinct()
    own = near.select("c", "c2", "words")
    other = near.select(F.col("c").alias("d"), F.col("c2").alias("d2"), F.col("words").alias("words_"))
    close = pairs.join(own, ["c", "c2"]).join(other, ["d", "d2"]).select("c", "c2", "words", "words_").mapInArrow(_verify, "c long, c2 long").distinct()
    close = materialize(close.withColumn("near", F.lit(True)), "line-near")
    release(near, entries)
    first = places.groupBy("c", "c2").agg(F.min(F.struct("doc", "line")).alias("at"), F.count("*").alias("k"))
    first = first.join(close, ["c", "c2"], "left").where("k > 1 or near").select("c", "c2", "at", "k", F.coalesce("near", F.lit(False)).alias("near"))
    first = materialize(first, "line-first")
    gone = spread_join(places, first, ["c", "c2"], "k").where(F.col("near") | (F.struct("doc", "line") > F.col("at")))
    gone = materialize(gone.groupBy("doc").agg(F.collect_set("line").alias("lines")), "line-gone")
    release(written, close, first)
    return gone


def dedup_lines(docs: DataFrame, min_chars: int = 0, near_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines left as text, and n_lines and n_removed."""
    rows, names, columns = plain(docs, id_col, text_col, ("n_lines", "n_removed"))
    gone = repeated_lines(rows, min_chars, near_words, "id", "text")
    rest = [c for c in columns if c != "text"]
    # a shuffle at every size: what goes grows with the corpus, and a broadcast of it would not
    joined = rows.join(gone.hint("merge"), F.col("id").cast("long") == F.col("doc"), "left").select(*rest, "text", "lines")
    schema = StructType([*rows.select(*rest, "text").schema, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(_cut, schema).select(*columns, "n_lines", "n_removed").toDF(*names, "n_lines", "n_removed")
