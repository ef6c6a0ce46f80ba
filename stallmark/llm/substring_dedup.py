"""Removal of word passages that an earlier document already holds.

A window is `length` consecutive words of one document. A word goes if a window covers it whose word sequence also
starts in a document with a smaller id. Windows are judged on the input.

1. Every window is charged to its anchor, the least hash among its `anchor`-word grams. Neighbouring windows with one
   anchor make a stretch. Equal windows have equal anchors, so only stretches whose anchor occurs in two documents
   matter, and stretches of equal content are judged once.
2. The distinct contents of an anchor are a reference shard (one with more than `shard` contents is dealt over several
   shards, each of which meets all contents of the anchor). A suffix automaton of the shard stores for each state the
   smallest document id among its occurrences. The contents stream through it: matching statistics, held at the state
   that owns the last `length` words, give the smallest document of every window.
3. Where that id is smaller than a stretch's own document, its windows become spans of the document. Maximal runs of
   covered words are removed.

The shards travel to tasks by hash of the anchor instead of being broadcast one after the other to all documents: every
document would meet every shard, which grows with the square of the corpus; the anchors say which can match.

Defined results: null or empty texts have no words; rows without id are returned whole and cover nothing; rows with
equal ids are one document that is no smaller than itself; texts under `length` words are returned whole; an empty
table gives no rows; columns beside id and text are passed through, the result's names win.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stallmark.llm.kernels import Words, grams, plain, ragged, signed, slices, sliding_min, span_hashes
from stallmark.llm.scratch import materialize, release, spread_join
from stallmark.llm.sketches import Filter, fill

#: Windows of one stretch at most; cutting longer ones (endless repetition) keeps contents short.
STRETCH = 256


class Automaton:
    """A suffix automaton of several sequences; low[v] is the least document in which state v's words occur."""

    def __init__(self):
        self.next, self.link, self.size, self.low = [{}], [-1], [0], [None]

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, size, low, last = self.next, self.link, self.size, self.low, 0
        for w in words:
            to = nxt[last].get(w)
            if to is not None and size[to] == size[last] + 1:
                last = to
            else:
                clone_only = to is not None
                if not clone_only:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    size.append(size[last] + 1)
                    low.append(None)
                    p = last
                    while p != -1 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                    if p == -1:
                        last = cur
                        if low[cur] is None or doc < low[cur]:
                            low[cur] = doc
                        continue
                    to = nxt[p][w]
                else:
                    p, cur = last, None
                if size[p] + 1 == size[to]:
                    link[cur] = to
                else:
                    clone = len(nxt)
                    nxt.append(nxt[to].copy())
                    link.append(link[to])
                    size.append(size[p] + 1)
                    low.append(None)
                    while p != -1 and nxt[p].get(w) == to:
                        nxt[p][w] = clone
                        p = link[p]
                    link[to] = clone
                    if cur is None:
                        cur = clone
                    else:
                        link[cur] = clone
                last = cur
            if low[last] is None or doc < low[last]:
                low[last] = doc

    def close(self) -> None:
        """Hands the least documents up the suffix links."""
        low, link = self.low, self.link
        for v in sorted(range(1, len(low)), key=self.size.__getitem__, reverse=True):
            up = link[v]
            if up > 0 and (low[up] is None or low[v] < low[up]):
                low[up] = low[v]

    def least(self, words: list[int], length: int) -> list[int | None]:
        """For each window of the words, the least document that holds it (None: no document)."""
        nxt, link, size, low, v, n, out = self.next, self.link, self.size, self.low, 0, 0, []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = size[v]
            to = nxt[v].get(w)
            if to is None:
                n = 0
            else:
                v = to
                n += 1
                while size[link[v]] >= length:
                    v = link[v]
                    n = size[v]
            if i + 1 >= length:
                out.append(low[v] if n >= length else None)
        return out


def _stretches(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column(1))
                h = w.hashes()
                f = sliding_min(grams(h, anchor), length - anchor + 1)
                if not len(f):
                    continue
                doc = np.repeat(np.arange(b.num_rows), np.diff(w.first))[: len(f)]
                at = np.flatnonzero(np.arange(len(f)) + length <= w.first[doc + 1])
                if not len(at):
                    continue
                head = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (f[at[1:]] != f[at[:-1]])])
                begin = np.flatnonzero(head)
                nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                begin = np.flatnonzero(nth % STRETCH == 0)
                start, n = at[begin], np.diff(np.append(begin, len(at)))
                own = doc[start]
                ids = b.column(0).take(pa.array(own))
                whole_hash = signed(span_hashes(h, w.first[:-1], w.first[1:]))[own]
                content = signed(span_hashes(h, start, start + n + length - 1))
                yield pa.RecordBatch.from_arrays([pa.array(signed(f[start])), pa.array(content), pa.array(n.astype(np.int32)), ids, pa.array(whole_hash), pa.array((start - w.first[own]).astype(np.int32))], ["f", "c", "n", "doc", "of_text", "start"])

    return run


def _contents(length: int):
    """Word hashes of the wanted stretches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column(0))
                h = w.hashes()
                own = signed(span_hashes(h, w.first[:-1], w.first[1:]))
                f, c, n, parts = [], [], [], []
                for i, wanted in enumerate(b.column(1).to_pylist()):
                    for x in wanted:
                        if x["of_text"] == own[i]:
                            at = w.first[i] + x["start"]
                            f.append(x["f"])
                            c.append(x["c"])
                            n.append(x["n"])
                            parts.append(h[at : at + x["n"] + length - 1])
                if f:
                    words = ragged(signed(np.concatenate(parts)), np.array([len(p) for p in parts]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), words], ["f", "c", "n", "words"])

    return run


def _met(may):
    """Only the rows whose document may be wanted, so that other texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = may.value
        for b in batches:
            yield b.filter(pa.array(known(b.column(0).to_numpy(zero_copy_only=False))))

    return run


def _match(length: int):
    """Rows (f, part, role, c, n, low, high, words), sorted; role 0 builds, 1 streams, 2 does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, both, out = None, None, [], []

        def stream(f: int, c: int, n: int, high: int, words: list[int]) -> None:
            run_from, run_low = 0, None
            for i, low in enumerate([*automaton.least(words, length), None]):
                if low != run_low:
                    if run_low is not None and run_low < high:
                        out.append((f, c, n, run_from, i - 1, run_low))
                    run_from, run_low = i, low

        def finish() -> None:
            nonlocal both
            if both:
                automaton.close()
                for row in both:
                    stream(*row)
            both = []

        for b in batches:
            for f, part, role, c, n, low, high, words in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (f, part) != key:
                    finish()
                    key, automaton, closed = (f, part), Automaton(), False
                if role != 1:
                    automaton.add(words, low)
                if role == 2:
                    both.append((f, c, n, high, words))
                if role == 1:
                    if not closed:
                        automaton.close()
                        closed = True
                    stream(f, c, n, high, words)
            if len(out) > 4096:
                yield _rows(out)
                out.clear()
        finish()
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["f", "c", "n", "lo", "hi", "low"])


def repeated_spans(docs: DataFrame, length: int = 50, anchor: int = 5, shard: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans): for each document the word spans (of_text, lo, hi) that an earlier document holds."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    stretches = materialize(rows.mapInArrow(_stretches(length, anchor), "f long, c long, n int, doc long, of_text long, start int"), "stretches")
    anchors = stretches.groupBy("f").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count("*").alias("copies")).where("a < z").select("f", "copies")
    anchors = materialize(anchors, "stretches-anchors")
    met = materialize(spread_join(stretches, anchors, ["f"], "copies").drop("copies"), "stretches-met")
    release(stretches, anchors)
    contents = met.groupBy("f", "c", "n").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("copies"))
    many = contents.groupBy("f").agg(F.count("*").alias("k")).where("k > 1")
    contents = contents.join(many, "f", "left").select("f", "c", "n", "low", "high", "copies", F.coalesce("k", F.lit(1)).alias("k"))
    contents = materialize(contents, "stretches-contents")
    known = materialize(spread_join(met, contents, ["f", "c", "n"], "copies").drop("copies"), "stretches-known")
    release(met)
    alone = known.where("k = 1 and low < doc").select("doc", "of_text", F.col("start").alias("lo"), (F.col("start") + F.col("n") + length - 1).alias("hi"))
    several = contents.where("k > 1").drop("copies")
    wanted = known.where("k > 1 and doc = low").groupBy("doc").agg(F.collect_list(F.struct("of_text", "start", "f", "c", "n")).alias("wanted"))
    wanted = materialize(wanted, "stretches-wanted")
    may = docs.sparkSession.sparkContext.broadcast(fill(wanted.select("doc"), wanted.count()))
    words = rows.mapInArrow(_met(may), "doc long, text string").join(wanted, "doc").select("text", "wanted").mapInArrow(_contents(length), "f long, c long, n int, words array<long>")
    words = words.join(several, ["f", "c", "n"]).withColumn("parts", F.ceil(F.col("k") / shard).cast("int"))
    role = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("part"), F.lit(2).alias("role")))).otherwise(
        F.concat(F.array(F.struct(F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"))), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(1).alias("role"))))
    )
    dealt = words.withColumn("r", F.explode(role)).select("f", "r.part", "r.role", "c", "n", "low", "high", "words")
    dealt = dealt.repartition("f", "part").sortWithinPartitions("f", "part", "role")
    found = dealt.mapInArrow(_match(length), "f long, c long, n int, lo int, hi int, low long").distinct()
    hits = known.where("k > 1").drop("low").join(found, ["f", "c", "n"]).where("low < doc").select("doc", "of_text", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + length).alias("hi"))
    return alone.unionByName(hits).groupBy("doc").agg(F.collect_list(F.struct("of_text", "lo", "hi")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, whole.schema.names[-2]):
            rows = b.num_rows
            n, gone, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
            spans = b.column(b.num_columns - 1).to_pylist()
            for i, text in enumerate(b.column(b.num_columns - 2).to_pylist()):
                words = (text or "").encode().split()
                n[i] = len(words)
                if spans[i]:
                    w = Words(pa.array([text]))
                    own = int(signed(span_hashes(w.hashes(), w.first[:-1], w.first[1:]))[0])
                    cover = np.zeros(len(words) + 1, np.int64)
                    for s in spans[i]:
                        if s["of_text"] == own:
                            cover[s["lo"]] += 1
                            cover[s["hi"]] -= 1
                    keep = np.cumsum(cover[:-1]) == 0
                    gone[i] = len(words) - int(keep.sum())
                    words = compress(words, keep.tolist())
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), pa.array(n), pa.array(gone), pa.array(kept, pa.string())], [*b.schema.names[:-2], "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the text, with n_words, n_removed and kept (the words left, joined by one space)."""
    rows, names, columns = plain(docs, id_col, text_col, ("n_words", "n_removed", "kept"))
    spans = repeated_spans(rows, length, id_col="id", text_col="text", **options)
    rest = [c for c in columns if c != "text"]
    joined = rows.join(spans, F.col("id").cast("long") == F.col("doc"), "left").select(*rest, "text", "spans")
    schema = StructType([*rows.select(*rest).schema, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return joined.mapInArrow(_cut, schema).toDF(*(n for n, c in zip(names, columns, strict=True) if c != "text"), "n_words", "n_removed", "kept")
