"""Order-preserving packing of documents into sequences of bounded length.

Each task packs its own documents in their order; nothing is shuffled. Cuts may fall between documents (free),
between sentences (a small penalty) or every `hard_every` ids of a document (a larger one). Over these positions a
dynamic program minimises padding plus penalties: the best last cut for a position is the smallest
cost + position among the cuts at most `length` ids back, which a monotone queue holds. A task works through
stretches of about `stretch` ids and carries its last, unfinished sequence over; what remains at its end becomes
sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is its end id alone; rows that repeat an id are packed one by one; a null id
stays null; no rows give no pieces; extra columns are ignored. Piece starts count ids of the row's own document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.llm.kernels import picked, ragged, slices
from stallmark.llm.tokens import word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SENTENCE, HARD = 4, 16
SPAN = 1 << 33


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Positions (0 and the last included) that minimise padding plus penalties; neighbours of pos lie at most
    length apart. With cost c(j) = min c(i) + length - (pos j - pos i) + penalty j, the key c + pos is what the
    queue orders by."""
    p, pen = pos.tolist(), penalty.tolist()
    key, back = [0] * len(p), [0] * len(p)
    queue = deque([0])
    for j in range(1, len(p)):
        least = p[j] - length
        while p[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = key[j] = key[i] + length + pen[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [p[-1]], len(p) - 1
    while j:
        j = back[j]
        cuts.append(p[j])
    return cuts[::-1]


class Packer:
    def __init__(self, length: int, ends: np.ndarray, hard_every: int, with_ids: bool):
        self.length, self.ends, self.hard_every, self.with_ids = length, ends, hard_every, with_ids
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, how many of them are packed
        self.pending, self.sequence = 0, TaskContext.get().partitionId() * SPAN if TaskContext.get() else 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.pending += len(ids)

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        pos, pen, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, done in self.docs:
            n = len(ids) - done
            mark = np.full(n + 1, -1, np.int64)
            mark[self.hard_every - done % self.hard_every : n : self.hard_every] = HARD
            mark[np.flatnonzero(self.ends[ids[done:-1]]) + 1] = SENTENCE
            mark[n], mark[0] = 0, -1
            at = np.flatnonzero(mark >= 0)
            pos.append(at + base)
            pen.append(mark[at])
            base += n
        return np.concatenate(pos), np.concatenate(pen)

    def flush(self, final: bool) -> None:
        if not self.pending:
            return
        cuts = best_cuts(*self._candidates(), self.length)
        if final:
            rest, at = cuts[-1] - cuts[-2], cuts.pop(-2) if len(cuts) > 2 else 0
            bits = [1 << b for b in range(self.length.bit_length(), -1, -1) if rest >> b & 1]
            cuts = [*(c for c in cuts if c < at), *(at + int(x) for x in np.cumsum([0, *bits]))]
        else:
            cuts.pop()
        self._emit(cuts)

    def _emit(self, cuts: list[int]) -> None:
        base, d = cuts[0], 0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = lo
            while at < hi:
                doc_id, ids, done = self.docs[d]
                n = min(hi - at, len(ids) - done)
                part = ids[done : done + n].astype("<u4")
                self.rows.append((doc_id, done, n, zlib.crc32(part.tobytes()), len(ids), self.sequence, at - lo, part))
                self.docs[d] = (doc_id, ids, done + n)
                d += done + n == len(ids)
                at += n
            self.sequence += 1
        self.docs, self.pending = self.docs[d:], self.pending - (cuts[-1] - base)

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if self.with_ids:
            arrays.append(ragged(np.concatenate(cols[7]).astype(np.int32), np.array(cols[2]), pa.int32()))
            names.append("ids")
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, length: int = 4096, vocabulary: str | None = None, end_id: int = 2, hard_every: int = 16, stretch: int = 1 << 18, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids)."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        size = coder.tokenizer.get_vocab_size()
        ends = np.zeros(size + end_id + 1, bool)
        ends[[i for w, i in coder.tokenizer.get_vocab().items() if w in (".</w>", "!</w>", "?</w>", '."</w>', '!"</w>', '?"</w>', ".)</w>")]] = True
        packer = Packer(length, ends, min(hard_every, length), with_ids)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = coder.encode(batch.column(1))
                for i, doc_id in enumerate(batch.column(0).to_pylist()):
                    packer.add(doc_id, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
                if packer.pending >= stretch:
                    packer.flush(final=False)
                    yield packer.take()
        packer.flush(final=True)
        if packer.rows:
            yield packer.take()

    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
