"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage becomes a vector of surface figures and hashed byte
pairs, is encoded by a tanh layer, and gets a weight from gated attention (tanh times sigmoid); the weighted mean of
the encodings is what the last layer scores. Only document labels teach it. Features are made where the documents
are, whole texts included; the fit runs on the driver over at most `sample` labelled documents, those with the
smallest hashes of their id.

Defined results: a null or empty text is one passage without words and gets a score; documents without label are
scored and teach nothing; a repeated label counts once, the larger; with no label at all every score is 0.5; no
documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stallmark.llm.kernels import Words, mix, picked, ragged, segment_hashes, slices

PASSAGE, PAIRS, HIDDEN, GATE = 64, 96, 24, 16
#: Bytes of text whose features are made at once: some 100 bytes of memory for each.
TEXT_BYTES = 1 << 19
CLASSES = ["upper", "lower", "digit", "full stop, exclamation or question mark", "comma, semicolon or colon", "quote or bracket", "other sign", "beyond ASCII", "line end", "space"]


def _class_of() -> np.ndarray:
    c = np.full(256, 6, np.int64)
    c[65:91], c[97:123], c[48:58], c[128:] = 0, 1, 2, 7
    for chars, k in ((b".!?", 3), (b",;:", 4), (b"\"'()[]{}", 5), (b"\n\r", 8), (b" \t\x0b\x0c", 9)):
        c[list(chars)] = k
    return c


CLASS = _class_of()
SURFACE = len(CLASSES) + 9
WIDTH = SURFACE + PAIRS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and how many each text has (one at least)."""
    w = Words(texts)
    n_words = np.diff(w.first)
    count = np.maximum(-(-n_words // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(count)])
    total = int(base[-1])
    x = np.zeros((total, WIDTH), np.float32)
    if not len(w):
        return x, count
    doc = np.repeat(np.arange(len(n_words)), n_words)
    of = base[doc] + (np.arange(len(w)) - w.first[doc]) // PASSAGE
    words = np.maximum(np.bincount(of, minlength=total), 1).astype(np.float32)
    length = (w.end - w.start).astype(np.float64)
    head = np.concatenate([[True], of[1:] != of[:-1]])
    begin = np.full(total + 1, len(w.buf))
    begin[of[head]] = w.start[head]
    begin[base[:-1]] = w.offsets[:-1]  # white space around a text stays with it
    byte_of = np.repeat(np.arange(total), np.diff(begin))
    buf = w.buf
    kinds = np.bincount(byte_of * len(CLASSES) + CLASS[buf], minlength=total * len(CLASSES)).reshape(total, -1)
    size = np.maximum(np.diff(begin), 1).astype(np.float32)
    x[:, : len(CLASSES)] = kinds / size[:, None]
    lower = buf | np.uint8(32)
    pair = (lower[:-1].astype(np.uint32) * np.uint32(2654435761) + lower[1:].astype(np.uint32) * np.uint32(40503) * np.uint32(257)) >> np.uint32(11)
    bins = byte_of[:-1] * PAIRS + (pair % np.uint32(PAIRS)).astype(np.int64)
    across = w.offsets[1:-1] - 1
    bins[across[(across >= 0) & (across < len(bins))]] = total * PAIRS  # pairs of two texts count nowhere
    pairs = np.bincount(bins, minlength=total * PAIRS + 1)[:-1].reshape(total, -1)
    x[:, SURFACE:] = np.sqrt(pairs / size[:, None])
    mean = np.bincount(of, length, total) / words
    first, last = CLASS[w.buf[w.start]], CLASS[w.buf[w.end - 1]]
    h = segment_hashes(w.buf, w.start, w.end)
    distinct = np.bincount(np.unique((h >> np.uint64(40)) + (of.astype(np.uint64) << np.uint64(24))).astype(np.int64) >> 24, minlength=total)
    again = np.zeros(len(h), bool)
    if len(h) > 2:
        tri = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) ^ (doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, place, inv = np.unique(tri, return_index=True, return_inverse=True)
        again[:-2] = (place[inv] < np.arange(len(tri))) & (doc[:-2] == doc[2:])
    s = len(CLASSES)
    x[:, s] = np.log1p(mean)
    x[:, s + 1] = np.log1p(np.sqrt(np.maximum(np.bincount(of, length**2, total) / words - mean**2, 0)))
    x[:, s + 2] = np.bincount(of, first == 0, total) / words
    x[:, s + 3] = np.bincount(of, (last == 3) | (last == 4), total) / words
    x[:, s + 4] = np.bincount(of, last == 6, total) / words
    x[:, s + 5] = distinct / words
    x[:, s + 6] = np.bincount(of, again, total) / words
    x[:, s + 7] = np.log1p(words) / 4
    x[:, s + 8] = np.bincount(of, length <= 2, total) / words
    return x, count


@dataclass
class Model:
    """Weights of the encoder (w), the gate (v, u, a) and the last layer (c, b), after standardising."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    b: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) * self.scale, -6, 6) @ self.w)

    def attend(self, h: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weighted mean of each bag; the weights and both gates with it. bag: first row of each bag."""
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = np.exp(np.clip((t * g) @ self.a, -20, 20))
        of = np.repeat(np.arange(len(bag)), np.diff(np.append(bag, len(h))))
        e /= np.add.reduceat(e, bag)[of]
        return np.add.reduceat(h * e[:, None], bag), e, t, g

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(count):
            return np.zeros(0)
        z = self.attend(self.encode(x), np.concatenate([[0], np.cumsum(count)[:-1]]))[0]
        return 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30).astype(np.float64)))


def fit(x: np.ndarray, count: np.ndarray, label: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Model:
    """Gradient descent with Adam on the log loss of the bags."""
    r = np.random.default_rng(seed)
    draw = lambda *n: (r.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
    m = Model(x.mean(0), 1 / (x.std(0) + 1e-3), draw(WIDTH, HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))))
    names = ["w", "v", "u", "a", "c", "b"]
    first = {k: np.zeros_like(np.asarray(getattr(m, k), np.float32)) for k in names}
    second, step = {k: v.copy() for k, v in first.items()}, 0
    starts = np.concatenate([[0], np.cumsum(count)])
    z = np.clip((x - m.mean) * m.scale, -6, 6)
    for _ in range(epochs):
        order = r.permutation(len(label))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            n = count[pick]
            rows = np.repeat(starts[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            bag, of, xb = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(pick)), n), z[rows]
            h = np.tanh(xb @ m.w)
            pooled, e, t, g = m.attend(h, bag)
            d = ((1 / (1 + np.exp(-np.clip(pooled @ m.c + m.b, -30, 30))) - label[pick]) / len(pick)).astype(np.float32)
            dz = d[:, None] * m.c
            de = (h * dz[of]).sum(1)
            dl = e * (de - np.add.reduceat(e * de, bag)[of])
            dt, dg = dl[:, None] * m.a * g * (1 - t * t), dl[:, None] * m.a * t * g * (1 - g)
            dh = e[:, None] * dz[of] + dt @ m.v.T + dg @ m.u.T
            grad = {"w": xb.T @ (dh * (1 - h * h)), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ dl, "c": pooled.T @ d, "b": d.sum()}
            step += 1
            for k in names:
                now = np.asarray(getattr(m, k), np.float32)
                gk = grad[k] + decay * now
                first[k] = 0.9 * first[k] + 0.1 * gk
                second[k] = 0.999 * second[k] + 0.001 * gk * gk
                now = now - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, float(now) if k == "b" else now.astype(np.float32))
    return m


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", TEXT_BYTES):
            x, count = passages(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), ragged(x.ravel(), count * WIDTH, pa.float32()), b.column(2)], ["label", "n", "x", "key"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of labels.label_col; None without labelled documents. Reads `sample` documents at most."""
    known = picked(labels, i=id_col, label=label_col).where("label is not null and i is not null").groupBy("i").agg(F.max("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = picked(docs, i=id_col, text=text_col).select("i", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "i").select("label", "text", F.xxhash64("i", "text").alias("key"))
    got = rows.mapInArrow(_features, "label int, n long, x array<float>, key long").toArrow()
    if not got.num_rows:
        return None
    got = got.combine_chunks()
    x = got["x"].chunk(0).flatten().to_numpy().reshape(-1, WIDTH)
    count, label = got["n"].to_numpy(), got["label"].to_numpy().astype(np.float32)
    order = np.lexsort((label, count, got["key"].to_numpy()))  # the same whatever order rows came in
    starts = np.concatenate([[0], np.cumsum(count)])
    rows_of = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
    return fit(x[rows_of], count[order], label[order])


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with the columns score and predicted (1 from 0.5 on); they replace columns of these names."""
    at = next(i for same in (str, str.lower) for i, c in enumerate(docs.columns) if same(c) == same(text_col))
    left = [i for i, c in enumerate(docs.columns) if i == at or c.lower() not in ("score", "predicted")]
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(*(F.col(f"c{i}") for i in left), F.col(f"c{at}").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", TEXT_BYTES):
                s = np.full(b.num_rows, 0.5) if model is None else model.score(*passages(b.column(b.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema).toDF(*(docs.columns[i] for i in left), "score", "predicted")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the document's label may not teach: crc32 of the id as text leaves 1 modulo 3 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
