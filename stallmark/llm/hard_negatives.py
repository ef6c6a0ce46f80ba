"""Hard negatives of anchors by products that a principal-component rotation lets end early.

Components become integers floor(scale * x). The rows are dealt into groups; each group turns its vectors once by the
eigenvectors of the sum of all outer products, the leading ones first. A product with an anchor is added up one block of
leading components at a time: what the rest can still add lies within the product of the two residual norms, plus a slack
for the rounding of the rotation. Rows that can no longer be among the first k, or lie in the window of scores, leave; the
survivors' scores are integer products of the unturned vectors, so the rotation decides nothing but the work.

First every anchor gets its positives, the best rows of its own label; each positive's score sets a window, and a second
pass finds the best rows of other labels in it. Groups are as large as a task's memory allows, since an anchor is sent to
each of them; the best k of every group meet in one ranking.

Defined results: rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no
part; vectors of unequal length are not compared; an anchor never meets rows of its own id; of anchor rows that repeat an
id the smallest (label, vector) counts; repeated other rows each count; ties go to the smaller id; a positive whose score
is negative has no window; an empty table gives no rows. Scores beyond the range of a long are clamped to it before they
are compared. Vectors with components of which such products could be made are met by exact integers one by one. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.llm.kernels import picked
from stallmark.llm.scratch import materialize

MOST, LONG = float(np.finfo(np.float64).max), (1 << 63) - 1
#: Vector lengths that get a rotation (the most frequent), and the longest of them; others keep their axes.
ROTATED, LONGEST = 4, 1024
FOUND = "anchor_id long, n int, positive_id long, positive_score long, id long, score long"


def wide(m: np.ndarray) -> np.ndarray:
    """Which rows hold components so large that a product of two rows may leave the range of a long."""
    return np.abs(m).max(axis=1, initial=0) > isqrt((1 << 62) // max(m.shape[1], 1))


def whole(column: pa.Array, scale: float) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(scale * column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]), -MOST, MOST)
    return np.split(flat, offsets[1:-1] - offsets[0]) if len(column) else []


def clamped(a: np.ndarray, b: np.ndarray) -> int:
    return min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), -LONG - 1), LONG)


class Group:
    """Rows of one length, turned, with the norms of what is left behind each block of components."""

    def __init__(self, ids: list[int], labels: list[str], vectors: list[np.ndarray], turn: np.ndarray | None, block: int):
        self.codes: dict[str, int] = {}
        self.ids, m = np.array(ids, np.int64), np.array(vectors)
        self.labels = np.array([self.codes.setdefault(x, len(self.codes)) for x in labels], np.int64)
        self.m, d = m, m.shape[1]
        self.big = np.flatnonzero(wide(m))
        self.fine = np.flatnonzero(~wide(m))
        self.turn = np.eye(d) if turn is None else turn
        self.cuts = [*range(0, d, block), d] if d else [0, 0]
        self.slack = np.linalg.norm(self.turn.T @ self.turn - np.eye(d)) + 64 * (d + 16) * np.finfo(float).eps
        turned = m[self.fine] @ self.turn
        left = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.turned = turned
        self.rest = np.sqrt(np.stack([left[:, c] if c < d else np.zeros(len(turned)) for c in self.cuts], axis=1))
        self.norm = np.linalg.norm(m[self.fine], axis=1)

    def heads(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The turned anchors q, and the products of their first blocks with those of all rows."""
        q = q @ self.turn
        return q, q[:, : self.cuts[1]] @ self.turned[:, : self.cuts[1]].T

    def best(self, at: np.ndarray, others: np.ndarray, q: np.ndarray, turned: np.ndarray, head: np.ndarray, k: int, lo: int, hi: int) -> list[tuple[int, int]]:
        """(id, score) of the k best scores from lo to hi: of rows `at` of the fine ones by bounds, of `others` one by one.
        Without head, all are met one by one."""
        if head is None:
            others, at = np.concatenate([others, self.fine[at]]), at[:0]
        low, high = lo - 1 - abs(lo) * 1e-12, hi + 1 + abs(hi) * 1e-12
        part, rest, norm = (head[at] if head is not None else np.zeros(0)), None, float(np.linalg.norm(q)) if head is not None else 0.0
        for b in range(1, len(self.cuts)):
            if len(at) <= 2 * k:
                break
            if b > 1:
                c = slice(self.cuts[b - 1], self.cuts[b])
                part = part + self.turned[at, c] @ turned[c]
            rest = float(np.linalg.norm(turned[self.cuts[b] :]))
            reach = rest * self.rest[at, b] + self.slack * norm * self.norm[at] + 1e-6
            least, most = part - reach, part + reach
            keep = (most >= low) & (least <= high)
            sure = least[(least >= lo + 1) & (most <= hi - 1)]
            if len(sure) >= k:
                keep &= most >= np.partition(sure, len(sure) - k)[len(sure) - k]
            at, part = at[keep], part[keep]
        score = self.m[self.fine[at]].astype(np.int64) @ q.astype(np.int64) if len(at) else np.zeros(0, np.int64)
        found = [(int(s), int(i)) for s, i in zip(score, self.ids[self.fine[at]], strict=True)] + [(clamped(self.m[i], q), int(self.ids[i])) for i in others.tolist()]
        return [(i, s) for s, i in sorted((x for x in found if lo <= x[0] <= hi), key=lambda x: (-x[0], x[1]))[:k]]


def _meet(k: int, share: tuple[int, int] | None, scale: float, turns: dict[int, np.ndarray], block: int):
    """Anchors with the rows of their group: without share the k best of the anchor's label, else of other labels the k
    best for each of its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, raw, ready = None, {}, {}
        for batch in batches:
            out = []
            g, role = batch["g"].to_numpy(), batch["role"].to_numpy()
            ids, labels, positives, vectors = batch["id"].to_pylist(), batch["label"].to_pylist(), batch["positives"].to_pylist(), whole(batch["v"], scale)
            waiting: dict[int, list[int]] = {}
            for i in range(batch.num_rows):
                if g[i] != group:
                    out += [x for d, a in waiting.items() for x in met(ready[d], a, ids, labels, positives, vectors)]
                    group, raw, ready, waiting = g[i], {}, {}, {}
                v = vectors[i]
                if role[i] == 0:
                    for x, y in zip(raw.setdefault(len(v), ([], [], [])), (ids[i], labels[i], v), strict=True):
                        x.append(y)
                    continue
                if len(v) in raw:
                    ready[len(v)] = Group(*raw.pop(len(v)), turns.get(len(v)), block)
                if len(v) in ready:
                    waiting.setdefault(len(v), []).append(i)
            out += [x for d, a in waiting.items() for x in met(ready[d], a, ids, labels, positives, vectors)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if j == 1 else pa.int64()) for j, x in enumerate(zip(*out, strict=True))], ["anchor_id", "n", "positive_id", "positive_score", "id", "score"])

    def met(of: Group, anchors: list[int], ids: list, labels: list, positives: list, vectors: list) -> Iterator[tuple]:
        for lo in range(0, len(anchors), 64):
            some = anchors[lo : lo + 64]
            q = np.array([vectors[i] for i in some])
            large = wide(q)
            turned, heads = of.heads(np.where(large[:, None], 0.0, q))
            for j, i in enumerate(some):
                own = of.labels == of.codes.get(labels[i], -1)
                mine = (own if share is None else ~own) & (of.ids != ids[i])
                at, others = np.flatnonzero(mine[of.fine]), of.big[mine[of.big]]
                head = None if large[j] else heads[j]
                windows = [(0, None, None, -LONG - 1, LONG)] if share is None else [(n, p, s, -(-share[0] * s // 100), share[1] * s // 100) for n, p, s in map(dict.values, positives[i])]
                for n, p, s, least, most in windows:
                    if least <= most:
                        yield from ((ids[i], n, p, s, *x) for x in of.best(at, others, q[j], turned[j], head, k, least, most))

    return run


def _outer(lengths: list[int], scale: float):
    """Sums of outer products for each of the lengths, the upper triangle row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((d, d)) for d in lengths}
        for b in batches:
            by: dict[int, list] = {}
            for v in whole(b["v"], scale):
                by.setdefault(len(v), []).append(v)
            for d in sums.keys() & by.keys():
                m = np.array(by[d])
                m = m[~wide(m)]
                sums[d] += m.T @ m
        for d, s in sums.items():
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d - i, d, np.int32)), pa.array(np.full(d - i, i, np.int32)), pa.array(np.arange(i, d, dtype=np.int32)), pa.array(s[i, i:])], ["d", "i", "j", "s"])

    return run


def rotations(rows: DataFrame, lengths: list[int], scale: float) -> dict[int, np.ndarray]:
    """For each length the eigenvectors of the sum of outer products of all rows, those of large eigenvalues first."""
    if not lengths:
        return {}
    got = rows.mapInArrow(_outer(lengths, scale), "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    found = {}
    for d in lengths:
        own = got.filter(pa.compute.equal(got["d"], d))
        s = np.zeros((d, d))
        s[own["i"].to_numpy(), own["j"].to_numpy()] = s[own["j"].to_numpy(), own["i"].to_numpy()] = own["s"].to_numpy()
        found[d] = np.ascontiguousarray(np.linalg.eigh(s)[1][:, ::-1])
    return found


def mine_negatives(vectors: DataFrame, is_anchor: Callable[[Column], Column], relabel: Callable[[Column, Column], Column] | None = None, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, group_bytes: int = 32 << 20, dims_per_block: int = 16) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is_anchor says, and
    each of its first `positives` rows of the same label, the first `negatives` rows of other labels whose scores are
    share[0] to share[1] per cent of the positive's. relabel(id, label) gives the label that counts."""
    rows = picked(vectors, id=id_col, label=label_col, v=vector_col).select(F.col("id").cast("long").alias("id"), "label", F.col("v").cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", (relabel(F.col("id"), F.col("label")) if relabel else F.col("label")).cast("string").alias("label"), "v").where("label is not null")
    total = rows.agg(F.count("*"), F.sum(F.size("v"))).first()
    groups = max(1, -(-(total[1] or 0) * 8 // group_bytes), min(rows.sparkSession.sparkContext.defaultParallelism, -(-total[0] // 4096)))
    often = rows.groupBy(F.size("v").alias("d")).count().where(F.col("d").between(2, LONGEST)).orderBy(F.desc("count"), "d").limit(ROTATED).collect()
    turns = rotations(rows, [r.d for r in often], scale)
    none = F.lit(None).cast("array<struct<n:int,id:long,score:long>>")
    candidates = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("role"), "id", "label", "v", none.alias("positives"))
    anchors = rows.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")

    def best(asking: DataFrame, k: int, window: tuple[int, int] | None) -> DataFrame:
        sent = asking.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("role"), "id", "label", "v", "positives")
        cells = candidates.unionByName(sent).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "role", "id")
        order = Window.partitionBy("anchor_id", "n").orderBy(F.desc("score"), "id")
        return cells.mapInArrow(_meet(k, window, scale, turns, dims_per_block), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = best(anchors.withColumn("positives", none), positives, None)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), "id", "score"))).alias("positives"))
    asking = materialize(anchors.join(near, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "hard-negatives")
    return best(asking, negatives, share).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
