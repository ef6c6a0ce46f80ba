"""Exact top-k inner-product search by columnar branch and bound.

Components become integers floor(scale * x). Candidates are dealt into groups of about `group_rows`; each group is
laid out dimension by dimension (one row of the matrix per dimension). A query accumulates its scores one block of
dimensions at a time, heaviest block first. By Cauchy-Schwarz what the unread blocks can still add lies within
|query rest| * |candidate rest|; candidates whose upper bound is under the k-th best lower bound are dropped and the
survivors compacted. The best k of every group meet in one ranking per query.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; vectors of unequal
length are not compared; a query row never meets rows of its own id; of sound query rows that repeat an id the smallest
vector counts; repeated candidate rows each count; fewer than k candidates give fewer rows; an empty table gives no
rows. Scores beyond the range of a long are clamped to it. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.llm.kernels import picked

EXACT, MOST = float(1 << 53), float(np.finfo(np.float64).max)


def best_of(ids: np.ndarray, cols: np.ndarray, qid: int, q: np.ndarray, k: int, block: int) -> list[tuple[int, int]]:
    """(id, score) of the k largest inner products of q with the columns of cols (dimensions x candidates)."""
    d = len(q)
    if float(np.abs(cols).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d, 1) >= EXACT:
        keep = ids != qid
        exact = [sum(int(a) * int(b) for a, b in zip(q, c, strict=True)) for c in cols.T[keep]]
        exact = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], dtype=np.int64)
        top = np.lexsort((ids[keep], -exact.astype(object)))[:k] if len(exact) else []
        return [(int(ids[keep][i]), int(exact[i])) for i in top]
    blocks = [slice(i, min(i + block, d)) for i in range(0, d, block)]
    blocks.sort(key=lambda b: -float(q[b] @ q[b]))
    rest_q = float(q @ q)
    alive = np.flatnonzero(ids != qid)
    score = np.zeros(len(alive))
    rest_c = np.einsum("ij,ij->j", cols, cols)[alive]
    for n, b in enumerate(blocks):
        part = cols[b][:, alive] if len(alive) < len(ids) else cols[b]
        score = score + q[b] @ part
        if n + 1 == len(blocks):
            break
        rest_q -= float(q[b] @ q[b])
        rest_c = rest_c - np.einsum("ij,ij->j", part, part)
        if len(alive) > k:
            reach = np.sqrt(max(rest_q, 0.0)) * np.sqrt(rest_c) * (1 + 1e-9) + 1e-3
            floor = np.partition(score - reach, len(alive) - k)[len(alive) - k]
            keep = score + reach >= floor
            alive, score, rest_c = alive[keep], score[keep], rest_c[keep]
    top = np.lexsort((ids[alive], -score))[:k]
    return [(int(ids[alive[i]]), int(score[i])) for i in top]


def _whole(column: pa.Array, scale: float) -> list[np.ndarray]:
    """The vectors as integers; beyond the range of doubles they are the largest double, of their sign."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(scale * flat), -MOST, MOST)
    return [flat[offsets[i] : offsets[i + 1]] for i in range(len(column))]


def _search(k: int, scale: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, by_dim, ready = None, {}, {}
        for batch in batches:
            out = []
            g, role, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vectors = _whole(batch.column(3), scale)
            for i in range(batch.num_rows):
                if g[i] != group:
                    group, by_dim, ready = g[i], {}, {}
                v = vectors[i]
                if role[i] == 0:
                    by_dim.setdefault(len(v), ([], []))[0].append(ids[i])
                    by_dim[len(v)][1].append(v)
                    continue
                if len(v) not in ready and len(v) in by_dim:
                    a, m = by_dim.pop(len(v))
                    ready[len(v)] = np.array(a, np.int64), np.ascontiguousarray(np.array(m).T)
                if len(v) in ready:
                    out += [(int(ids[i]), a, s) for a, s in best_of(*ready[len(v)], int(ids[i]), v, k, block)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column | Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, group_rows: int = 8192, dims_per_block: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row, ties to the smaller id. is_query is a
    function of the id, or a Column of the table, whose names must then be plain."""
    if callable(is_query):
        vectors, is_query, id_col, vector_col = picked(vectors, id=id_col, v=vector_col), is_query(F.col("id")), "id", "v"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    groups = max(1, -(-vectors.count() // group_rows))
    candidates = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("role"), "id", "v")
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("role"), "id", "v")
    cells = candidates.unionByName(queries).repartition("g").sortWithinPartitions("g", "role", "id")
    found = cells.mapInArrow(_search(k, scale, dims_per_block), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
