"""Near-duplicate vectors by randomised-rotation binary codes.

Equal vectors form a class (its smallest id stands for it). A class vector, made a unit vector and rotated at random,
leaves the signs of its components as a code, and the inner product of vector and code as a correction factor; both
are stored. For another unit vector y, (code . y) / factor estimates the inner product without bias. The angle of code
and y is at most that of code and vector plus that of vector and y, so a pair that links is never below the bound
this sets on code . y; pairs that reach it are recomputed exactly in double precision.

Candidates: further randomised rotations give every class `tables` keys of `bits` sign bits. Vectors at angle t agree in a bit
with probability 1 - t / pi, so a pair at the threshold meets in one table or more with probability
1 - (1 - (1 - t / pi) ** bits) ** tables; `bits` grows with the logarithm of the table, so that a bucket of unrelated vectors
stays near `block`, and `tables` follows from the recall asked for (0.98 at the threshold, more above it). Work and
shuffle grow as N ** 1.2 at 0.9, not as N squared. With recall=1 there are no bits: every two tiles of one dimension are met,
the exact way, whose work grows with the square.

A bucket above `block` is cut into tiles by hash, and each pair of its tiles is a task's group of 2 * block rows at most, so a
bucket with a third of all rows is many bounded groups. A pair counts in the first table alone in which its keys
agree. Tasks return link counts per vector and one edge per vector to the least vector it hangs together with, never
the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of unequal length are not compared; rows without id have no component and are not kept; rows that repeat an id and
a vector are copies of each other, and rows that repeat an id with other vectors are one node; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.llm.graph import components
from stallmark.llm.kernels import mix, picked, signed
from stallmark.llm.scratch import materialize, release, spread_join


def rotation(d: int, seed: int = 23) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factor <code, vector> of unit vectors."""
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded (rows) and rotated vectors (columns), and the half width of each row."""
    d = turned.shape[1]
    signs = np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1
    got = (signs @ turned.T.astype(np.float32)) / (np.sqrt(d) * factor[:, None])
    return got, width * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(d - 1, 1)) + 1e-5


def linked(a: np.ndarray, code: np.ndarray, factor: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors a and b with inner product of at least threshold; same: b is a, pairs i < j."""
    slack = 1e-6 + 2e-7 * a.shape[1]  # of products in single precision
    reach = np.cos(np.minimum(np.arccos(np.minimum(factor, 1)) + np.arccos(threshold), np.pi)) - slack
    got, _ = estimates(code, factor, b @ turn, 0)
    may = got >= (reach / factor)[:, None]
    if same:
        may = np.triu(may, 1)
    if 32 * np.count_nonzero(may) > may.size:
        may &= a.astype(np.float32) @ b.T.astype(np.float32) >= threshold - slack
    i, j = np.nonzero(may)
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
    return i[keep], j[keep]


def plan_tables(classes: int, block: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for so many classes; (0, 1), every pair, where that is as good or recall is 1."""
    bits = max(0, ceil(log(max(classes, 1) / block, 2)))
    if not bits or recall >= 1:
        return 0, 1
    agree = (1 - acos(min(max(threshold, -1.0), 1.0)) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - agree)))


def table_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each unit vector in each table, as longs that differ by table and dimension."""
    n, d = unit.shape
    turns = -(-bits * tables // d)
    signs = np.concatenate([unit @ rotation(d, 101 + i) >= 0 for i in range(turns)], axis=1) if turns else np.zeros((n, 0), bool)
    key = np.empty((n, tables), np.uint64)
    for t in range(tables):
        h = np.full(n, (d << 20) + t, np.uint64)
        for bit in signs[:, t * bits : (t + 1) * bits].T:
            h = mix(h * np.uint64(2) + bit)
        key[:, t] = mix(h)
    return signed(key)


def units(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors) of a column of lists, by dimension."""
    dims = np.diff(column.offsets.to_numpy())
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        raw = flat[(ends[at] - d)[:, None] + np.arange(d)]
        raw = raw / np.abs(raw).max(1, keepdims=True)
        yield d, at, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _cells(bits: int, tables: int):
    """(rep, cells) for rows (rep, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, at, unit in units(b.column(1)):
                keys = pa.FixedSizeListArray.from_arrays(pa.array(table_keys(unit, bits, tables).ravel()), tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), keys], ["rep", "cells"])

    return run


def _compare(threshold: float, bits: int, tables: int):
    """Rows (cell, lo, hi, part, t, rep, copies, v), sorted, to (a, n, b): n links (weighted by copies) of a, or an edge
    a - b. A group (cell, lo, hi) holds one tile or two."""

    def meet(t: int, split: int, rep: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> Iterator[tuple]:
        same = split == len(rep)
        turn = rotation(unit.shape[1])
        code, factor = encode(unit[:split], turn)
        i, j = linked(unit[:split], code, factor, unit if same else unit[split:], turn, threshold, same)
        j = j if same else j + split
        if t and len(i):
            keys = table_keys(unit, bits, t)
            mine = np.ones(len(i), bool)
            for s in range(t):
                mine &= keys[i, s] != keys[j, s]
            i, j = i[mine], j[mine]
        if not len(i):
            return
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        root = np.arange(len(rep))
        order = np.argsort(rep)
        rank = np.empty(len(rep), np.int64)
        rank[order] = root
        root = rank.copy()
        while True:
            low = np.minimum(root[i], root[j])
            was = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if (was == root).all():
                break
        for x in np.flatnonzero(links):
            yield int(rep[x]), int(links[x]), int(rep[order[root[x]]])

    def group(rows: list[tuple], lo: int, hi: int) -> Iterator[tuple]:
        part, t, rep, copies, v = zip(*rows, strict=True)
        split = sum(p == part[0] for p in part)
        if lo != hi and split == len(part):
            return  # the other tile is empty
        yield from meet(t[0], split, np.array(rep, np.int64), np.array(copies, np.int64), next(units(pa.array(v, pa.list_(pa.float64()))))[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for b in batches:
            cells = [b.column(x).to_pylist() for x in range(7)]
            vectors = [x.values.to_numpy() for x in b.column(7)]
            for cell, lo, hi, *row in zip(*cells, vectors, strict=True):
                if (cell, lo, hi) != key:
                    if rows:
                        out += group(rows, *key[1:])
                    key, rows = (cell, lo, hi), []
                    if len(out) > 8192:
                        yield _triples(out)
                        out = []
                rows.append(row)
        if rows:
            out += group(rows, *key[1:])
        if out:
            yield _triples(out)

    return run


def _triples(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "n", "b"])


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = picked(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & finite, F.lit(False)))
    rows = rows.select("id", "ok", F.when(F.col("ok"), F.xxhash64("v")).alias("h"), F.when(F.col("ok"), F.xxhash64(F.lit(7), "v")).alias("h2"), "v")
    classes = materialize(rows.where("ok").groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v")), "vector-classes")
    bits, tables = plan_tables(classes.count(), block, threshold, recall)
    cells = classes.select("h", "v").mapInArrow(_cells(bits, tables), "rep long, cells array<long>")
    cells = materialize(cells.select(F.col("rep").alias("h"), F.posexplode("cells").alias("t", "cell")), "vector-cells")
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    placed = cells.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("h", "cell", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "t")
    dealt = placed.join(classes.select("h", "rep", "copies", "v"), "h").select("cell", "lo", "hi", "part", "t", "rep", "copies", "v")
    dealt = dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "part")
    found = materialize(dealt.mapInArrow(_compare(threshold, bits, tables), "a long, n long, b long"), "vector-links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(found.where("a <> b"), "a", "b", "vector-groups").withColumnRenamed("node", "rep")
    known = classes.select("h", "h2", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left")
    known = known.select("h", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = materialize(known, "vector-known")
    release(classes, cells, found)
    narrow = rows.select("id", "h", "h2")
    met = spread_join(narrow.where("h is not null"), known, ["h", "h2"], "copies").select("id", "n_links", F.col("component").alias("component_id"))
    out = met.unionByName(narrow.where("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
