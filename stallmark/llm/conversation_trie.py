"""The trie of all prefixes that conversations share, from their sorted order.

A conversation is a sequence of turns; each turn becomes a cell of 20 bytes, half a SHA-256 of (role, text) and the code
points of the text, so the cells of a conversation on end are a key whose order keeps equal prefixes side by side. Equal
conversations meet first and leave one row. The keys are dealt by range and cut into blocks; consecutive keys give an LCP
array, and its all-nearest-smaller-values its Cartesian tree: a stack closes an interval when a smaller value comes, equal
values are one node, and each interval's chain of depths up to its parent's is expanded. Counts, minima and weights of a
subtree are those of its interval.

Nodes that contain the first or the last conversation of a block may go on beyond it. They are given out as parts; where
a part's node begins is the nearest block to the left whose minimum (of the LCPs within it and the one with the block
before) is smaller than its depth, found by doubling over the block minima. Parts of one node then meet by key. Tasks hold
one block at a time; of each block the driver holds five numbers.

Defined results: rows without conv_id take no part; null roles and texts are empty; turns are ordered by turn, null first,
equal ones by the digest of (role, text), and repeated rows are turns of their own; a conversation with no turn left is a
member of the root alone; an empty table gives no rows. Other columns are ignored, whatever their names. A conversation of
any length is one record: 40 bytes a turn, within Spark's 2 GB for a value (50 million turns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.llm.kernels import picked
from stallmark.llm.scratch import materialize, release

CELL, EMPTY = 20, hashlib.sha256(b"").hexdigest()
#: Bytes of keys in a block, of a key that range bounds look at, and how many neighbouring ids go together.
BLOCK_BYTES, BOUND_BYTES, IDS = 16 << 20, 2000, 1 << 16
INSIDE, FIRST, LAST, BLOCK = 0, 1, 2, 3
NODE = "block long, kind int, whole boolean, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, last_length long, parent_conv_id long, parent_kind int, ends string, first_key binary, last_key binary"
NAMES = [c.split()[0] for c in NODE.split(", ")]


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, cells): a conversation's turns in order, each a cell in hex. Tasks gather their own turns before the shuffle."""
    rows = picked(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    cell = F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "cell")))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", cell.alias("cell")).groupBy("conv_id").agg(turns.alias("turns"))
    return rows.select("conv_id", F.col("turns.cell").alias("cells"))


def branched(seqs: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], longest: int) -> DataFrame:
    """Each conversation with its first head(conv_id) turns (at most `longest`) taken from conversation base(conv_id) instead,
    where that has so many. base(base(c)) must be base(c)."""
    c = F.col("conv_id")
    heads = seqs.where(base(c) == c).select(c.alias("base"), F.slice("cells", 1, longest).alias("theirs"))
    rows = seqs.select("conv_id", "cells", base(c).alias("base"), head(c).cast("int").alias("h")).join(heads, "base", "left")
    theirs = F.coalesce(F.slice("theirs", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    return rows.select("conv_id", F.concat(theirs, F.slice("cells", F.col("h") + 1, F.greatest(F.size("cells") - F.col("h"), F.lit(0)))).alias("cells"))


def lcps(keys: list[bytes]) -> np.ndarray:
    """LCP in cells of each key with the one before (the first entry is -1)."""
    n = np.array([len(k) // CELL for k in keys], np.int64)
    cells = np.frombuffer(b"".join(keys), np.uint32).reshape(-1, CELL // 4)
    at = np.concatenate([[0], np.cumsum(n)])
    short = np.minimum(n[1:], n[:-1])
    ends = np.cumsum(short)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - short, short)
    differ = np.flatnonzero((cells[np.repeat(at[1:-1], short) + within] != cells[np.repeat(at[:-2], short) + within]).any(axis=1))
    first = np.append(differ, len(within))[np.searchsorted(differ, ends - short)]
    return np.concatenate([[-1], np.minimum(first - (ends - short), short)]).astype(np.int64)


def intervals(lcp: np.ndarray, least: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(left, right, depth, depth of the parent, minimum, equal values) of each node of the Cartesian tree: the interval over
    which no LCP is smaller than depth. least has the value of each leaf of which minima are made."""
    out, stack = [], []  # of [depth, left, minimum, equal values]
    values = [*lcp[1:].tolist(), -1]
    for i, v in enumerate(values):
        left, low = i, least[i]
        while stack and stack[-1][0] > v:
            depth, left, m, equal = stack.pop()
            low = min(low, m)
            out.append((left, i, depth, max(v, stack[-1][0] if stack else -1), low, equal))
        if stack and stack[-1][0] == v:
            stack[-1][2] = min(stack[-1][2], low)
            stack[-1][3] += 1
        elif v >= 0:
            stack.append([v, left, low, 1])
    return out


def block_nodes(block: int, keys: list[bytes], counts: list[int], least: list[int], ends: list[str]) -> Iterator[pa.RecordBatch]:
    """All nodes of a block of sorted distinct keys, and a row of kind BLOCK with what its neighbours must know."""
    m, n, lcp = len(keys), np.array([len(k) // CELL for k in keys], np.int64), lcps(keys)
    at = np.concatenate([[0], np.cumsum(n)])
    lengths = np.frombuffer(b"".join(keys), ">u4").reshape(-1, CELL // 4)[:, -1].astype(np.int64)
    inner = np.array(intervals(lcp, least), np.int64).reshape(-1, 6)
    after = np.append(lcp[1:], -1)
    leaf = np.stack([np.arange(m), np.arange(m), n, np.maximum(lcp, after), np.array(least, np.int64), np.zeros(m, np.int64)], axis=1)
    tree = np.concatenate([inner, leaf[n > leaf[:, 3]]])
    is_leaf = np.concatenate([np.zeros(len(inner), bool), np.ones(len(tree) - len(inner), bool)])
    chain = tree[:, 2] - tree[:, 3]
    own = np.repeat(np.arange(len(tree)), chain)
    depth = tree[own, 3] + 1 + np.arange(len(own)) - np.repeat(np.cumsum(chain) - chain, chain)
    order = np.lexsort((depth, tree[own, 0]))
    own, depth = own[order], depth[order]
    left, right, low = tree[own, 0], tree[own, 1], tree[own, 4]
    bottom = depth == tree[own, 2]
    children = np.where(~bottom, 1, np.where(is_leaf[own], 0, tree[own, 5] + 1 - (n[left] == depth)))
    children -= (left == 0) & (n[0] > depth)  # the child with the first key counts in the block in which it begins
    total = np.concatenate([[0], np.cumsum(counts)])
    final = np.concatenate([[0], np.cumsum(n[:-1] > after[:-1]), [0]])
    final[-1] = final[-2]  # whether the last key is a leaf is for the next block to say
    convs = total[right + 1] - total[left]
    last = np.where(depth > 0, lengths[np.minimum(at[left] + depth - 1, max(len(lengths) - 1, 0))] if len(lengths) else 0, 0)
    kind = np.where(left == 0, FIRST, np.where(right == m - 1, LAST, INSIDE))
    weight = np.concatenate([[0], np.cumsum(np.where(kind == INSIDE, (convs - 1) * last, 0))])
    saved = weight[np.searchsorted(left, right, "right")] - weight[:-1]
    size = len(own)
    by_depth = np.sort(depth * size + np.arange(size))
    parent = by_depth[np.searchsorted(by_depth, (depth - 1) * size + np.arange(size)) - 1] % max(size, 1)
    has, inside = depth > 0, kind[parent] == INSIDE
    ended = np.where(depth == n[left], np.array(ends, object)[left], EMPTY)
    columns = [np.full(size, block), kind, right == m - 1, depth, low, convs, children, final[right + 1] - final[left], saved, last]
    for i in range(0, size, 1 << 16):
        s = slice(i, i + (1 << 16))
        k = len(own[s])
        arrays = [pa.array(c[s]) for c in columns]
        arrays += [pa.array(low[parent][s], mask=~(has & inside)[s]), pa.array(np.where(has, kind[parent], INSIDE)[s]), pa.array(ended[s], pa.string()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())]
        yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, TYPES, strict=True)], NAMES)
    within = int(lcp[1:].min()) if m > 1 else int(n[0])
    row = dict.fromkeys(NAMES) | {"block": block, "kind": BLOCK, "depth": within, "n_convs": int(n[0]), "n_leaves": int(n[-1]), "first_key": keys[0], "last_key": keys[-1]}
    yield pa.RecordBatch.from_pylist([row], pa.schema(list(zip(NAMES, TYPES, strict=True))))


TYPES = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in NODE.split(", ")]


def _blocks(block_bytes: int):
    """Sorted (key, ids) in, the nodes of blocks out. The ids of a key come in runs, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        keys, counts, least, ends = [], [], [], []
        key, digest = None, None
        for b in batches:
            for k, ids in zip(b["key"].to_pylist(), b["ids"], strict=True):
                ids = ids.values.to_numpy()
                text = ",".join(map(str, ids.tolist())).encode()
                if k == key:
                    counts[-1] += len(ids)
                    digest.update(b",")
                else:
                    if digest:
                        ends.append(digest.hexdigest())
                    if held >= block_bytes:
                        yield from block_nodes(block, keys, counts, least, ends)
                        block, held, keys, counts, least, ends = block + 1, 0, [], [], [], []
                    key, digest = k, hashlib.sha256()
                    keys.append(k)
                    counts.append(len(ids))
                    least.append(int(ids[0]))
                    held += len(k) + CELL
                digest.update(text)
        if keys:
            yield from block_nodes(block, keys, counts, least, [*ends, digest.hexdigest()])

    return run


class Blocks:
    """What the driver knows of the blocks, in their order: the least LCP within each (`low`), the LCP with the block before
    (`before`), and how many turns the first and the last conversation have."""

    def __init__(self, block: list[int], low: list[int], first: list[int], last: list[int], before: list[int]):
        self.block, self.low, self.first, self.last, self.before = (np.array(x, np.int64) for x in (block, low, first, last, before))
        self.after = np.append(self.before[1:], -1)
        self.least = np.minimum(self.low, self.before)

    def begin(self, k: np.ndarray, kind: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, kind) of the part with which the node of each part begins."""
        tables = [self.least]  # tables[t][i]: the minimum of the 2 ** t blocks that end with i
        while 1 << len(tables) <= len(self.least):
            t, half = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.minimum(t, np.concatenate([np.full(half, -1), t[:-half]])))
        on = (kind == FIRST) & (depth <= self.before[k])
        at = np.where(on, k - 1, k)
        for t in range(len(tables) - 1, -1, -1):
            at = np.where(on & (tables[t][np.maximum(at, 0)] >= depth), at - (1 << t), at)
        at = np.maximum(at, 0)  # the root has no parent
        return at, np.where(on, np.where(self.low[at] < depth, LAST, FIRST), kind)


def _boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [int(lcps([x, y])[1]) for x, y in zip(b["last_key"].to_pylist(), b["first_key"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["block"], pa.array(got, pa.int64())], ["block", "before"])


def _placed(blocks: Blocks):
    """Parts with the block and kind with which their node begins, and counts that neighbours decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, kind, depth = np.searchsorted(blocks.block, b["block"].to_numpy()), b["kind"].to_numpy(), b["depth"].to_numpy()
            owner, side = blocks.begin(k, kind, depth)
            children = (kind == FIRST) & (blocks.first[k] > depth) & (depth + 1 > blocks.before[k])
            leaves = b["whole"].to_numpy(zero_copy_only=False) & (blocks.after[k] < blocks.last[k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k), pa.array(owner), pa.array(side.astype(np.int32)), pa.array(children.astype(np.int64)), pa.array(leaves.astype(np.int64))], [*b.schema.names, "k", "owner", "side", "more_children", "more_leaves"])

    return run


def _finished(blocks: Blocks, weights: dict[tuple[int, int], int]):
    """Whole nodes that span blocks, with the weight of all such nodes below them, and with where their parents begin."""
    own = np.zeros((len(blocks.block), 3), np.int64)
    for (k, side), w in weights.items():
        own[k, side] = w
    before = np.concatenate([[0], np.cumsum(own.sum(axis=1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            j, side, depth, e = (b[c].to_numpy() for c in ("owner", "side", "depth", "end"))
            whole = b["end_whole"].to_numpy(zero_copy_only=False)
            far = e > j
            below = b["saved"].to_numpy() + b["rest"].to_numpy() + np.where((side == FIRST) & (far | whole), own[j, LAST], 0)
            below = below + np.where(far, before[e] - before[np.minimum(j + 1, e)] + own[e, FIRST] + np.where(whole, own[e, LAST], 0), 0)
            p_owner, p_side = blocks.begin(j, np.where((side == LAST) & (depth - 1 > blocks.low[j]), LAST, FIRST), depth - 1)
            columns = {c: b[c] for c in ("owner", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "ends")}
            columns |= {"saved_tokens": pa.array(below), "p_owner": pa.array(p_owner), "p_side": pa.array(p_side.astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def prefix_trie(seqs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct
    prefix of the sequences (conv_id, cells), the empty one included. conv_id: the smallest member, that is sequence which
    begins with it; n_leaves: nodes below without children, itself included; saved_tokens: the sum below, itself included, of
    (n_convs - 1) times the code points of a node's last text; ends_sha256: of the ids of sequences that are the prefix,
    ascending, joined by commas."""
    spark = seqs.sparkSession
    keyed = seqs.select(F.unhex(F.array_join("cells", "")).alias("key"), "conv_id", F.floor(F.col("conv_id") / IDS).alias("bucket"))
    runs = materialize(keyed.groupBy("key", "bucket").agg(F.sort_array(F.collect_list("conv_id")).alias("ids")), "trie-runs")
    dealt = runs.repartitionByRange(F.substring("key", 1, BOUND_BYTES)).sortWithinPartitions("key", "bucket").select("key", "ids")
    nodes = materialize(dealt.mapInArrow(_blocks(block_bytes), NODE), "trie-nodes")
    release(runs)
    info = nodes.where(F.col("kind") == BLOCK)
    known = sorted(info.select("block", "depth", "n_convs", "n_leaves").collect())
    names = [r.block for r in known]
    follows = spark.createDataFrame([*zip(names[1:], names, strict=False)], "block long, previous long")
    met = info.select("block", "first_key").join(follows, "block").join(info.select(F.col("block").alias("previous"), "last_key"), "previous")
    before = dict(met.select("block", "first_key", "last_key").mapInArrow(_boundary, "block long, before long").collect())
    blocks = Blocks(names, [r.depth for r in known], [r.n_convs for r in known], [r.n_leaves for r in known], [before.get(x, -1) for x in names])

    parts = nodes.where(F.col("kind").isin(FIRST, LAST)).drop("first_key", "last_key", "parent_conv_id", "parent_kind")
    parts = materialize(parts.mapInArrow(_placed(blocks), f"{parts.schema.simpleString()[7:-1].replace(':', ' ')}, k long, owner long, side int, more_children long, more_leaves long"), "trie-parts")
    whole = parts.groupBy("owner", "side", "depth").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "saved")), F.min("conv_id").alias("conv_id"), F.sum(F.col("n_children") + F.col("more_children")).alias("n_children"), F.sum(F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
        F.max("last_length").alias("last_length"), F.coalesce(F.max(F.when(F.col("ends") != EMPTY, F.col("ends"))), F.lit(EMPTY)).alias("ends"), F.max(F.struct("k", "whole")).alias("end"),
    )
    weight = (F.col("n_convs") - 1) * F.col("last_length")
    whole = materialize(whole.select("*", weight.alias("weight")), "trie-spines")
    weights = {(r.owner, r.side): r.w for r in whole.groupBy("owner", "side").agg(F.sum("weight").alias("w")).collect()}
    rest = F.sum("weight").over(Window.partitionBy("owner", "side").orderBy(F.desc("depth")))
    spans = whole.select("owner", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "ends", "saved", F.col("end.k").alias("end"), F.col("end.whole").alias("end_whole"), rest.alias("rest"))
    spans = spans.mapInArrow(_finished(blocks, weights), "owner long, side int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, ends string, saved_tokens long, p_owner long, p_side int")
    above = whole.select(F.col("owner").alias("p_owner"), F.col("side").alias("p_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    spans = spans.join(above, ["p_owner", "p_side", "depth"], "left")
    #: Inner nodes below a part find it by their own block, so that the many below the root do not share a key.
    local = parts.join(whole.select("owner", "side", "depth", F.col("conv_id").alias("above")), ["owner", "side", "depth"]).select("block", F.col("kind").alias("parent_kind"), (F.col("depth") + 1).alias("depth"), "above")
    inner = nodes.where(F.col("kind") == INSIDE).withColumnRenamed("saved", "saved_tokens")
    closed = inner.where(F.col("parent_kind") == INSIDE)
    hung = inner.where(F.col("parent_kind") != INSIDE).join(local, ["block", "parent_kind", "depth"], "left").withColumn("parent_conv_id", F.col("above"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return spans.select(*names).unionByName(closed.select(*names)).unionByName(hung.select(*names))
