"""Mixing sources to target weights.

The words of each source, its documents in a fixed pseudorandom order, are packed end to end into blocks of `block`
words. A source's target says how many slots it fills: whole passes over its blocks, then part of one more; the last
slot is cut so that the words taken are the target, rounded. Output shards draw how many of their slots each source
gets: multinomial counts, conditioned on the totals, by splitting the totals over halves of the shard range again and
again, so any shard finds its counts and its sources' slot numbers by itself. A slot number of a source becomes a
block by a keyed pseudorandom permutation (one for each pass), and blocks are joined by (source, block).

Places in the word stream of a source are prefix sums in two levels: within `buckets` hash buckets of a source, and
over its buckets; so a source with a third of all rows is still many groups.

Defined results: null text has no words; null is a source of its own, the last; documents without words take nothing
but are returned; rows that repeat an id are documents of their own; a table without words takes nothing; an empty
table gives no rows; extra columns are ignored. Reruns give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallmark.llm.kernels import mix as scramble, picked

#: One row per source is gathered on the driver and sent to the tasks: about 100 bytes each.
MOST_SOURCES = 1_000_000
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of runs outside space and \\t\\n\\v\\f\\r; 0 for null."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    packed = F.regexp_replace(flat, " +", " ")
    gaps = F.octet_length(packed) - F.octet_length(F.replace(packed, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (F.octet_length(flat) == 0), 0).otherwise(gaps + 1).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes dealt by weight; what is above most * size goes to the other sources by weight, until
    none is above."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(n), or its inverse: four Feistel rounds on the next power of four, walked until
    inside."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low, out, todo = np.uint64((1 << half) - 1), x.astype(np.uint64), np.ones(len(x), bool)
    keys = [np.uint64((key * 4 + i) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(4)]
    while todo.any():
        v = out[todo]
        a, b = v >> np.uint64(half), v & low
        for k in reversed(keys) if back else keys:
            a, b = (b ^ (scramble(a + k) & low), a) if back else (b, a ^ (scramble(b + k) & low))
        out[todo] = a << np.uint64(half) | b
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


@dataclass
class Plan:
    """Per source, in order: name, size, target, blocks, slots it fills and the words of its last slot."""

    names: list
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    slots: list[int]
    last: list[int]
    block: int
    per_shard: int
    seed: int

    @property
    def shards(self) -> int:
        return max(1, -(-sum(self.slots) // self.per_shard))

    def counts(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of each source in the shard, and before it."""
        have, before = np.array(self.slots, np.int64), np.zeros(len(self.slots), np.int64)
        lo, hi = 0, self.shards
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = min((mid - lo) * self.per_shard, int(have.sum()))
            r = np.random.default_rng([self.seed, lo, hi])
            drawn = draw_without_replacement(r, have, left)
            if shard < mid:
                have, hi = drawn, mid
            else:
                have, before, lo = have - drawn, before + drawn, mid
        return have, before


def draw_without_replacement(r: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind n draws from an urn give; normal approximation beyond the generator's range."""
    out, rest = np.zeros_like(have), int(have.sum())
    for i, k in enumerate(have.tolist()):
        if n <= 0:
            break
        if rest < 10**9:
            out[i] = r.hypergeometric(k, rest - k, n)
        else:
            p = k / rest
            sd = (n * p * (1 - p) * max(rest - n, 0) / max(rest - 1, 1)) ** 0.5
            out[i] = min(max(round(r.normal(n * p, sd)), n - (rest - k), 0), k, n)
        n -= int(out[i])
        rest -= k
    return out


def make_plan(sources: list[tuple], weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 128, per_shard: int = 4096, seed: int = 17) -> Plan:
    """sources: (name, size), any order; they are put in order of code points, null last."""
    sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [int(s) for _, s in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    blocks, slots, last = [], [], []
    for i, (size, want) in enumerate(zip(sizes, goal, strict=True)):
        n, take = -(-size // block), round(want)
        blocks.append(n)
        if not take:
            slots.append(0)
            last.append(0)
            continue
        full, rest = divmod(take, size)
        if not rest:
            full, rest = full - 1, size
        short = size - (n - 1) * block  # the last block of a source has so many words
        at = int(permute(np.array([n - 1]), n, _key(seed, i, full), back=True)[0])  # the slot of the short block
        if rest <= at * block:
            need, cut = -(-rest // block), rest - (-(-rest // block) - 1) * block
        elif rest <= at * block + short:
            need, cut = at + 1, rest - at * block
        else:
            over = rest - at * block - short
            need, cut = at + 1 + -(-over // block), over - (-(-over // block) - 1) * block
        slots.append(full * n + need)
        last.append(cut)
    return Plan([s for s, _ in sources], sizes, goal, blocks, slots, last, block, per_shard, seed)


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * 64 + turn


def measured(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, source, size, of_text) of each row, and, if asked for, a struct `kept` of the columns in keep."""
    rows = picked(docs, id=id_col, source=source_col, text=text_col, **{f"kept{i}": c for i, c in enumerate(keep or [])})
    kept = [F.struct(*(F.col(f"kept{i}").alias(c) for i, c in enumerate(keep))).alias("kept")] if keep else []
    return rows.select(F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("text").alias("of_text"), *kept)


def plan_for(rows: DataFrame, **options) -> Plan:
    """The plan for measured rows."""
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return make_plan([(r.source, r.n or 0) for r in found], **options)


def placed(rows: DataFrame, buckets: int = 512) -> DataFrame:
    """Measured rows with from: the place of their first word in the stream of their source."""
    cols = [c for c in rows.columns if c != "of_text"]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "of_text"), F.lit(buckets)).cast("int"))
    total = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("id"), "id", "of_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(total, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select(*cols, (F.col("base") + F.col("inner")).alias("from"))


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """(shard, slot, source, block, turn, words): what each output shard takes; words is the most of the block."""
    names = plan.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n, before = plan.counts(shard)
                source = np.repeat(np.arange(len(n)), n)
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + before[source]
                block, turn, words = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64), np.full(len(source), plan.block)
                for s in np.flatnonzero(n):
                    at = np.flatnonzero(source == s)
                    turn[at] = number[at] // plan.blocks[s]
                    words[at[number[at] == plan.slots[s] - 1]] = plan.last[s]
                    for t in np.unique(turn[at]):
                        own = at[turn[at] == t]
                        block[own] = permute(number[own] % plan.blocks[s], plan.blocks[s], _key(plan.seed, int(s), int(t)))
                slot = permute(np.arange(len(source)), max(len(source), 1), _key(plan.seed, 1 << 30, shard)) if len(source) else number
                label = pa.array([names[s] for s in source], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(slot), label, pa.array(block), pa.array(turn), pa.array(words)], ["shard", "slot", "source", "block", "turn", "words"])

    return spark.range(plan.shards).mapInArrow(run, "shard long, slot long, source string, block long, turn long, words long")


def mix(rows: DataFrame, plan: Plan, how: str = "inner") -> DataFrame:
    """The mix of measured rows, one row per piece of a document in a slot: their columns, and from, block, shard,
    slot, turn, lo and hi (the words taken of the document, hi exclusive). With how="left" pieces that no slot takes
    stay, with null shard. Rows without words have no pieces."""
    cols = [c for c in rows.columns if c != "of_text"]
    rows = placed(rows).where("size > 0")
    first, last = F.floor(F.col("from") / plan.block), F.floor((F.col("from") + F.col("size") - 1) / plan.block)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    taken = slots(rows.sparkSession, plan).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    # without the hint the planner takes the slots for as small as the shard numbers they come from, and broadcasts them
    joined = rows.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), how)
    lo = F.greatest(F.col("block") * plan.block - F.col("from"), F.lit(0))
    hi = F.least(F.col("block") * plan.block + F.coalesce("words", F.lit(0)) - F.col("from"), F.col("size"))
    joined = joined.withColumn("lo", lo).withColumn("hi", F.greatest(hi, lo))
    return joined.where("lo < hi" if how == "inner" else "true").select(*cols, "from", "block", "shard", "slot", "turn", "lo", "hi")


def taken_words(rows: DataFrame, plan: Plan) -> DataFrame:
    """(id, source, size, taken) of each measured row: how many of its words the mix takes."""
    some = mix(rows, plan, "left").groupBy("id", "source", "size", "from").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return some.drop("from").unionByName(rows.where("size = 0").select("id", "source", "size", F.lit(0).cast("long").alias("taken")))


def texts(docs: DataFrame, rows: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as the mix takes them: the columns of their measured rows, turn and text, one row per row and pass
    of which words are taken. A text that is taken whole stays as it is; else it is the words taken, joined by one
    space. Rows without words stay once, with turn 0. Texts are shuffled once, to the spans that are taken of them;
    rows that repeat an id and a text share it."""
    cols = [c for c in rows.columns if c != "of_text"]
    keyed = rows.withColumn("_key", F.col("of_text"))
    taken = mix(keyed, plan).groupBy(*cols, "_key", "from", "turn").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_spans")).drop("from")
    none = keyed.where("size = 0").select(*cols, "_key", F.lit(0).cast("long").alias("turn"), F.array().cast(dict(taken.dtypes)["_spans"]).alias("_spans"))
    taken = taken.unionByName(none).withColumn("_doc", F.xxhash64("id", "_key"))
    every = picked(docs, id=id_col, text=text_col).select(F.xxhash64(F.col("id").cast("long"), F.xxhash64("text")).alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").cast("string").alias(text_col)).dropDuplicates(["_doc", "_key"])
    some = taken.join(every, ["_doc", "_key"])
    words = F.split(F.trim(F.regexp_replace(text_col, "[ \\t\\n\\x0B\\f\\r]+", " ")), " ")
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]) == F.col("size")
    parts = lambda w: F.flatten(F.transform("_spans", lambda s: F.slice(w, s["lo"].cast("int") + 1, (s["hi"] - s["lo"]).cast("int"))))
    cut = F.array_join(F.transform(F.array(words), parts)[0], " ")
    return some.select(*cols, "turn", F.when(whole, F.col(text_col)).otherwise(cut).alias(text_col))
