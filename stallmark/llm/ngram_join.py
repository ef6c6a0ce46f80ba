"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct `words`-word shingles, lower-cased; documents with equal sets form a class. Two sets of
Jaccard similarity 0.8 or more share at least l shingles within their prefixes of n - ceil(0.8 n) + l shingles, in any
order that all share. Each document picks its own l: the longer prefix costs index entries, whose frequency a sketch of
bounded size over all documents estimates, but a partner must then share more of it, so fewer candidates come of it.
A pair needs what the smaller l of the two asks for. The sketch steers cost and order, never results.

1. Prefixes, ordered by estimated document frequency, then hash. Of every prefix shingle the sizes and the smallest l of
   its documents bound how many matches a partner found by it asks for; a class that has fewer such entries than
   any of its bounds can have no partner and goes. In a corpus of mostly different texts most go here.
2. The classes left emit all their shingles, whose exact frequencies among them give the order from here on; the same
   bound, now without what lies beyond a prefix, drops classes again, twice.
3. Stars: of every shingle the class with the largest share of met shingles is the centre, and each class is verified
   against the centre most of its shingles have. This joins large groups of near copies with a pair or two for each
   class. Shingles that lie in one component are dropped, and the bound is applied again. While that pays and joining
   what is open would be far from linear in the table, further turns draw other centres.
4. What is still open is joined by prefixes of the exact order, again lengthened by cost (the frequencies are exact now)
   and with as many more matches asked for before a pair is verified. Pairs inside a component need no test.
5. Verification counts shared shingles exactly: 100 * intersection >= 80 * union. Shingles that were dropped cannot
   be shared by sets that link, so the arrays that are left give exact intersections, and no text is read for it.

Shingles and sets are compared by 64-bit hashes. Rows of one class are spread by `spread_join`, so a class with a third
of all rows is no single task; a centre with many members is one row met by many, which Spark's adaptive execution
splits. Classes that the stars leave open are joined pair by pair, so no link is lost.

Defined results: null texts and texts without words have no shingles and link with nothing; under `words` words the
whole sequence is the one shingle; equal texts always link; rows without id get no component; rows that repeat an id
are documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.llm.graph import components
from stallmark.llm.kernels import Words, grams, mix, picked, ragged, signed, slices, span_hashes
from stallmark.llm.scratch import materialize, release, shuffles_end, spread_join
from stallmark.llm.sketches import Counts, Filter, Frequent, fill

#: Entries of the frequency sketch that all tasks get: 16 bytes each.
MOST_FREQUENT = 200_000
#: Matches that prefixes may ask for: so many per cent of the set, LEAST at least; smaller sets ask for what they can.
LONGER, LEAST = (0, 4, 8, 12), 8
#: Turns of stars at most, while joining what is open would compare more than two rows for each class of the table and the
#: last turn has linked at least one in WORTH of the open classes.
TURNS, WORTH = 6, 20
#: Cost of verifying a candidate in index entries, by texts and by arrays, and other documents that an infrequent shingle
#: has by chance.
VERIFY, VERIFY_SETS, CHANCE = 24, 8, 0.1


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, as (text number, hash), sorted."""
    w = Words(texts, lower=True)
    h = w.hashes()
    n = np.diff(w.first)
    g = grams(h, k)
    size = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    size[short] = 1
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(first[-1], np.uint64)
    out[first[short]] = span_hashes(h, w.first[short], w.first[short + 1])
    for i in np.flatnonzero(n >= k).tolist():
        own = out[first[i] : first[i + 1]]
        own[:] = g[w.first[i] : w.first[i] + size[i]]
        own.sort()
    doc = np.repeat(np.arange(len(n)), size)
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], out[fresh]


def set_keys(doc: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of the set of each text."""
    n = np.bincount(doc, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(n)])
    sums = (np.concatenate([[np.uint64(0)], np.cumsum(mix(g ^ np.uint64(c)))]) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))
    a, b = (x[begin[1:]] - x[begin[:-1]] for x in sums)
    return n, signed(mix(a ^ mix(b + n.astype(np.uint64))))


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counts()
        for whole in batches:
            for b in slices(whole, "text"):
                seen.add(shingles(b.column(0), k)[1])
        yield pa.RecordBatch.from_arrays([pa.array(signed(seen.value)), pa.array(seen.count)], ["token", "count"])

    return run


def _prefixes(k: int, frequent, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for whole in batches:
            for b in slices(whole, "text"):
                doc, g = shingles(b.column(2), k)
                n, s = set_keys(doc, g, b.num_rows)
                begin = np.concatenate([[0], np.cumsum(n)])
                count = often(g)
                order = np.argsort((doc << 32) + np.minimum(count, (1 << 32) - 1), kind="stable")
                g, cost = g[order], np.concatenate([[0], np.cumsum(count[order])])
                need = -(-n * percent // 100)
                best, size = np.full(len(n), np.inf), n * 0
                for more in LONGER:
                    want = np.minimum(np.maximum(LEAST, n * more // 100), need)
                    p = n - need + want
                    entries = cost[begin[:-1] + p] - cost[begin[:-1]]
                    total = entries + VERIFY * (entries - (1 - CHANCE) * p) / np.maximum(want, 1)
                    better = total < best
                    size, best = np.where(better, p, size), np.where(better, total, best)
                at = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int32)), pa.array(s), pa.array(size.astype(np.int32)), ragged(signed(g[at]), size, pa.int64())], ["doc", "of_text", "n", "s", "p", "prefix"])

    return run


def _may(known):
    """Only the rows whose first column may be wanted, so that other texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may: Filter = known.value
        for b in batches:
            yield b.filter(pa.array(may(b.column(0).to_numpy(zero_copy_only=False))))

    return run


def _full(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                doc, g = shingles(b.column(1), k)
                n = np.bincount(doc, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), ragged(signed(g), n, pa.int64())], ["s", "n", "tokens"])

    return run


def near(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of n and m must share to link."""
    return F.ceil((n + m) * percent / (100 + percent))


def may_link(percent: int) -> Column:
    """Whether a class with an array `own` of entries may have a partner: for some x it has x entries that ask for x
    matches at most."""
    return F.exists(F.transform(F.array_sort(F.transform("own", lambda e: e["need"])), lambda need, i: need <= i + 1), lambda x: x)


def _bounds(entries: DataFrame, percent: int) -> DataFrame:
    """Entries with lo and hi, the sizes of partners that their shingle may lead to."""
    rows = entries.where(F.col("lo") * percent <= F.col("n") * 100).where(F.col("n") * percent <= F.col("hi") * 100)
    return rows.withColumn("lo", F.greatest("lo", F.ceil(F.col("n") * percent / 100))).withColumn("hi", F.least("hi", F.floor(F.col("n") * 100 / percent)))


def prefix_survivors(classes: DataFrame, percent: int) -> DataFrame:
    """(s): the classes (s, n, p, prefix) that may have a partner. What a partner of size m asks for rises up to m = n
    and falls from there, so its least is at one of the ends (one less, for rounding)."""
    entries = classes.select("s", "n", "p", F.explode("prefix").alias("token")).repartition("token")
    ell = F.col("p") - F.col("n") + F.ceil(F.col("n") * percent / 100)
    token = entries.groupBy("token").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(ell).alias("ell"), F.min("s").alias("a"), F.max("s").alias("z")).where("a < z").drop("a", "z")
    rows = _bounds(entries.join(token, "token"), percent)
    asks = lambda m: least_overlap(F.col("n"), m, percent) - F.greatest(F.col("n") - F.col("p"), F.ceil(m * percent / 100) - F.col("ell"))
    need = F.greatest(F.lit(1), F.least(asks(F.col("lo")), asks(F.col("hi"))) - 1).cast("int")
    able = rows.groupBy("s").agg(F.collect_list(F.struct(need.alias("need"))).alias("own"))
    return able.where(may_link(percent)).select("s")


def outside_largest(by: DataFrame) -> DataFrame:
    """(token, most, lo, hi, often, lo_, hi_) of the tokens that several groups have, of rows (token, group, lo, hi, often):
    most is the group with the most entries, lo_ and hi_ are the sizes in the other groups. Rows stay where their token is
    and none is joined with another."""
    rows = by.withColumn("most", F.max_by("group", F.struct("often", "group")).over(Window.partitionBy("token")))
    other = lambda c: F.when(F.col("group") != F.col("most"), F.col(c))
    sizes = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("often").cast("int").alias("often"), F.min(other("lo")).alias("lo_"), F.max(other("hi")).alias("hi_")]
    return rows.groupBy("token").agg(F.any_value("most").alias("most"), *sizes, F.count("*").alias("groups")).where("groups > 1").drop("groups")


def prune(sets: DataFrame, percent: int, name: str, grouped: bool) -> DataFrame:
    """Sets (s, n, group, own) that may still link with one of another group; own: (often, token, need, large) of the
    shingles that another group has too, rarest first, large if the group has the most of the shingle. A partner of size m
    shares what sets of n and m must, so the smallest m of a shingle says how many others it asks for; with grouped,
    for the largest group of a shingle that of the other groups."""
    entries = sets.select("s", "n", "group", F.explode("own.token").alias("token")).repartition("token")
    size = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").cast("int").alias("often")]
    if not grouped:
        token = entries.groupBy("token").agg(*size, F.min("group").alias("a"), F.max("group").alias("z")).where("a < z").drop("a", "z")
        rows = entries.join(token, "token").withColumn("large", F.lit(False))
    else:
        token = outside_largest(entries.groupBy("token", "group").agg(*size))
        rows = entries.join(token, "token").withColumn("large", F.col("group") == F.col("most"))
        for c in ("lo", "hi"):
            rows = rows.withColumn(c, F.when(F.col("large"), F.col(f"{c}_")).otherwise(F.col(c)))
    rows = _bounds(rows, percent)
    entry = F.struct("often", "token", least_overlap(F.col("n"), F.col("lo"), percent).cast("int").alias("need"), "large")
    return materialize(rows.groupBy("s", "n", "group").agg(F.array_sort(F.collect_list(entry)).alias("own")).where(may_link(percent)), name)


def prefixes(sets: DataFrame) -> DataFrame:
    """(s, n, group, l, own, token, large): the entries by which open classes meet, own being all of a class. A class whose
    h entries ask for m matches or more shares l of its h - m + l rarest entries with any partner; l is picked by the
    cost of these entries."""
    asked = F.array_min(F.transform("own", lambda e: e["need"]))
    cost = lambda l: F.aggregate(F.slice("own", 1, F.col("h") - F.col("m") + l), F.lit(0).cast("long"), lambda x, e: x + e["often"]) * (1 + VERIFY_SETS / l)  # noqa: E731,E741
    picks = F.array(*(F.when(F.col("m") >= x, F.struct(cost(x).alias("cost"), F.lit(x).alias("l"))) for x in (1, 2, 4, 8)))
    rows = sets.select("s", "n", "group", F.size("own").alias("h"), F.least(asked, F.size("own")).alias("m"), "own").withColumn("l", F.array_min(picks)["l"])
    rows = rows.withColumn("own", F.slice("own", 1, F.col("h") - F.col("m") + F.col("l")))
    return rows.select("s", "n", "group", "l", F.col("own.token").alias("own"), F.explode("own").alias("e")).select("s", "n", "group", "l", "own", "e.token", "e.large")


def stars(sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each class with some centres of other groups. Centres are chosen for every shingle and range of sizes, as
    wide as two steps of sizes that can link. In turn 0 all shingles count, and the centre is the class with the largest
    share of met shingles (near copies of one text meet in it); a class takes the one most of its shingles have. Later
    turns shift the ranges, read prefixes alone, draw up to four centres by hash, and a class takes four."""
    width = 2 * float(np.log(100 / percent))
    span = F.floor(F.log("n") / width + 0.5 * (turn % 2)).alias("span")
    entries = sets.select("s", "n", "group", F.size("own").alias("hits"), F.explode("own.token").alias("token")) if turn == 0 else prefixes(sets).withColumn("hits", F.lit(0))
    entries = entries.select("s", "n", "group", "hits", span, "token").repartition("token")
    centre = F.struct(F.col("s").alias("b"), F.col("n").alias("m"), F.col("group").alias("other"))
    rank = F.struct(F.col("hits") / F.col("n"), "s") if turn == 0 else F.struct(F.xxhash64("s", F.lit(turn)), "s")
    slot = F.lit(0) if turn == 0 else F.pmod(F.xxhash64(F.lit(turn), "s"), F.lit(4))
    hubs = entries.withColumn("slot", slot).groupBy("token", "span", "slot").agg(F.max_by(centre, rank).alias("hub")).select("token", "span", "hub.*")
    rows = entries.join(hubs, ["token", "span"]).where("other <> group").where(near("n", "m", percent))
    met = rows.groupBy("s", "b").agg(F.count("*").alias("k")).groupBy(F.col("s").alias("a"))
    if turn == 0:
        return met.agg(F.max_by("b", F.struct("k", "b")).alias("b"))
    return met.agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "b")), False), 1, 4).alias("best")).select("a", F.explode("best.b").alias("b"))


def open_pairs(short: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of two groups that share the matches their prefixes ask for, each met once, by its rarest shared
    shingle. Of a shingle only entries outside its largest group look for others, so no group is joined with itself."""
    one = short.where(~F.col("large")).select("token", "s", "n", "group", "l", "own")
    two = short.select("token", "large", *(F.col(c).alias(f"{c}_") for c in ("s", "n", "group", "l", "own")))
    shared = F.array_intersect("own", "own_")
    due = (F.col("group") != F.col("group_")) & (F.col("large") | (F.col("s") < F.col("s_"))) & near("n", "n_", percent)
    due = due & (F.get(shared, F.lit(0)) == one["token"]) & (F.size(shared) >= F.least("l", "l_"))
    met = one.join(two, (one["token"] == two["token"]) & due)
    return met.select(F.col("s").alias("a"), F.col("s_").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    one = sets.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("own.token").alias("of_a"))
    two = sets.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("own.token").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("k", F.size(F.array_intersect("of_a", "of_b")))
    return materialize(both.where(F.col("k") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("k")) * percent).select("a", "b"), name)


def _class_links(classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    able = materialize(prefix_survivors(classes, percent), "jaccard-able")
    chosen = materialize(classes.select("s", "doc", "of_text").join(able, "s"), "jaccard-chosen")
    known = rows.sparkSession.sparkContext.broadcast(fill(chosen.select("of_text"), chosen.count()))
    texts = rows.select("of_text", "doc", "text").mapInArrow(_may(known), "of_text long, doc long, text string").join(chosen, ["doc", "of_text"])
    texts = texts.groupBy("doc", "of_text").agg(F.any_value("s").alias("s"), F.any_value("text").alias("text")).select("s", "text")
    full = texts.mapInArrow(_full(words), "s long, n int, tokens array<long>")
    sets = materialize(full.select("s", "n", F.col("s").alias("group"), F.transform("tokens", lambda t: F.struct(t.alias("token"))).alias("own")), "jaccard-sets")
    release(able, chosen)

    for _ in range(2):
        sets, was = prune(sets, percent, "jaccard-pruned", False), sets
        release(was)
    links, groups, short, many = [], None, None, classes.count()
    for turn in range(TURNS):
        found = verified(stars(sets, percent, turn), sets, percent, "jaccard-links")
        links.append(found)
        release(groups)
        groups = materialize(components(reduce(DataFrame.unionByName, links), "a", "b", "jaccard-groups"), "jaccard-groups")
        placed = sets.join(groups.withColumnRenamed("node", "s"), "s", "left").withColumn("group", F.coalesce("component", "s")).drop("component")
        for _ in range(2):
            placed, was = prune(placed, percent, "jaccard-pruned", True), sets
            sets = placed
            release(was)
        release(short)
        short = materialize(prefixes(sets), "jaccard-open")
        met = short.groupBy("token").agg(F.count("*").alias("k"), F.count_if(~F.col("large")).alias("others"))
        rows = met.agg(F.sum(F.col("k") * F.col("others"))).first()[0] or 0
        if rows <= 2 * many or found.count() * WORTH < sets.count():
            break
    last = verified(open_pairs(short, percent), sets, percent, "jaccard-bridges")
    if not last.isEmpty():
        release(groups)
        groups = materialize(components(reduce(DataFrame.unionByName, [*links, last]), "a", "b", "jaccard-groups"), "jaccard-groups")
    release(sets, short, last, *links)
    return groups


def class_links(classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes (s, n, p, prefix, doc, of_text) that link with another; component is the least s."""
    with shuffles_end(rows.sparkSession):
        return _class_links(classes, rows, words, percent)


def jaccard_rows(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, of_text, n, component, keeper) of every row that has an id and a set: of_text is xxhash64 of the text, component
    the smallest id reachable by links, and keeper the of_text of one row of this id in the component."""
    sc = docs.sparkSession.sparkContext
    rows = picked(docs, doc=id_col, text=text_col).select(F.col("doc").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    rows = rows.select("doc", F.xxhash64("text").alias("of_text"), "text")
    heavy = rows.select("text").mapInArrow(_count(words), "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    heavy = heavy.where("count > 3").orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    frequent = sc.broadcast(Frequent(heavy["token"].to_numpy().astype(np.int64).view(np.uint64), heavy["count"].to_numpy()))
    sets = materialize(rows.mapInArrow(_prefixes(words, frequent, percent), "doc long, of_text long, n int, s long, p int, prefix array<long>").where("n > 0"), "jaccard-prefixes")
    first = F.min(F.struct("doc", "of_text"))
    classes = sets.groupBy("s").agg(first.alias("first"), F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("n", "p", "prefix")))
    classes = materialize(classes.select("s", "first.*", "copies", "n", "p", "prefix"), "jaccard-classes")
    members = materialize(sets.select("doc", "of_text", "n", "s"), "jaccard-members")
    release(sets)
    groups = class_links(classes, rows, words, percent)
    named = classes.select("s", "doc", "of_text", "copies").join(groups.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    named = materialize(named, "jaccard-named")
    keepers = named.groupBy("component").agg(F.min(F.struct("doc", "of_text")).alias("first"))
    labels = materialize(named.select("s", "component", "copies").join(keepers, "component").select("s", "copies", F.col("first.doc").alias("component"), F.col("first.of_text").alias("keeper")), "jaccard-labels")
    release(classes, groups, named)
    return spread_join(members, labels, ["s"], "copies").select("doc", "of_text", "n", "component", "keeper")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest id reachable by links."""
    found = jaccard_rows(docs, words, percent, id_col, text_col).select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
    every = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words_in = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    alone = every.where(~words_in | F.col("doc_id").isNull())
    return found.unionByName(alone.mapInArrow(_sizes(words), "doc_id long, n_shingles long").withColumn("component_id", F.col("doc_id")))


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                n = np.bincount(shingles(b.column(1), k)[0], minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_shingles"])

    return run
