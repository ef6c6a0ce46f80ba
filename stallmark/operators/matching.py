"""Likely cross-posts of one item on several sources.

Confidence is half the title similarity J where J >= 0.65, 0.3 for prices within 3 % of the larger, and 0.2 for place
similarity of 0.5 or more; 0.7 makes a match. Titles alone reach 0.5 and the rest 0.5, so J >= 0.65 is necessary.
"""

from __future__ import annotations

from datetime import datetime
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.functions.text import jaccard, tokens
from stallmark.operators.comparables import newest_pool
from stallmark.shared import stored

#: Reasons of a match.
TITLES, PRICES, PLACES = "Títulos semelhantes", "Preços iguais ou muito próximos", "Localizações semelhantes"


def confidence(a: Column, b: Column, j: Column | None = None) -> Column:
    """(confidence, reasons) of two structs with title_tokens, price and place_tokens; j is the titles' similarity where
    it is known."""
    j = jaccard(a["title_tokens"], b["title_tokens"]) if j is None else j
    titles = j >= 0.65
    gap = F.abs(a["price"] - b["price"]) / F.nullif(F.greatest(a["price"], b["price"]), F.lit(0.0))
    prices = F.coalesce(a["price"].isNotNull() & b["price"].isNotNull() & (gap <= 0.03), F.lit(False))
    places = (F.size(a["place_tokens"]) > 0) & (F.size(b["place_tokens"]) > 0) & (jaccard(a["place_tokens"], b["place_tokens"]) >= 0.5)
    total = F.when(titles, 0.5 * j).otherwise(0.0) + F.when(prices, 0.3).otherwise(0.0) + F.when(places, 0.2).otherwise(0.0)
    label = F.concat(F.lit(f"{TITLES} ("), F.floor(j * 100 + 0.5).cast("string"), F.lit("%)"))
    why = F.filter(F.array(F.when(titles, label), F.when(prices, F.lit(PRICES)), F.when(places, F.lit(PLACES))), lambda r: r.isNotNull())
    return F.struct(F.least(F.lit(1.0), total).alias("confidence"), why.alias("reasons"))


def prepared(df: DataFrame) -> DataFrame:
    """(category, last_seen_at, m): what matching reads of a listing; words are cut once a row, not once a pair."""
    m = F.struct("listing_id", "source", "price", tokens(F.col("title")).alias("title_tokens"), tokens(F.col("location")).alias("place_tokens"))
    return df.select("category", "last_seen_at", m.alias("m"))


def matches(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of structs a and b of different sources that match, as a, b, confidence, reasons."""
    x, y = F.col(a), F.col(b)
    found = pairs.where((x["source"] != y["source"]) & (x["listing_id"] != y["listing_id"])).withColumn("_c", confidence(x, y))
    return found.where("_c.confidence >= 0.7").select(x["listing_id"].alias("a"), y["listing_id"].alias("b"), "_c.confidence", "_c.reasons")


def matched_in(targets: DataFrame, pool: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of targets (on, a) and pool rows (on, b) with equal `on` that match, with _c, their confidence and reasons.
    Titles meet first, each once a key, and rows only where their titles are alike: nothing else reaches 0.7."""
    t, p = (df.withColumn(f"_{c}", F.array_join(f"{c}.title_tokens", " ")).where(f"_{c} <> ''") for df, c in ((targets, "a"), (pool, "b")))
    titles = t.select(*on, "_a").distinct().join(p.select(*on, "_b").distinct(), on)
    alike = titles.withColumn("_j", jaccard(F.split("_a", " "), F.split("_b", " "))).where("_j >= 0.65")
    pairs = t.join(alike, [*on, "_a"]).join(p, [*on, "_b"]).where("a.source <> b.source and a.listing_id <> b.listing_id")
    return pairs.withColumn("_c", confidence(F.col("a"), F.col("b"), F.col("_j"))).where("_c.confidence >= 0.7").drop("_a", "_b", "_j")


def recent_matches(targets: DataFrame, pool: DataFrame, sources: list[str], as_of: datetime, days: int = 30, newest: int = 100) -> DataFrame:
    """Each target against the newest rows of its category on other sources; a ranking for each source left out."""
    since = F.lit(as_of) - F.make_dt_interval(days=F.lit(days))
    live = prepared(pool.where(F.col("active") & F.col("suppressed_at").isNull() & (F.col("last_seen_at") >= since)))
    without = live.withColumn("left_out", F.explode(F.array(*(F.lit(s) for s in sources)))).where(F.col("left_out") != F.col("m.source"))
    order = Window.partitionBy("category", "left_out").orderBy(F.col("last_seen_at").desc(), "m.listing_id")
    top = without.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest)
    t = prepared(targets).select("category", F.col("m.source").alias("left_out"), F.col("m").alias("a"))
    found = matched_in(t, top.select("category", "left_out", F.col("m").alias("b")), ["category", "left_out"])
    return found.select(F.col("a.listing_id").alias("a"), F.col("b.listing_id").alias("b"), "_c.confidence", "_c.reasons")


#: Choices of words that a title is filed under at most for each size of its partners.
MOST_CHOICES = 24


def _choices(n: int, least: int, of: int, m: int | None = None) -> list[list[int]]:
    """Places, among its words from the rarest on, that a title of n words is filed under to meet those of m (of n, where
    none is given). Both share at least `must` words, and the first k of these lie in the first n - must + k of n words
    and m - must + k of m: k is the largest that leaves few choices. None, if no two of these sizes are alike."""
    m = n if m is None else m
    must = -(-(n + m) * least // (least + of))
    k = max((k for k in range(1, must + 1) if comb(max(n, m) - must + k, k) <= MOST_CHOICES), default=1)
    return [list(c) for c in combinations(range(n - must + k), k)] if must <= min(n, m) else []


def similar_titles(titles: DataFrame, least: int = 13, of: int = 20) -> DataFrame:
    """(x, y): pairs x < y of a one-column DataFrame of distinct titles with token Jaccard >= least / of. Titles of n and m
    words that reach it share at least ceil((n + m) * least / (least + of)) of them: they meet by choices of so many
    words, or of fewer rare ones, for each pair of sizes. A pair is judged where it meets, and given where the choice is
    of the first words that both have, so that pairs are neither shuffled nor made distinct."""
    name = titles.columns[0]
    rows = titles.select(F.col(name).alias("title")).distinct().withColumn("words", tokens(F.col("title"))).where(F.size("words") > 0)
    words = rows.select("title", F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    ranked = words.join(often, "word").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w"))
    ranked = stored(ranked.select("title", F.size("w").alias("n"), F.array_join("w.word", " ").alias("w")), "titles")
    sizes = [r.n for r in ranked.select("n").distinct().collect()]
    found = [(n, m, c) for n in sizes for m in sizes if (c := _choices(n, least, of, m))]
    places = F.broadcast(titles.sparkSession.createDataFrame(found, "n int, m int, places array<array<smallint>>"))
    filed = ranked.join(places, "n").select("title", "n", "m", "w", F.explode("places").alias("p"))
    filed = filed.withColumn("met", F.xxhash64(F.least("n", "m"), F.greatest("n", "m"), _at("w", "p")))
    larger = filed.where("n >= m")
    smaller = filed.where("n <= m").select("met", *(F.col(c).alias(f"{c}_") for c in ("title", "n", "m", "w", "p")))
    pairs = larger.join(smaller, "met").where((F.col("n") == F.col("m_")) & (F.col("m") == F.col("n_"))).where((F.col("n") > F.col("m")) | (F.col("title") < F.col("title_")))
    first = F.slice(F.array_intersect(F.split("w", " "), F.split("w_", " ")), 1, F.size("p"))
    met = pairs.where((first == _at("w", "p")) & (first == _at("w_", "p_"))).where(jaccard(F.split("w", " "), F.split("w_", " ")) >= least / of)
    return met.select(F.least("title", "title_").alias("x"), F.greatest("title", "title_").alias("y"))


def _at(words: str, places: str) -> Column:
    """The words at the given places of a text."""
    return F.transform(F.col(places), lambda i: F.get(F.split(words, " "), i.cast("int")))


def all_matches(df: DataFrame) -> DataFrame:
    """Every match between two sources of a whole table, a < b: similar titles first, then their listings."""
    pairs = similar_titles(df.select("title"))
    same = df.select(F.col("title").alias("x"), F.col("title").alias("y")).distinct()
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(same)
    rows = prepared(df).select("m", "category")
    named = df.select("listing_id", "title")
    left = rows.join(named.withColumnRenamed("title", "x"), F.col("m.listing_id") == F.col("listing_id")).select("x", F.col("m").alias("a"))
    right = left.select(F.col("x").alias("y"), F.col("a").alias("b"))
    return matches(left.join(both, "x").join(right, "y").where(F.col("a.listing_id") < F.col("b.listing_id")))


def exclude_matched(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (target, candidate) without those whose two listings are a known match, whichever way round."""
    edges = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return pairs.join(edges, (F.col("target.listing_id") == F.col("a")) & (F.col("candidate.listing_id") == F.col("b")), "left_anti")


def collapse_cross_posts(pairs: DataFrame, order: str = "pool_rank") -> DataFrame:
    """For each target its candidates in order, less each that matches an earlier kept one: kept (array of structs) and
    dropped (array of a: the kept one, b, confidence, reasons). A fold over at most the pool's limit of rows."""
    c = F.struct(F.col(f"candidate.{order}").alias("at"), "candidate.listing_id", "candidate.source", "candidate.price", tokens(F.col("candidate.title")).alias("title_tokens"), tokens(F.col("candidate.location")).alias("place_tokens"))
    rows = pairs.groupBy(F.col("target.listing_id").alias("target_id")).agg(F.array_sort(F.collect_list(c)).alias("all"))
    kind = dict(rows.dtypes)["all"]
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast("array<struct<a:string,b:string,confidence:double,reasons:array<string>>>").alias("dropped"))

    def step(acc: Column, x: Column) -> Column:
        def hit(k: Column) -> Column:
            got = confidence(k, x)
            ok = (k["source"] != x["source"]) & (got["confidence"] >= 0.7)
            return F.when(ok, F.struct(k["listing_id"].alias("a"), x["listing_id"].alias("b"), got["confidence"].alias("confidence"), got["reasons"].alias("reasons")))

        hits = F.filter(F.transform(acc["kept"], hit), lambda h: h.isNotNull())
        return F.transform(
            F.array(hits),
            lambda h: F.struct(
                F.when(F.size(h) == 0, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
                F.when(F.size(h) == 0, acc["dropped"]).otherwise(F.concat(acc["dropped"], F.slice(h, 1, 1))).alias("dropped"),
            ),
        )[0]

    return rows.select("target_id", F.aggregate("all", start, step).alias("r")).select("target_id", "r.kept", "r.dropped")


def _pools(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows as targets (_key, a, own: the rank in the pool, if any) and their pools (_key, b, rank)."""
    m = F.struct("listing_id", "source", "price", tokens(F.col("title")).alias("title_tokens"), tokens(F.col("location")).alias("place_tokens"))
    keyed = rows.select(F.struct(*keys).alias("_key"), "listing_id", "last_seen_at", m.alias("m"))
    newest = newest_pool(keyed, ["_key"], limit)
    targets = keyed.join(newest.select("listing_id", F.col("pool_rank").alias("own")), "listing_id", "left").select("_key", F.col("m").alias("a"), "own")
    return targets, newest.select("_key", F.col("m").alias("b"), F.col("pool_rank").alias("rank"))


def unmatched_in_pool(rows: DataFrame, keys: list[str], limit: int = 250) -> DataFrame:
    """(listing_id, n): how many of the limit newest others of its keys (null equals null) a row is left with once those
    that match it are out; rows left with none are not given. Only pairs that match are made: the others are the pool's
    size less these. rows are read several times."""
    targets, pool = _pools(rows, keys, limit)
    seen = F.col("rank") - F.coalesce((F.col("rank") > F.col("own")).cast("int"), F.lit(0)) <= limit
    gone = matched_in(targets, pool, ["_key"]).where(seen).groupBy("a.listing_id").agg(F.count("*").alias("gone"))
    sizes = rows.groupBy(F.struct(*keys).alias("_key")).agg(F.count("*").alias("all"))
    left = rows.select(F.struct(*keys).alias("_key"), "listing_id").join(sizes, "_key").join(gone, "listing_id", "left")
    return left.select("listing_id", (F.least(F.col("all") - 1, F.lit(limit)) - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0")


def _kept(size: int, edges: list[int], limit: int) -> list[int]:
    """How many of a pool's rows, ranked from 1, are kept by the fold that drops each which matches an earlier kept one:
    first for a target outside the pool, then for each rank that leaves itself out. An edge is later * (limit + 2) + earlier."""
    near = [0] * (size + 1)
    for e in edges:
        later, earlier = divmod(int(e), limit + 2)
        near[later] |= 1 << earlier

    def fold(kept: int, ranks: range) -> int:
        for r in ranks:
            if not near[r] & kept:
                kept |= 1 << r
        return kept

    whole = fold(0, range(1, size + 1))
    without = [whole & ~(1 << r) if not whole >> r & 1 else fold(whole & ((1 << r) - 1), range(r + 1, size + 1)) for r in range(1, size + 1)]
    return [fold(0, range(1, min(size, limit) + 1)).bit_count(), *(k.bit_count() for k in without)]


def collapse_pools(rows: DataFrame, keys: list[str], limit: int = 250) -> DataFrame:
    """(listing_id, kept, dropped): what collapse_cross_posts keeps and drops of the limit newest others of a row's keys,
    counted. Matches within a pool are found once, and a pool is folded once for all targets outside it and once for each
    of its own rows, since these differ only in the row that is left out. rows are read several times."""
    targets, pool = _pools(rows, keys, limit)
    own = pool.select("_key", F.col("b").alias("a"), F.col("rank").alias("later"))
    met = matched_in(own, pool, ["_key"]).where("rank < later").select("_key", (F.col("later") * (limit + 2) + F.col("rank")).cast("long").alias("e"))
    edges = met.groupBy("_key").agg(F.collect_list("e").alias("edges"))
    sizes = pool.groupBy("_key").agg(F.count("*").cast("int").alias("size"))

    @F.pandas_udf("array<int>")
    def folds(size: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([_kept(n, [] if e is None else e, limit) for n, e in zip(size, edges, strict=True)])

    folded = sizes.join(edges, "_key", "left").select("_key", "size", folds("size", "edges").alias("by_rank"))
    seen = F.when(F.col("own").isNull(), F.least("size", F.lit(limit))).otherwise(F.col("size") - 1)
    kept = F.get("by_rank", F.coalesce("own", F.lit(0)))
    return targets.join(folded, "_key").where(seen > 0).select("a.listing_id", kept.alias("kept"), (seen - kept).alias("dropped"))


def save_matches(known: DataFrame, found: DataFrame, live: DataFrame) -> DataFrame:
    """The match table after a run: pairs a < b of live listings, the newest confidence and reasons for each."""
    new = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence", "reasons").where("a <> b")
    ids = live.where("suppressed_at is null").select("listing_id").distinct()
    for side in ("a", "b"):
        new = new.join(ids.withColumnRenamed("listing_id", side), side, "left_semi")
    new = new.groupBy("a", "b").agg(F.max(F.struct("confidence", "reasons")).alias("m")).select("a", "b", "m.confidence", "m.reasons")
    return known.join(new, ["a", "b"], "left_anti").select("a", "b", "confidence", "reasons").unionByName(new)
