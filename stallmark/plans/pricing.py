"""Queries over prices: market references, comparables, scores, price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallmark.operators import scoring, state, statistics
from stallmark.operators.comparables import newest_pool, pool_pairs
from stallmark.operators.range_join import Near, near_medians
from stallmark.operators.selection import exact_percentiles
from stallmark.plans import views
from stallmark.shared import stored

_STATS = ["median_price", "mean_price", "min_price", "max_price", "p25", "p75", "p90"]
#: Doubles are compared to four places; the nudge keeps exact halves, which the two engines round apart, off the edge.
_ROUNDED = ["median_price", "mean_price", "p25", "p75", "p90"]
_STATS_SQL = """count(price) AS sample_size, CASE WHEN count(price) >= 10 THEN 'high' WHEN count(price) >= 5 THEN 'medium' ELSE 'low' END AS confidence,
 round(median(price) + 1e-7, 4) AS median_price, round(avg(price) + 1e-7, 4) AS mean_price, min(price) AS min_price, max(price) AS max_price,
 round(quantile_cont(price, 0.25) + 1e-7, 4) AS p25, round(quantile_cont(price, 0.75) + 1e-7, 4) AS p75, round(quantile_cont(price, 0.9) + 1e-7, 4) AS p90"""


def market_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact price reference of each brand and category, by source and combined."""
    out = statistics.market_statistics(views.listing(spark, sf_dir).where("active and item_condition <> 'damaged'"), ["brand", "category"])
    return out.withColumns({c: F.round(F.col(c) + 1e-7, 4) if c in _ROUNDED else F.col(c) for c in _STATS})


MARKET_STATISTICS = f"""WITH {views.LISTING} SELECT brand, category, CASE WHEN grouping(source) = 1 THEN 'combined' ELSE source END AS scope, {_STATS_SQL}
 FROM listing WHERE active AND item_condition <> 'damaged' AND price >= 0 GROUP BY GROUPING SETS ((brand, category, source), (brand, category))"""


def price_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all listings of a source, those without price counted out."""
    out = statistics.price_statistics(views.listing(spark, sf_dir), ["source"])
    return out.withColumns({c: F.round(F.col(c) + 1e-7, 4) if c in _ROUNDED else F.col(c) for c in _STATS})


PRICE_STATISTICS = f"WITH {views.LISTING} SELECT source, {_STATS_SQL} FROM listing GROUP BY source"


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of all arrivals by condition and currency: groups of more than 2,000 distinct prices, of which one
    holds about half of all rows, are narrowed by histograms."""
    out = exact_percentiles(views.feed(spark, sf_dir), ["item_condition", "currency"], "price", [0.25, 0.5, 0.75, 0.9], few=2_000)
    p = F.col("percentiles")
    return out.select("item_condition", "currency", "n", *(F.round(p[i] + 1e-7, 4).alias(c) for i, c in enumerate(("p25", "median_price", "p75", "p90"))))


PRICE_PERCENTILES = f"""WITH {views.FEED} SELECT item_condition, currency, count(price) AS n, round(quantile_cont(price, 0.25) + 1e-7, 4) AS p25, round(median(price) + 1e-7, 4) AS median_price,
 round(quantile_cont(price, 0.75) + 1e-7, 4) AS p75, round(quantile_cont(price, 0.9) + 1e-7, 4) AS p90 FROM feed WHERE price IS NOT NULL GROUP BY item_condition, currency"""


def _pairs(spark: SparkSession, sf_dir: str, keys: list[str], *columns: str) -> DataFrame:
    """Recent listings with the 250 newest others of equal keys."""
    r = views.recent(spark, sf_dir).withColumn("last_seen_at", F.col("seen_at"))
    return pool_pairs(r.select(*keys, "listing_id", "last_seen_at", *columns), keys)


def _pairs_sql(keys: str, residual: str, result: str) -> str:
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    return f"""WITH {views.RECENT}, w AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seen_at DESC, listing_id) AS r FROM recent)
 SELECT a.listing_id, {result} FROM w a JOIN w b ON {same} AND a.listing_id <> b.listing_id AND b.r - (b.r > a.r)::INT <= 250 AND {residual} GROUP BY a.listing_id"""


def comparables_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recent listing, how many of the newest others of its brand, category and currency lie within two sizes, and
    their median price."""
    pairs = _pairs(spark, sf_dir, ["brand", "category", "currency"], "size", "price").where("abs(target.size - candidate.size) <= 2")
    return pairs.groupBy(F.col("target.listing_id").alias("listing_id")).agg(F.count("*").alias("n"), F.round(F.median("candidate.price"), 4).alias("median_price"))


COMPARABLES_RANGE = _pairs_sql("brand, category, currency", "abs(a.size - b.size) <= 2", "count(*) AS n, round(median(b.price), 4) AS median_price")


def _vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent listings as cars: a model, a year and a mileage, the last two not always known."""
    r = views.recent(spark, sf_dir)
    year = F.when(F.col("quantity") % 11 != 0, 1980 + F.col("size") % 35)
    return r.select("listing_id", "brand", F.substring_index("category", " ", 1).alias("model"), year.cast("int").alias("year"), F.when(F.col("l_suppkey") % 13 != 0, F.col("l_extendedprice") * 3).alias("mileage"), "price", "item_condition")


def comparables_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recent listing, all others of its brand and model within two years and within 30,000 km or 35 % of its own
    mileage, unknown values near all, damaged ones left out: how many, and their median price."""
    cars = stored(_vehicles(spark, sf_dir).withColumn("at", F.monotonically_increasing_id()), "cars")  # read for cells and for both sides
    targets = cars.select("listing_id", "at", "brand", "model", "year", "mileage")
    near = near_medians(targets, cars.where("item_condition <> 'damaged'"), ["brand", "model"], [Near("year", 2), Near("mileage", 30_000, 0.35)], "price", "at")
    return near.select("listing_id", "n", F.round("median", 4).alias("median_price"))


COMPARABLES_UNCAPPED = f"""WITH {views.RECENT}, v AS (SELECT listing_id, brand, split_part(category, ' ', 1) AS model, CASE WHEN quantity % 11 <> 0 THEN 1980 + size % 35 END AS year,
 CASE WHEN l_suppkey % 13 <> 0 THEN l_extendedprice * 3 END AS mileage, price, item_condition FROM recent)
 SELECT a.listing_id, count(*) AS n, round(median(b.price), 4) AS median_price FROM v a JOIN v b ON a.brand = b.brand AND a.model = b.model AND a.listing_id <> b.listing_id AND b.item_condition <> 'damaged'
 AND (a.year IS NULL OR b.year IS NULL OR abs(a.year - b.year) <= 2) AND (a.mileage IS NULL OR b.mileage IS NULL OR abs(a.mileage - b.mileage) <= greatest(30000, a.mileage * 0.35)) GROUP BY a.listing_id"""


def comparables_null_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recent listing, how many of the newest others of its brand and category have its place, or an unknown one on
    either side."""
    pairs = _pairs(spark, sf_dir, ["brand", "category"], "location").where("target.location is null or candidate.location is null or target.location = candidate.location")
    return pairs.groupBy(F.col("target.listing_id").alias("listing_id")).agg(F.count("*").alias("n"))


COMPARABLES_NULL_TOLERANT = _pairs_sql("brand, category", "(a.location IS NULL OR b.location IS NULL OR a.location = b.location)", "count(*) AS n")


def top250_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the newest listings of each category and currency that targets are compared with."""
    r = views.listing(spark, sf_dir).where("active and price > 0").withColumnRenamed("seen_at", "last_seen_at")
    return newest_pool(r, ["category", "currency"]).select("category", "currency", "listing_id", "pool_rank")


TOP250_POOL = f"""WITH {views.LISTING} SELECT category, currency, listing_id, pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY category, currency ORDER BY seen_at DESC, listing_id) AS pool_rank
 FROM listing WHERE active AND price > 0) WHERE pool_rank <= 251"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recent listing with the reference of its brand and category among sound recent listings."""
    r = views.recent(spark, sf_dir).select("listing_id", "source", "brand", "category", "title", "size", "price", "item_condition")
    r = stored(r, "recent")  # few of all listings, read for both sides
    sound = r.where("item_condition <> 'damaged'").groupBy("brand", "category").agg(F.count("*").alias("n"), F.median("price").alias("median"))
    return r.join(sound, ["brand", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


_REFERENCES = (
    views.RECENT
    + """, sound AS (SELECT brand, category, count(*) AS n, median(price) AS median FROM recent WHERE item_condition <> 'damaged' GROUP BY brand, category),
 scored AS (SELECT r.*, coalesce(s.n, 0) AS n, s.median, (r.price - s.median) / nullif(s.median, 0) * 100 AS diff FROM recent r LEFT JOIN sound s USING (brand, category)),
 parts AS (SELECT *, CASE WHEN diff IS NULL THEN 0 WHEN diff <= -25 THEN 35 WHEN diff <= -15 THEN 30 WHEN diff <= -8 THEN 24 WHEN diff <= 0 THEN 17 WHEN diff <= 10 THEN 8 ELSE 0 END AS price_vs_market,
 CASE WHEN price <= 32000 THEN 10 WHEN price <= 40000 THEN 7 ELSE 0 END AS absolute_price,
 CASE WHEN length(title) >= 80 THEN 4 ELSE 0 END + CASE WHEN size % 5 >= 3 THEN 3 ELSE 1 END + CASE WHEN size % 2 > 0 THEN 3 ELSE 0 END AS listing_quality,
 CASE item_condition WHEN 'damaged' THEN 3 WHEN 'used' THEN 11 ELSE 14 END AS risks,
 CASE WHEN n >= 10 THEN 5 WHEN n >= 5 THEN 3 ELSE 1 END AS statistical_confidence FROM scored)"""
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _references(spark, sf_dir)
    risk = F.when(F.col("item_condition") == "damaged", 3).when(F.col("item_condition") == "used", 11).otherwise(14)
    s = scoring.deterministic_score(F.col("price"), F.col("median"), statistics.confidence(F.col("n")), F.lit(40000.0), F.col("title"), F.col("size") % 5, F.col("size") % 2, F.lit(8), risk)
    return r.withColumn("s", s)


def deterministic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and its six parts for each recent listing under a budget of 40,000."""
    r = _scored(spark, sf_dir)
    return r.select("listing_id", "s.components.*", "s.score", F.round("s.difference_percent", 4).alias("difference_percent"))


DETERMINISTIC_SCORE = f"""WITH {_REFERENCES} SELECT listing_id, price_vs_market, absolute_price, 8 AS features, listing_quality, risks, statistical_confidence,
 price_vs_market + absolute_price + 8 + listing_quality + risks + statistical_confidence AS score, round(diff, 4) AS difference_percent FROM parts"""


def verdict_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recent listings get each verdict, by source."""
    return _scored(spark, sf_dir).groupBy("source", scoring.verdict(F.col("s.score")).alias("verdict")).agg(F.count("*").alias("n"))


VERDICT_DISTRIBUTION = f"""WITH {_REFERENCES}, s AS (SELECT source, price_vs_market + absolute_price + 8 + listing_quality + risks + statistical_confidence AS score FROM parts)
 SELECT source, CASE WHEN score >= 85 THEN 'excellent_deal' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 30 THEN 'weak' ELSE 'bad' END AS verdict, count(*) AS n FROM s GROUP BY ALL"""


def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a model's score (here the listing's size) on top; who qualifies for a model, and who is told."""
    from stallmark.operators.filters import notify, qualifies_for_model

    r = _scored(spark, sf_dir).withColumn("score", F.col("s.score")).withColumn("final", scoring.combine_scores(F.col("score"), F.col("size")))
    return r.select("listing_id", "score", "final", scoring.verdict(F.col("final")).alias("verdict"), qualifies_for_model(F.col("score"), F.lit(60), F.col("n")).alias("qualifies"), notify(F.col("final"), F.lit(60)).alias("notify"))


COMBINED_SCORE = f"""WITH {_REFERENCES}, s AS (SELECT listing_id, size, n, price_vs_market + absolute_price + 8 + listing_quality + risks + statistical_confidence AS score FROM parts),
 f AS (SELECT *, floor(greatest(0, least(100, score + greatest(0, least(10, size / 10)))) + 0.5)::INT AS final FROM s)
 SELECT listing_id, score, final, CASE WHEN final >= 85 THEN 'excellent_deal' WHEN final >= 70 THEN 'good' WHEN final >= 50 THEN 'fair' WHEN final >= 30 THEN 'weak' ELSE 'bad' END AS verdict,
 score >= 50 AND n >= 2 AS qualifies, final >= 60 AS notify FROM f"""


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of every price series at which the price changed."""
    return state.price_changes(views.price_obs(spark, sf_dir))


PRICE_CHANGES = f"""WITH {views.PRICE_OBS}, w AS (SELECT *, lag(price) OVER o AS before, row_number() OVER o AS rn FROM price_obs WINDOW o AS (PARTITION BY listing_id ORDER BY observed_at, seq))
 SELECT listing_id, seq, observed_at, price FROM w WHERE (rn = 1 OR price IS DISTINCT FROM before) AND price IS NOT NULL"""


def price_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series folded to its last 50 points: how many, the first and the last of them, the whole as text."""
    h = state.price_history(state.price_changes(views.price_obs(spark, sf_dir)), last=50)
    text = F.array_join(F.transform("history", lambda p: p["price"].cast("int").cast("string")), ",")
    return h.select("listing_id", F.size("history").cast("long").alias("points"), F.get("history", F.lit(0))["price"].alias("first_price"), F.element_at("history", -1)["price"].alias("last_price"), text.alias("prices"))


PRICE_HISTORIES = f"""WITH {views.PRICE_OBS}, w AS (SELECT *, lag(price) OVER o AS before, row_number() OVER o AS rn FROM price_obs WINDOW o AS (PARTITION BY listing_id ORDER BY observed_at, seq)),
 c AS (SELECT * FROM w WHERE (rn = 1 OR price IS DISTINCT FROM before) AND price IS NOT NULL),
 l AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, price DESC) AS back FROM c)
 SELECT listing_id, count(*) AS points, first(price ORDER BY observed_at, price) AS first_price, last(price ORDER BY observed_at, price) AS last_price,
 string_agg(price::INT::VARCHAR, ',' ORDER BY observed_at, price) AS prices FROM l WHERE back <= 50 GROUP BY listing_id"""


def price_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent change of every price point against the one before it."""
    from stallmark.functions.numbers import percentage_difference

    w = Window.partitionBy("listing_id").orderBy("observed_at", "seq")
    c = state.price_changes(views.price_obs(spark, sf_dir)).withColumn("before", F.lag("price").over(w))
    return c.select("listing_id", "seq", F.round(percentage_difference(F.col("price"), F.col("before")), 4).alias("percent"))


PRICE_DROP = f"""WITH {views.PRICE_OBS}, w AS (SELECT *, lag(price) OVER o AS before, row_number() OVER o AS rn FROM price_obs WINDOW o AS (PARTITION BY listing_id ORDER BY observed_at, seq)),
 c AS (SELECT * FROM w WHERE (rn = 1 OR price IS DISTINCT FROM before) AND price IS NOT NULL),
 d AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS prior FROM c)
 SELECT listing_id, seq, round((price - prior) / nullif(prior, 0) * 100, 4) AS percent FROM d"""
