"""Comparable listings: the newest of a pool first, then the category's own predicate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.analyzers.base import Analyzer


def eligible(as_of: datetime, days: int) -> Column:
    """Live listings with a price and an extraction, seen within the days before as_of."""
    since = F.lit(as_of) - F.make_dt_interval(days=F.lit(days))
    return F.col("active") & F.col("suppressed_at").isNull() & (F.col("last_seen_at") >= since) & (F.col("price") > 0) & F.col("data").isNotNull()


def newest_pool(df: DataFrame, keys: list[str], limit: int = 250) -> DataFrame:
    """The limit + 1 newest rows of each key (ties: smaller id), numbered from 1: enough for any one member to leave
    itself out. Spark keeps that many a key and task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.col("last_seen_at").desc(), "listing_id")
    return df.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= limit + 1)


def pool_pairs(rows: DataFrame, keys: list[str], limit: int = 250) -> DataFrame:
    """keys, and target and candidate structs of rows with equal keys (null equals null): a target meets the limit newest rows but
    itself, the candidate's pool_rank numbering them. Rows a key: its own times the limit, whatever its size."""
    fields = [c for c in rows.columns if c not in keys]
    on = [f"_{c}" for c in keys]
    keyed = rows.withColumns({f"_{c}": F.struct(c) for c in keys})
    newest = newest_pool(keyed, on, limit)
    t = keyed.join(newest.select("listing_id", F.col("pool_rank").alias("_own")), "listing_id", "left")
    t = t.select(*on, F.struct(*fields).alias("target"), "_own")
    pairs = t.join(newest.select(*on, F.struct(*fields, "pool_rank").alias("candidate")), on)
    place = F.col("candidate.pool_rank") - F.coalesce((F.col("candidate.pool_rank") > F.col("_own")).cast("int"), F.lit(0))
    pairs = pairs.where((F.col("target.listing_id") != F.col("candidate.listing_id")) & (place <= limit))
    return pairs.select(*(F.col(f"_{c}")[c].alias(c) for c in keys), "target", F.col("candidate").withField("pool_rank", place).alias("candidate"))


def comparable_pairs(targets: DataFrame, pool: DataFrame, analyzer: Analyzer, limit: int = 250) -> DataFrame:
    """target and candidate structs of the pool's pairs that compare. The limit comes before the predicate: a target
    sees the limit newest rows of its category and currency but itself, and of these those that are not damaged and
    compare. Currencies equal when both are null."""
    newest = newest_pool(pool.withColumn("_currency", F.coalesce("currency", F.lit(""))), ["category", "_currency"], limit)
    own = newest.select("listing_id", F.col("pool_rank").alias("own_rank"))
    t = targets.join(own, "listing_id", "left").withColumn("_key", analyzer.key(F.col("data"))).where("_key is not null")
    t = t.select(F.struct(*targets.columns).alias("target"), "category", F.coalesce("currency", F.lit("")).alias("_currency"), "_key", "own_rank")
    c = newest.withColumn("_key", analyzer.key(F.col("data"))).where("_key is not null and not (data.condition <=> 'damaged')")
    c = c.select(F.struct(*pool.columns, "pool_rank").alias("candidate"), "category", "_currency", "_key")
    pairs = t.join(c, ["category", "_currency", "_key"])
    seen = F.when(F.col("own_rank").isNull(), F.col("candidate.pool_rank") <= limit).otherwise(F.col("candidate.pool_rank") - (F.col("candidate.pool_rank") > F.col("own_rank")).cast("int") <= limit)
    other = F.col("target.listing_id") != F.col("candidate.listing_id")
    return pairs.where(other & seen & analyzer.comparable(F.col("target.data"), F.col("candidate.data"))).select("target", "candidate")
